"""Checks over several datasets: event windows, identity, references and conservation.

Every check runs on one side's set of datasets and gives one row of counters.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parity.classes import code
from .parity.keyed import identity as key_identity
from .policy import Tolerance, require

NULL_RULES = {"identity": ("forbid", "equal"), "reference": ("forbid", "all-null-exempt", "match-null"), "conservation": ("forbid", "zero")}


def any_null(columns: list[str]) -> Column:
    return reduce(Column.__or__, (F.col(c).isNull() for c in columns))


def all_null(columns: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(c).isNull() for c in columns))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def window_counts(df: DataFrame, event_time: str, start: Column, end: Column) -> DataFrame:
    """Rows against the half-open event window [start, end); one pass, no shuffle of rows."""
    t = F.col(event_time)
    parts = {"in_window": (t >= start) & (t < end), "before_window": t < start, "at_or_after_end": t >= end, "null_event_time": t.isNull()}
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in parts.items()), F.lit(0).cast("long").alias("invalid_event_time"))


def identity(df: DataFrame, columns: list[str], nulls: str = "forbid") -> DataFrame:
    """Uniqueness of a key: counts and ``failures`` (duplicate keys, and null keys unless they are equal values)."""
    require(nulls in NULL_RULES["identity"], "nulls must be forbid or equal")
    failed = F.col("duplicate_keys") + (F.col("null_key_rows") if nulls == "forbid" else F.lit(0))
    return key_identity(df, tuple(columns)).withColumn("failures", failed)


def reference(child: DataFrame, child_columns: list[str], parent: DataFrame, parent_columns: list[str], nulls: str = "forbid") -> DataFrame:
    """Each child row's parents: exempt, matched (just one), orphan, ambiguous, null_failure; as one row.

    Child rows are counted by key before the join, so a hot key is a row; parents are
    counted by key as well, so nothing is multiplied.
    """
    require(nulls in NULL_RULES["reference"], "nulls must be forbid, all-null-exempt or match-null")
    names = [f"k{i}" for i in range(len(child_columns))]
    kids = child.select(*(F.col(c).alias(n) for c, n in zip(child_columns, names, strict=True))).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(*(F.col(c).alias(f"p{n}") for c, n in zip(parent_columns, names, strict=True))).groupBy(*(f"p{n}" for n in names)).agg(F.count(F.lit(1)).alias("parents"))
    on = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"p{n}")) for n in names))
    rows = kids.join(parents, on, "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    null = F.lit(False) if nulls == "match-null" else any_null(names)
    exempt = all_null(names) if nulls == "all-null-exempt" else F.lit(False)
    kind = F.when(exempt, "exempt").when(null, "null_failure").when(F.col("parents") == 0, "orphan").when(F.col("parents") == 1, "matched").otherwise("ambiguous")
    rows = rows.select("n", kind.alias("kind"))
    kinds = ("exempt", "matched", "orphan", "ambiguous", "null_failure")
    return rows.agg(zero(F.sum("n")).alias("child_rows"), *(zero(F.sum(F.when(F.col("kind") == k, F.col("n")))).alias(k) for k in kinds))


def conservation_groups(parent: DataFrame, parent_group: list[str], parent_measure: str, child: DataFrame, child_group: list[str], child_measure: str, kind: str, scale: int = 0, tolerance: Tolerance | None = None) -> DataFrame:
    """One row per group: parent rows and value, child rows and sum, and the class of a clean group.

    Null groups match null groups.  A parent without children is compared with 0; groups
    with children only or several parents are not compared.  Null measures add nothing.
    """
    number = f"decimal(38,{scale})"
    names = [f"g{i}" for i in range(len(parent_group))]
    value = lambda c: F.coalesce(F.col(c).cast(number), F.lit(0).cast(number))
    sides = []
    for df, group, measure, mark in ((parent, parent_group, parent_measure, "p"), (child, child_group, child_measure, "c")):
        own = {"p": F.lit(0), "c": F.lit(0)} | {mark: F.lit(1)}
        rows = df.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), value(measure).alias("m"), F.col(measure).isNull().alias("null"), *(c.alias(x) for x, c in own.items()))
        sides.append(rows)
    here = lambda x, c: F.when(F.col(x) == 1, c)
    sums = [F.sum(x).alias(f"{x}_rows") for x in "pc"] + [F.sum(here(x, F.col("m"))).alias(f"{x}_value") for x in "pc"] + [F.count_if((F.col(x) == 1) & F.col("null")).alias(f"{x}_null") for x in "pc"]
    # One exchange: both sides meet in one aggregation, partial sums before it.
    both = sides[0].unionByName(sides[1]).groupBy(*names).agg(*sums)
    both = both.withColumn("c_value", F.coalesce("c_value", F.lit(0).cast(number)))
    compared = code(F.col("p_value"), F.col("c_value"), kind, tolerance, True)
    return both.withColumn("class", F.when(F.col("p_rows") == 1, compared))


def conservation(groups: DataFrame) -> DataFrame:
    """Counters of conservation groups, as one row."""
    p, c = F.col("p_rows"), F.col("c_rows")
    found = {
        "groups": F.lit(True),
        "exact": F.col("class") == 0,
        "within_tolerance": F.col("class") == 1,
        "different": F.col("class") == 2,
        "child_only": p == 0,
        "parent_without_children": (p > 0) & (c == 0),
        "duplicate_parent": p > 1,
    }
    nulls = F.coalesce(F.sum(F.col("p_null") + F.col("c_null")), F.lit(0)).cast("long")
    return groups.agg(*(F.count_if(x).alias(n) for n, x in found.items()), nulls.alias("null_measure_rows"))


def acyclic(links: list[tuple[str, str]]) -> bool:
    """Whether child-to-parent links between datasets have no circle."""
    left = set(links)
    while left:
        parents = {p for _, p in left}
        rest = {(c, p) for c, p in left if c in parents}
        if rest == left:
            return False
        left = rest
    return True


def coordination(alignment: dict) -> tuple[bool, str | None]:
    """(holds, reason) of a declared coordination of snapshots; a reason without a failure is a doubt.

    source-snapshot: one token per domain, which is certain; watermark: every one is an
    instant at or after the window's end, certain if the streams are closed and a sign
    only if they are heuristic; declared-cutoff: never more than a claim.
    """
    declared, datasets = alignment["coordination"], alignment["datasets"]
    if declared["mode"] == "source-snapshot":
        tokens = {(d["token_domain"], d["snapshot_token"]) for d in datasets}
        split = len(tokens) > len({domain for domain, _ in tokens})
        return not split, "snapshot-tokens-differ" if split else None
    if declared["mode"] == "watermark":
        end = datetime.fromisoformat(alignment["event_window"]["end"])
        if min(datetime.fromisoformat(d["watermark"]) for d in datasets) < end:
            return False, "watermark-before-window-end"
        return True, "heuristic-watermark" if declared["watermark_kind"] == "heuristic" else None
    require(declared["mode"] == "declared-cutoff", "coordination.mode is unknown")
    return True, "coordination-not-machine-established"


def outcome(failed: bool, uncertain: bool) -> str:
    """FAIL before INCONCLUSIVE before PASS."""
    return "FAIL" if failed else "INCONCLUSIVE" if uncertain else "PASS"
