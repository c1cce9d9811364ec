"""Discrepancy groups of results, their transitions over runs, and drill-down."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .policy import canonical_json, require

#: Counters that are discrepancies, by mode: kind, classification.
KEYED = {"baseline_only": ("key", "baseline_only"), "candidate_only": ("key", "candidate_only")}
COUNTED = {
    "keyed": KEYED,
    "aggregate": {"baseline_only": ("group", "baseline_only"), "candidate_only": ("group", "candidate_only")},
    "multiset": {"baseline_surplus_shapes": ("row", "baseline_surplus"), "candidate_surplus_shapes": ("row", "candidate_surplus")},
}
#: What is counted by name, by mode.
NAMED = {"keyed": "field", "aggregate": "measure", "multiset": "column"}


def group_id(kind: str, classification: str, name: str) -> str:
    return hashlib.sha256(canonical_json([kind, classification, name]).encode()).hexdigest()


def groups(counters: dict, fields: Sequence[dict], mode: str = "keyed") -> list[dict]:
    """(kind, classification, name, count, group_id) of a result; empty groups are left out.

    ``fields``: the fields' counts (keyed) or the measures' (aggregate).
    """
    out = [(*kind, "", counters[x]) for x, kind in COUNTED[mode].items()]
    out += [(NAMED[mode], c, f[NAMED[mode]], f[c]) for f in fields for c in ("within_tolerance", "different")]
    return [{"kind": k, "classification": c, "name": n, "count": v, "group_id": group_id(k, c, n)} for k, c, n, v in out if v]


def group_frame(counters: DataFrame, fields: DataFrame | None = None, mode: str = "keyed") -> DataFrame:
    """The same as a frame of (kind, classification, name, count)."""
    out = counters.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("classification"), F.lit("").alias("name"), F.col(x).alias("count")) for x, (k, c) in COUNTED[mode].items()))))
    if fields is not None:
        named = NAMED[mode]
        out = out.unionByName(fields.select(F.inline(F.array(*(F.struct(F.lit(named).alias("kind"), F.lit(c).alias("classification"), F.col(named).alias("name"), F.col(c).alias("count")) for c in ("within_tolerance", "different"))))))
    return out.filter("count > 0")


def keyed_groups(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The groups of classified rows of keyed parity, (kind, classification, name, count), from one aggregation."""
    b, c = F.col("in_baseline"), F.col("in_candidate")
    parts = {("key", "baseline_only", ""): b & ~c, ("key", "candidate_only", ""): c & ~b}
    parts |= {("field", kind, f): F.col(f"c_{f}") == i for f in fields for i, kind in ((1, "within_tolerance"), (2, "different"))}
    one = rows.agg(*(F.count_if(x).alias(f"n{i}") for i, x in enumerate(parts.values())))
    shown = (F.struct(*(F.lit(v).alias(n) for n, v in zip(("kind", "classification", "name"), k, strict=True)), F.col(f"n{i}").alias("count")) for i, k in enumerate(parts))
    return one.select(F.inline(F.array(*shown))).filter("count > 0")


def transition(before: Column, now: Column) -> Column:
    return (
        F.when((before == 0) & (now > 0), "introduced").when((before > 0) & (now == 0), "resolved").when(now > before, "increased").when(now < before, "decreased").otherwise("unchanged")
    )


def series(runs: Sequence[DataFrame]) -> DataFrame:
    """Each group's count in each run, with the change from the run before; runs in the caller's order.

    A group that a run lacks counts 0.  The first run has no transition.
    """
    require(len(runs) >= 2, "a series has at least two runs")
    found = None
    for i, run in enumerate(runs):
        part = run.select(F.lit(i).alias("run"), "kind", "classification", "name", "count")
        found = part if found is None else found.unionByName(part)
    names = ["kind", "classification", "name"]
    every = found.select(*names).distinct().withColumn("run", F.explode(F.array(*map(F.lit, range(len(runs))))))
    filled = every.join(found, [*names, "run"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    before = F.lag("count").over(Window.partitionBy(*names).orderBy("run"))
    return filled.withColumn("before", before).select(*names, "run", "count", F.when(F.col("before").isNotNull(), transition(F.col("before"), F.col("count"))).alias("transition"))


def drill_down(evidence: DataFrame, run: str, order: Sequence[str], per_run: int, total: int) -> DataFrame:
    """At most ``per_run`` rows of each run and ``total`` together, in order."""
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("rank") <= per_run)
    return ranked.orderBy(run, "rank").limit(total)


def suite_series(spark: SparkSession, suites: Sequence[dict[str, dict]]) -> DataFrame:
    """(case_id, run, outcome, discrepancies, transition) of 2 to 16 suites with the same cases."""
    require(2 <= len(suites) <= 16, "a suite series has 2 to 16 suites")
    require(len({frozenset(s) for s in suites}) == 1, "the suites must have the same cases")
    rows = [(c, i, r["outcome"], int(r["discrepancies"])) for i, s in enumerate(suites) for c, r in s.items()]
    df = spark.createDataFrame(rows, "case_id string, run int, outcome string, discrepancies long")
    before = F.lag("discrepancies").over(Window.partitionBy("case_id").orderBy("run"))
    return df.withColumn("transition", F.when(before.isNotNull(), transition(before, F.col("discrepancies"))))
