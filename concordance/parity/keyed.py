"""Keyed parity: rows of both sides matched one to one by typed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import Recipe
from .classes import NAMES, allowance, code, delta, name

COUNTERS = ("baseline", "candidate", "common_keys", "baseline_only", "candidate_only", "matched_exact", "matched_within_tolerance", "matched_with_required_difference")


def classified(baseline: DataFrame, candidate: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per key: keys, ``in_baseline``, ``in_candidate``, ``l_``/``r_`` values, ``c_`` classes, ``class``.

    A full outer join, null keys matching null keys; presence is a column of its own.
    Sides are expected to have each key once (see ``identity``).
    """
    left = baseline.select(*(F.col(k).alias(f"lk_{k}") for k in recipe.keys), *(F.col(f.name).alias(f"l_{f.name}") for f in recipe.values), F.lit(True).alias("in_baseline"))
    right = candidate.select(*(F.col(k).alias(f"rk_{k}") for k in recipe.keys), *(F.col(f.name).alias(f"r_{f.name}") for f in recipe.values), F.lit(True).alias("in_candidate"))
    on = reduce(Column.__and__, (F.col(f"lk_{k}").eqNullSafe(F.col(f"rk_{k}")) for k in recipe.keys))
    both = left.join(right, on, "full_outer")
    codes = [code(F.col(f"l_{f.name}"), F.col(f"r_{f.name}"), f.type, f.tolerance, recipe.nulls_equal).alias(f"c_{f.name}") for f in recipe.values]
    matched = F.col("in_baseline") & F.col("in_candidate")
    rows = both.select(
        *(F.coalesce(f"lk_{k}", f"rk_{k}").alias(k) for k in recipe.keys),
        F.coalesce("in_baseline", F.lit(False)).alias("in_baseline"),
        F.coalesce("in_candidate", F.lit(False)).alias("in_candidate"),
        *(F.col(f"{s}_{f.name}") for f in recipe.values for s in "lr"),
        *(F.when(matched, c).alias(f"c_{f.name}") for c, f in zip(codes, recipe.values, strict=True)),
    )
    classes = [F.col(f"c_{f.name}") for f in recipe.values]
    worst = F.greatest(*classes) if len(classes) > 1 else classes[0] if classes else F.lit(0)
    return rows.withColumn("class", F.when(F.col("in_baseline") & F.col("in_candidate"), worst))


def counters(rows: DataFrame) -> DataFrame:
    """The eight counters of classified rows, as one row."""
    b, c = F.col("in_baseline"), F.col("in_candidate")
    conditions = (b, c, b & c, b & ~c, c & ~b, *(F.col("class") == i for i in range(3)))
    return rows.agg(*(F.count_if(x).alias(n) for n, x in zip(COUNTERS, conditions, strict=True)))


def field_counts(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """(field, exact, within_tolerance, different): one aggregation, then turned round."""
    one = rows.agg(*(F.count_if(F.col(f"c_{f.name}") == i).alias(f"{f.name}__{i}") for f in recipe.values for i in range(3)))
    each = F.array(*(F.struct(F.lit(f.name).alias("field"), *(F.col(f"{f.name}__{i}").alias(n) for i, n in enumerate(NAMES))) for f in recipe.values))
    return one.select(F.inline(each))


def identity(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(rows, distinct_keys, null_key_rows, duplicate_keys) of one side, as one row."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    null = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    totals = (F.sum("__n"), F.count(F.lit(1)), F.sum(F.when(null, F.col("__n"))), F.count_if(F.col("__n") > 1))
    names = ("rows", "distinct_keys", "null_key_rows", "duplicate_keys")
    return groups.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in zip(totals, names, strict=True)))


def coverage(baseline: DataFrame, candidate: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Row counts, key coverage and identity problems of both sides in one shuffle, as one row."""
    sided = baseline.select(*keys, F.lit(0).alias("__side")).unionByName(candidate.select(*keys, F.lit(1).alias("__side")))
    groups = sided.groupBy(*keys).agg(*(F.count_if(F.col("__side") == i).alias(n) for i, n in enumerate(("__b", "__c"))))
    null = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    b, c = F.col("__b"), F.col("__c")
    found = {
        "baseline": F.sum(b),
        "candidate": F.sum(c),
        "common_keys": F.count_if((b > 0) & (c > 0)),
        "baseline_only": F.count_if((b > 0) & (c == 0)),
        "candidate_only": F.count_if((b == 0) & (c > 0)),
        "baseline_null_keys": F.sum(F.when(null, b)),
        "candidate_null_keys": F.sum(F.when(null, c)),
        "baseline_duplicate_keys": F.count_if(b > 1),
        "candidate_duplicate_keys": F.count_if(c > 1),
    }
    return groups.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(n) for n, x in found.items()))


def one_sided(rows: DataFrame, recipe: Recipe, side: str) -> DataFrame:
    """The keys of one side only."""
    other = "candidate" if side == "baseline" else "baseline"
    return rows.filter(F.col(f"in_{side}") & ~F.col(f"in_{other}")).select(*recipe.keys)


def field_evidence(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per field that isn't exact: keys, field, position, values as text, class, delta, allowance."""
    entries = []
    for i, f in enumerate(recipe.values):
        left, right = F.col(f"l_{f.name}"), F.col(f"r_{f.name}")
        numeric = f.tolerance is not None
        measured = [delta(left, right, f.type).cast("string") if numeric else F.lit(None).cast("string"), allowance(left, right, f.type, f.tolerance).cast("string") if numeric else F.lit(None).cast("string")]
        shown = F.struct(F.lit(f.name).alias("field"), F.lit(i).alias("position"), left.cast("string").alias("baseline_value"), right.cast("string").alias("candidate_value"), name(F.col(f"c_{f.name}")).alias("classification"), measured[0].alias("delta"), measured[1].alias("allowance"))
        entries.append(F.when(F.col(f"c_{f.name}") > 0, shown))
    return rows.filter(F.col("class") > 0).select(*recipe.keys, F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))


def sample(rows: DataFrame, recipe: Recipe, limit: int) -> DataFrame:
    """Bounded evidence in one order: baseline-only keys, candidate-only keys, fields; each by key text."""
    shape = [f"key_{k}" for k in recipe.keys]
    text = [F.col(k).cast("string").alias(n) for k, n in zip(recipe.keys, shape, strict=True)]
    parts = [one_sided(rows, recipe, s).select(F.lit(i).alias("section"), F.lit(f"{s}_only").alias("kind"), *text, *(F.lit(None).cast(t).alias(n) for n, t in (("field", "string"), ("position", "int"), ("baseline_value", "string"), ("candidate_value", "string"), ("classification", "string"), ("delta", "string"), ("allowance", "string")))) for i, s in enumerate(("baseline", "candidate"))]
    if recipe.values:
        parts.append(field_evidence(rows, recipe).select(F.lit(2).alias("section"), F.lit("field").alias("kind"), *text, "field", "position", "baseline_value", "candidate_value", "classification", "delta", "allowance"))
    return reduce(DataFrame.unionByName, parts).orderBy("section", *shape, "position").limit(limit)
