"""Aggregate parity: grouped counts, sums, minima and maxima of both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import Recipe
from .classes import NAMES, allowance, code, delta, name


def grouped(df: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per group without nulls in it: ``rows`` and per measure value, contributing and ignored rows.

    Without ``group_by`` there is one group, also for no rows.
    """
    known = reduce(Column.__and__, (F.col(g).isNotNull() for g in recipe.group_by), F.lit(True))
    out = [F.count(F.lit(1)).alias("rows")]
    for m in recipe.measures:
        if m.operator == "count":
            out += [F.count(F.lit(1)).alias(f"v_{m.name}"), F.count(F.lit(1)).alias(f"n_{m.name}"), F.lit(0).cast("long").alias(f"i_{m.name}")]
            continue
        c = F.col(m.column)
        value = {"sum": F.sum, "min": F.min, "max": F.max}[m.operator](c.cast(f"decimal(38,{recipe.columns[m.column].scale or 0})") if m.operator == "sum" else c)
        out += [value.alias(f"v_{m.name}"), F.count(c).alias(f"n_{m.name}"), F.count_if(c.isNull()).alias(f"i_{m.name}")]
    return df.filter(known).groupBy(*recipe.group_by).agg(*out)


def null_groups(recipe: Recipe) -> Column:
    return reduce(Column.__or__, (F.col(g).isNull() for g in recipe.group_by), F.lit(False))


def null_group_rows(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Rows with a null in a group column, which belong to no group."""
    return df.agg(F.count_if(null_groups(recipe)).alias("null_group_rows"))


def input_rows(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Rows, and those of them that belong to no group; one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(null_groups(recipe)).alias("null_group_rows"))


def classified(baseline: DataFrame, candidate: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per group of either side: presence, measures of both sides, and their classes."""
    sides = [grouped(df, recipe) for df in (baseline, candidate)]
    named = []
    for s, df in zip("lr", sides, strict=True):
        plain = [c for c in df.columns if c not in recipe.group_by]
        named.append(df.select(*recipe.group_by, *(F.col(c).alias(f"{s}_{c}") for c in plain), F.lit(True).alias(f"{s}_here")))
    if recipe.group_by:
        both = named[0].join(named[1], list(recipe.group_by), "full_outer")
    else:
        both = named[0].withColumn("one", F.lit(1)).join(named[1].withColumn("one", F.lit(1)), "one", "full_outer").drop("one")
    both = both.withColumns({f"{s}_here": F.coalesce(f"{s}_here", F.lit(False)) for s in "lr"})
    matched = F.col("l_here") & F.col("r_here")
    kinds = {m.name: "integer" if m.operator == "count" else recipe.columns[m.column].type for m in recipe.measures}
    codes = {f"c_{m.name}": F.when(matched, code(F.col(f"l_v_{m.name}"), F.col(f"r_v_{m.name}"), kinds[m.name], m.tolerance, True)) for m in recipe.measures}
    return both.withColumns(codes)


def _coverage() -> dict[str, Column]:
    left, right = F.col("l_here"), F.col("r_here")
    return {"baseline_groups": left, "candidate_groups": right, "common_groups": left & right, "baseline_only": left & ~right, "candidate_only": right & ~left}


def counters(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """Group coverage, as one row."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in _coverage().items()))


TOTALS = {"baseline_contributing": "l_n_", "baseline_ignored": "l_i_", "candidate_contributing": "r_n_", "candidate_ignored": "r_i_"}


def _measured(recipe: Recipe) -> list[Column]:
    parts = [F.count_if(F.col(f"c_{m.name}") == i).alias(f"{m.name}__{n}") for m in recipe.measures for i, n in enumerate(NAMES)]
    return parts + [F.coalesce(F.sum(f"{c}{m.name}"), F.lit(0)).cast("long").alias(f"{m.name}__{n}") for m in recipe.measures for n, c in TOTALS.items()]


def measure_counts(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """(measure, exact, within_tolerance, different) and both sides' contributing and ignored rows."""
    one = rows.agg(*_measured(recipe))
    shown = (F.struct(F.lit(m.name).alias("measure"), *(F.col(f"`{m.name}__{n}`").alias(n) for n in (*NAMES, *TOTALS))) for m in recipe.measures)
    return one.select(F.inline(F.array(*shown)))


def summary(rows: DataFrame, recipe: Recipe) -> tuple[dict, list[dict]]:
    """Group coverage and the measures' counts, in one aggregation."""
    one = rows.agg(*(F.count_if(c).alias(n) for n, c in _coverage().items()), *_measured(recipe)).first().asDict()
    return {n: one[n] for n in _coverage()}, [{"measure": m.name} | {n: one[f"{m.name}__{n}"] for n in (*NAMES, *TOTALS)} for m in recipe.measures]


def sample(rows: DataFrame, recipe: Recipe, limit: int, with_measures: bool = True) -> DataFrame:
    """Bounded evidence in one order: baseline-only groups, candidate-only groups, measures that aren't exact; each by group text."""
    text = [F.col(g).cast("string").alias(f"group_{g}") for g in recipe.group_by]
    kinds = {m.name: "integer" if m.operator == "count" else recipe.columns[m.column].type for m in recipe.measures}
    entry = "section int, kind string, classification string, position int, measure string, baseline string, candidate string, delta string, allowance string, baseline_count long, candidate_count long, baseline_ignored_nulls long, candidate_ignored_nulls long"
    none = F.lit(None)

    def shown(section: int, kind: str, classification: Column, position: int = 0, *more: Column) -> Column:
        values = [F.lit(section), F.lit(kind), classification, F.lit(position), *more, *[none] * (9 - len(more))]
        fields = [x.split() for x in entry.split(", ")]
        return F.struct(*(v.cast(t).alias(n) for v, (n, t) in zip(values, fields, strict=True)))

    left, right = F.col("l_here"), F.col("r_here")
    entries = [F.when(left & ~right, shown(0, "group", F.lit("baseline_only"))), F.when(right & ~left, shown(1, "group", F.lit("candidate_only")))]
    for i, m in enumerate(recipe.measures if with_measures else ()):
        a, b, c = F.col(f"l_v_{m.name}"), F.col(f"r_v_{m.name}"), F.col(f"c_{m.name}")
        numeric = m.tolerance is not None
        measured = [delta(a, b, kinds[m.name]), allowance(a, b, kinds[m.name], m.tolerance)] if numeric else [none, none]
        counts = [F.col(f"{x}_{m.name}") for x in ("l_n", "r_n", "l_i", "r_i")]
        entries.append(F.when(c > 0, shown(2, "measure", name(c), i, F.lit(m.name), a, b, *measured, *counts)))
    found = rows.select(*text, F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    return found.orderBy("section", *(f"group_{g}" for g in recipe.group_by), "position").limit(limit)
