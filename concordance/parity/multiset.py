"""Multiset parity: rows counted with their multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(baseline: DataFrame, candidate: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row shape: ``baseline_count`` and ``candidate_count``; one shuffle, combined before it."""
    sided = baseline.select(*columns, F.lit(0).alias("__side")).unionByName(candidate.select(*columns, F.lit(1).alias("__side")))
    return sided.groupBy(*columns).agg(*(F.count_if(F.col("__side") == i).alias(n) for i, n in enumerate(("baseline_count", "candidate_count"))))


def counters(shapes: DataFrame) -> DataFrame:
    """The nine counters of folded rows, as one row."""
    b, c = F.col("baseline_count"), F.col("candidate_count")
    found = {
        "baseline_rows": F.sum(b),
        "candidate_rows": F.sum(c),
        "baseline_distinct": F.count_if(b > 0),
        "candidate_distinct": F.count_if(c > 0),
        "common_rows": F.sum(F.least(b, c)),
        "baseline_surplus_rows": F.sum(F.greatest(b - c, F.lit(0))),
        "candidate_surplus_rows": F.sum(F.greatest(c - b, F.lit(0))),
        "baseline_surplus_shapes": F.count_if(b > c),
        "candidate_surplus_shapes": F.count_if(c > b),
    }
    return shapes.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(n) for n, x in found.items()))


def surplus(shapes: DataFrame) -> DataFrame:
    """Shapes whose counts differ."""
    return shapes.filter("baseline_count <> candidate_count")


def sample(shapes: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Bounded evidence, ordered as the rows' encodings: null first, then by length and bytes."""
    order = [x for c in columns for x in (F.col(c).isNotNull(), F.octet_length(F.col(c).cast("string")), F.col(c).cast("string"))]
    return surplus(shapes).orderBy(*order).limit(limit)
