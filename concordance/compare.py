"""One comparison from inputs to a result: what runs, and how counts become an outcome."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis
from .parity import aggregate, keyed, multiset
from .policy import Recipe, check_lock, explain, require
from .scalars import parsed
from .sources import MAX_DECODED_BYTES, MAX_INPUT_BYTES, MAX_ROWS, check_sizes, digest, read_source

EXIT_CODES = {"PASS": 0, "FAIL": 1, "ERROR": 2, "INCONCLUSIVE": 3, "INTERRUPTED": 130}


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = MAX_INPUT_BYTES
    max_decoded_bytes: int = MAX_DECODED_BYTES
    max_rows: int = MAX_ROWS
    max_groups: int = 100_000
    max_distinct_rows: int = 100_000
    sample: int = 100
    max_identity_keys: int = 100_000_000
    max_conservation_groups: int = 100_000_000
    max_temp_bytes: int | None = None  # Spark spills by itself; recorded only


def decide(problems: list[str], differs: bool) -> str:
    return "INCONCLUSIVE" if problems else "FAIL" if differs else "PASS"


def compare_frames(recipe: Recipe, baseline: DataFrame, candidate: DataFrame, limits: Limits = Limits()) -> dict:
    """The result of comparing two frames: counts, discrepancy groups, problems, outcome."""
    sides = [parsed(df, recipe, i).persist(StorageLevel.DISK_ONLY) for i, df in enumerate((baseline, candidate))]
    try:
        return compare_parsed(recipe, *sides, limits)
    finally:
        for s in sides:
            s.unpersist()


def compare_parsed(recipe: Recipe, left: DataFrame, right: DataFrame, limits: Limits = Limits()) -> dict:
    """The same of sides that are parsed already, which the caller may keep."""
    body = {"keyed": _keyed, "aggregate": _aggregate, "multiset": _multiset}[recipe.mode](recipe, left, right, limits)
    return {"mode": recipe.mode, "policy": explain(recipe), "resource_limits": {k: v for k, v in asdict(limits).items() if v is not None}, **body}


def _rows_ok(counts: dict, limits: Limits) -> None:
    require(max(counts["baseline"], counts["candidate"]) <= limits.max_rows, "an input exceeds max_rows")


def _empty(recipe: Recipe, counts: dict, both: bool = False) -> list[str]:
    empty = [s for s in ("baseline", "candidate") if not counts[s]]
    return [f"{s} is empty" for s in empty] if not recipe.expected_empty and len(empty) > both else []


def _keyed(recipe: Recipe, left: DataFrame, right: DataFrame, limits: Limits) -> dict:
    found = keyed.coverage(left, right, recipe.keys).first().asDict()
    _rows_ok(found, limits)
    identity = [f"{s} has {k.replace('_', ' ')}" for s in ("baseline", "candidate") for k in ("null_keys", "duplicate_keys") if found[f"{s}_{k}"]]
    problems = identity + _empty(recipe, found)
    counts = {k: found[k] for k in keyed.COUNTERS[:5]}
    fields, sample = [{"field": f.name, "exact": 0, "within_tolerance": 0, "different": 0} for f in recipe.values], []
    counts |= dict.fromkeys(keyed.COUNTERS[5:], 0)
    if not identity:
        rows = keyed.classified(left, right, recipe)
        counts |= keyed.counters(rows).first().asDict()
        if recipe.values:
            fields = [r.asDict() for r in keyed.field_counts(rows, recipe).collect()]
        if recipe.raw:
            sample = [r.asDict() for r in keyed.sample(rows, recipe, limits.sample).collect()]
    differs = bool(counts["baseline_only"] or counts["candidate_only"] or counts["matched_with_required_difference"])
    groups = analysis.groups(counts, fields)
    return {"counts": counts, "fields": fields, "groups": groups, "problems": problems, "sample": sample, "discrepancies": sum(g["count"] for g in groups), "outcome": decide(problems, differs)}


def _aggregate(recipe: Recipe, left: DataFrame, right: DataFrame, limits: Limits) -> dict:
    sided = [aggregate.input_rows(df, recipe).withColumn("side", F.lit(s)) for s, df in (("baseline", left), ("candidate", right))]
    seen = {r["side"]: r for r in sided[0].unionByName(sided[1]).collect()}
    counts = {s: seen[s]["rows"] for s in ("baseline", "candidate")}
    _rows_ok(counts, limits)
    nulls = {s: seen[s]["null_group_rows"] for s in ("baseline", "candidate")}
    rows = aggregate.classified(left, right, recipe).persist(StorageLevel.DISK_ONLY)
    try:
        found, measures = aggregate.summary(rows, recipe)
        counts |= found
        require(max(counts["baseline_groups"], counts["candidate_groups"]) <= limits.max_groups, "there are more than max_groups groups")
        rejecting = {m.name for m in recipe.measures if m.reject_nulls and m.operator != "count"}
        problems = [f"{s} has null groups" for s, n in nulls.items() if n] + _empty(recipe, counts)
        problems += [f"{s} has nulls in {m['measure']}" for m in measures for s in ("baseline", "candidate") if m["measure"] in rejecting and m[f"{s}_ignored"]]
        sample = [r.asDict() for r in aggregate.sample(rows, recipe, limits.sample, with_measures=not problems).collect()] if recipe.raw else []
    finally:
        rows.unpersist()
    differs = bool(counts["baseline_only"] or counts["candidate_only"] or any(m["different"] for m in measures))
    groups = analysis.groups(counts, measures, "aggregate")
    return {"counts": counts, "measures": measures, "groups": groups, "problems": problems, "sample": sample, "discrepancies": sum(g["count"] for g in groups), "outcome": decide(problems, differs)}


def _multiset(recipe: Recipe, left: DataFrame, right: DataFrame, limits: Limits) -> dict:
    columns = sorted(recipe.columns)
    shapes = multiset.folded(left, right, columns)
    counts = multiset.counters(shapes).first().asDict()
    _rows_ok({"baseline": counts["baseline_rows"], "candidate": counts["candidate_rows"]}, limits)
    require(max(counts["baseline_distinct"], counts["candidate_distinct"]) <= limits.max_distinct_rows, "there are more than max_distinct_rows row shapes")
    problems = _empty(recipe, {"baseline": counts["baseline_rows"], "candidate": counts["candidate_rows"]}, both=True)
    groups = analysis.groups(counts, [], "multiset")
    total = sum(g["count"] for g in groups)
    sample = [r.asDict() for r in multiset.sample(shapes, columns, limits.sample).collect()] if recipe.raw else []
    return {"counts": counts, "groups": groups, "problems": problems, "sample": sample, "discrepancies": total, "outcome": decide(problems, bool(total))}


def compare(spark: SparkSession, recipe: Recipe, baseline: str, candidate: str, limits: Limits = Limits(), expected_policy_sha256: str | None = None) -> dict:
    """Compare two sources.  The policy's lock and the sizes are checked before reading, the digests after too."""
    check_lock(recipe, expected_policy_sha256)
    locators = [baseline, candidate]
    check_sizes(locators, limits.max_input_bytes, limits.max_decoded_bytes)
    before = [digest(x) for x in locators]
    result = compare_frames(recipe, *(read_source(spark, x, recipe, i) for i, x in enumerate(locators)), limits)
    require([digest(x) for x in locators] == before, "an input changed while it was read")
    return result | {"inputs": dict(zip(("baseline", "candidate"), before, strict=True))}
