"""Range-partitioned discovery and selective investigation of keyed parity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parity.keyed import COUNTERS
from .policy import Recipe, canonical_json, digest, require


#: Counters that make a discovery fail.
FAILING = ("baseline_only", "candidate_only", "matched_with_required_difference")


@dataclass(frozen=True)
class RangePlan:
    """Ranges of an integer key by their exclusive upper bounds; the last range is open."""

    uppers: tuple[int, ...]

    @classmethod
    def of(cls, value: dict) -> RangePlan:
        require(value.get("partition_plan_version") == 1, "partition_plan_version must be 1")
        bounds = [r["upper"] for r in value["ranges"]]
        require(2 <= len(bounds) <= 128, "a plan has 2 to 128 ranges")
        require(bounds[-1] is None and None not in bounds[:-1], "only the last range is open")
        require(all(a < b for a, b in zip(bounds[:-2], bounds[1:-1], strict=True)), "upper bounds must increase")
        return cls(tuple(bounds[:-1]))

    def route(self, key: Column) -> Column:
        """The number of the key's range, from 0; null for a null key."""
        return sum(((key >= u).cast("int") for u in self.uppers[1:]), (key >= self.uppers[0]).cast("int"))


def eligible(recipe: Recipe) -> None:
    require(recipe.mode == "keyed" and len(recipe.keys) == 1 and recipe.columns[recipe.keys[0]].type == "integer", "discovery needs a keyed recipe with one integer key")
    require(not recipe.raw, "discovery publishes counts only")


def routed(key: Column, plan: RangePlan) -> Column:
    """The key's range; a null key has none and is an error."""
    return F.when(key.isNull(), F.raise_error(F.lit("a null key belongs to no range")).cast("int")).otherwise(plan.route(key))


def discover(rows: DataFrame, recipe: Recipe, plan: RangePlan) -> DataFrame:
    """The eight counters per range, of classified rows; ranges without rows have zeros, null keys are an error."""
    eligible(recipe)
    b, c = F.col("in_baseline"), F.col("in_candidate")
    conditions = (b, c, b & c, b & ~c, c & ~b, *(F.col("class") == i for i in range(3)))
    found = rows.withColumn("part", routed(F.col(recipe.keys[0]), plan)).groupBy("part").agg(*(F.count_if(x).alias(n) for n, x in zip(COUNTERS, conditions, strict=True)))
    every = rows.sparkSession.range(len(plan.uppers) + 1).select(F.col("id").cast("int").alias("part"))
    return every.join(found, "part", "left").na.fill(0)


def suspects(found: DataFrame) -> DataFrame:
    """Ranges with anything one-sided or not exact."""
    return found.filter("baseline_only + candidate_only + matched_within_tolerance + matched_with_required_difference > 0")


def _case_counts(chosen: DataFrame, recipe: Recipe) -> DataFrame:
    """(part, case_count) straight from the classes: a one-sided key is a case, and each field that isn't exact."""
    fields = sum(((F.col(f"c_{f.name}") > 0).cast("int") for f in recipe.values), F.lit(0))
    cases = F.when(F.col("class").isNull(), 1).otherwise(fields)
    return chosen.groupBy("part").agg(F.sum(cases).cast("long").alias("case_count"))


def investigate(rows: DataFrame, recipe: Recipe, plan: RangePlan, parts: list[int], per_part: int, total: int) -> DataFrame:
    """Cases of the chosen ranges: part, key, kind, field, at most ``per_part`` a range and ``total`` together.

    One-sided keys come first, then fields, each by key.  ``case_count`` tells how many the
    range has, so that a cut is visible.  The rank is cut per task before the shuffle.
    """
    key = recipe.keys[0]
    chosen = rows.withColumn("part", routed(F.col(key), plan)).filter(F.col("part").isin(parts))
    case = lambda section, field: F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"))
    one_sided = F.when(F.col("class").isNull(), F.when(F.col("in_baseline"), case(0, "")).otherwise(case(1, "")))
    fields = [F.when(F.col(f"c_{f.name}") > 0, case(2, f.name)) for f in recipe.values]
    cases = chosen.filter("class IS NULL OR class > 0").select("part", F.col(key).alias("key"), F.inline(F.filter(F.array(one_sided, *fields), lambda x: x.isNotNull())))
    counts = _case_counts(chosen, recipe)
    order = Window.partitionBy("part").orderBy("section", "key", "field")
    ranked = cases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_part)
    kind = F.element_at(F.array(F.lit("baseline_only"), F.lit("candidate_only"), F.lit("field")), F.col("section") + 1)
    return ranked.join(counts, "part").select("part", "key", kind.alias("kind"), "field", F.col("rank").cast("long").alias("rank"), "case_count").orderBy("part", "rank").limit(total)


def receipt(found: list[dict], plan: RangePlan, recipe: Recipe) -> dict:
    """A discovery's ranges, totals and outcome, as published."""
    body = {"policy_sha256": recipe.fingerprint, "uppers": list(plan.uppers), "ranges": found, "totals": {n: sum(r[n] for r in found) for n in COUNTERS}}
    body["outcome"] = "FAIL" if any(body["totals"][n] for n in FAILING) else "PASS"
    return body | {"receipt_sha256": digest(body)}


def verify_receipt(value: dict, plan: RangePlan) -> dict:
    """The receipt, if its counts can be true together, agree with the plan and say its outcome."""
    body = {k: v for k, v in value.items() if k != "receipt_sha256"}
    require(digest(body) == value.get("receipt_sha256"), "the receipt was changed")
    require(tuple(body["uppers"]) == plan.uppers and [r["part"] for r in body["ranges"]] == list(range(len(plan.uppers) + 1)), "the receipt is of another plan")
    for r in (*body["ranges"], body["totals"]):
        require(all(type(r[n]) is int and r[n] >= 0 for n in COUNTERS), "a counter is no count")
        matched = r["matched_exact"] + r["matched_within_tolerance"] + r["matched_with_required_difference"]
        require(r["baseline"] == r["common_keys"] + r["baseline_only"] and r["candidate"] == r["common_keys"] + r["candidate_only"] and matched == r["common_keys"], "the counters of a range contradict each other")
    require(all(body["totals"][n] == sum(r[n] for r in body["ranges"]) for n in COUNTERS), "the totals aren't those of the ranges")
    require((body["outcome"] == "FAIL") == any(body["totals"][n] for n in FAILING), "the outcome isn't what the counts say")
    return value


def completeness(cases: list[dict], parts: list[int], max_bytes: int) -> dict:
    """An investigation's cases up to a number of bytes as JSON, and whether each range, and all, are complete."""
    kept, size = [], 0
    for c in cases:
        size += len(canonical_json({k: str(v) for k, v in c.items()}))
        if size > max_bytes:
            break
        kept.append(c)
    every = {c["part"]: c["case_count"] for c in cases}
    shown = {p: sum(c["part"] == p for c in kept) for p in parts}
    flags = {p: shown[p] == every.get(p, 0) for p in parts}
    return {"cases": kept, "ranges": [{"part": p, "shown": shown[p], "case_count": every.get(p), "complete": p in every and flags[p]} for p in parts], "complete": all(p in every and flags[p] for p in parts)}
