"""Suites: many comparisons under one plan, in threads, with shards and a common outcome."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evidence
from .compare import Limits
from .compare import compare as compare_sources
from .policy import closed, digest, load_recipe, require, texts
from .sources import SCHEMES, file_of
from .sources import digest as source_digest

#: Outcomes of cases, the better first; a suite has its worst case's.
PRECEDENCE = ("PASS", "FAIL", "INCONCLUSIVE", "ERROR", "INTERRUPTED")
MOST_JOBS = 16


#: A case's limits, which a plan may set for all cases and for one; those of ``compare.Limits``.
LIMITS = ("max_input_bytes", "max_decoded_bytes", "max_rows", "max_groups", "max_distinct_rows")
CASE_ID = r"[a-z0-9]+(-[a-z0-9]+)*"


@dataclass(frozen=True)
class Case:
    id: str
    recipe: str
    baseline: str
    candidate: str
    tags: tuple[str, ...] = ()
    description: str = ""
    limits: tuple[tuple[str, int], ...] = ()
    max_temp_bytes: int | None = None
    expected_policy_sha256: str | None = None

    @property
    def limited(self) -> Limits:
        """What the case is run with.  Spark spills as it needs: ``max_temp_bytes`` is recorded only."""
        return replace(Limits(), **dict(self.limits), max_temp_bytes=self.max_temp_bytes)


def positive(value: object, where: str) -> int:
    require(type(value) is int and value > 0, f"{where} must be a whole number above 0")
    return value


def read_limits(value: object, where: str) -> dict[str, int]:
    return {k: positive(x, f"{where}.{k}") for k, x in closed(value, where, set(), set(LIMITS)).items()}


def read_case(value: dict, where: str, version: int, defaults: dict[str, int]) -> Case:
    more = {"tags", "description", "limits", "execution"} if version == 2 else set()
    closed(value, where, {"id", "recipe", "baseline", "candidate"}, {"expected_policy_sha256"} | more)
    require(isinstance(value["id"], str) and bool(re.fullmatch(CASE_ID, value["id"])), f"{where}.id must be words of a-z and 0-9 with hyphens between")
    for x in ("recipe", "baseline", "candidate"):
        require(isinstance(value[x], str) and bool(value[x]) and "\0" not in value[x], f"{where}.{x} must be a locator")
        require(version == 1 or not file_of(value[x]).is_absolute(), f"{where}.{x} must be relative to the plan")
    tags = texts(value.get("tags", []), f"{where}.tags")
    require(tags == sorted(tags) and len(tags) <= 20 and all(len(t) <= 64 and re.fullmatch(CASE_ID, t) for t in tags), f"{where}.tags must be at most 20 portable words in order")
    description = value.get("description", "-")
    require(isinstance(description, str) and 0 < len(description) <= 500, f"{where}.description must have 1 to 500 characters")
    execution = closed(value.get("execution", {}), f"{where}.execution", set(), {"engine", "max_temp_bytes"})
    require(not execution or execution.get("engine") == "sqlite", f"{where}.execution.engine must be sqlite")  # the contract's only one; Spark runs it all the same
    limits = defaults | read_limits(value.get("limits", {}), f"{where}.limits")
    temp = positive(execution["max_temp_bytes"], f"{where}.execution.max_temp_bytes") if "max_temp_bytes" in execution else None
    expected = value.get("expected_policy_sha256")
    require(expected is None or bool(re.fullmatch(r"[0-9a-f]{64}", str(expected))), f"{where}.expected_policy_sha256 must be a digest")
    return Case(value["id"], value["recipe"], value["baseline"], value["candidate"], tuple(tags), value.get("description", ""), tuple(sorted(limits.items())), temp, expected)


def read_plan(value: dict) -> list[Case]:
    """The cases of a plan of version 1, or 2 with defaults, tags, limits and execution."""
    require(isinstance(value, dict) and value.get("suite_version") in (1, 2), "suite_version must be 1 or 2")
    version = value["suite_version"]
    closed(value, "suite", {"suite_version", "cases"}, {"defaults"} if version == 2 else set())
    defaults = read_limits(closed(value.get("defaults", {}), "defaults", set(), {"limits"}).get("limits", {}), "defaults.limits")
    require(isinstance(value["cases"], list) and 1 <= len(value["cases"]) <= 100, "a suite has 1 to 100 cases")
    out = [read_case(c, f"cases[{i}]", version, defaults) for i, c in enumerate(value["cases"])]
    require(len({c.id for c in out}) == len(out), "case ids must differ")
    return out


def beside(base: Path, locator: str) -> str:
    """A plan's locator, made relative to where the plan lies."""
    scheme, _, rest = locator.partition(":")
    return f"{scheme}:{base / rest}" if scheme in SCHEMES else str(base / locator)


class Workspace:
    """Results of cases in a folder, to be used again by a run that is resumed.

    A case's checkpoint says under which conditions its bundle was made: plan, case, policy,
    limits, sample and the digests of its inputs.  It is used again only if all of these
    are the same now, the bundle is whole and is the one that the checkpoint names.
    """

    def __init__(self, folder: str | Path, plan: Sequence[Case], base: Path):
        self.folder, self.base = Path(folder), base
        self.plan = digest([asdict(c) for c in plan])

    def conditions(self, case: Case) -> str:
        recipe = load_recipe(self.base / case.recipe)
        inputs = [source_digest(beside(self.base, x)) for x in (case.baseline, case.candidate)]
        return digest([self.plan, asdict(case), recipe.fingerprint, asdict(case.limited), inputs])

    def bundle(self, case: Case) -> Path:
        return self.folder / case.id

    def _checkpoint(self, case: Case) -> Path:
        return self.folder / f"{case.id}.checkpoint.json"

    def _manifest(self, case: Case) -> str:
        return hashlib.sha256((self.bundle(case) / "manifest.json").read_bytes()).hexdigest()

    def found(self, case: Case) -> dict | None:
        """The verified result of an earlier run under the same conditions; None if there is none."""
        try:
            kept = json.loads(self._checkpoint(case).read_text(encoding="utf-8"))
            result = evidence.verify(self.bundle(case))
            same = kept == {"conditions": self.conditions(case), "manifest": self._manifest(case)}
        except (OSError, ValueError, KeyError):
            return None
        return result if same and result["outcome"] not in ("ERROR", "INTERRUPTED") else None

    def keep(self, case: Case, result: dict) -> None:
        """Publish a case's bundle, in place of what an earlier run left, and then its checkpoint."""
        self._checkpoint(case).unlink(missing_ok=True)
        shutil.rmtree(self.bundle(case), ignore_errors=True)
        evidence.publish(self.bundle(case), result, load_recipe(self.base / case.recipe))
        stage = self._checkpoint(case).with_suffix(".part")
        stage.write_text(json.dumps({"conditions": self.conditions(case), "manifest": self._manifest(case)}), encoding="utf-8")
        stage.replace(self._checkpoint(case))


def run_case(spark: SparkSession, case: Case, work: Workspace) -> dict:
    """Compare a case's inputs, or take what the workspace has; its outcome, discrepancies, inputs, and whether it was taken."""
    result = work.found(case)
    reused = result is not None
    if result is None:
        recipe = load_recipe(work.base / case.recipe)
        result = compare_sources(spark, recipe, *(beside(work.base, x) for x in (case.baseline, case.candidate)), case.limited, case.expected_policy_sha256)
        work.keep(case, result)
    return {"outcome": result["outcome"], "discrepancies": result["discrepancies"], "inputs": result["inputs"], "reused": reused}


def select(cases: Sequence[Case], ids: Sequence[str] = (), tags: Sequence[str] = (), shard: tuple[int, int] = (0, 1)) -> list[Case]:
    """Cases by id, by all tags, then those of a shard (index, count) by their position."""
    unknown = set(ids) - {c.id for c in cases}
    require(not unknown, f"unknown cases: {', '.join(sorted(unknown))}")
    require(0 <= shard[0] < shard[1], "a shard is an index below its count")
    found = [c for c in cases if (not ids or c.id in ids) and set(tags) <= set(c.tags)]
    return [c for i, c in enumerate(found) if i % shard[1] == shard[0]]


def outcome_rank(outcome: str) -> int:
    return PRECEDENCE.index(outcome)


def worst(outcomes: Sequence[str]) -> str:
    return max(outcomes, key=outcome_rank, default="PASS")


def run(spark: SparkSession, cases: Sequence[Case], run_case: Callable[[Case], dict], jobs: int = 1) -> dict:
    """Run the cases in up to MOST_JOBS threads, one scheduler pool each, results in plan order.

    A case that raises becomes an ERROR result; the others go on.
    """
    require(1 <= jobs <= MOST_JOBS, f"jobs must be 1 to {MOST_JOBS}")

    def one(case: Case) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", case.id)
        spark.sparkContext.setJobGroup(f"case-{case.id}", case.id, interruptOnCancel=True)
        try:
            return {"id": case.id, **run_case(case)}
        except Exception as e:  # noqa: BLE001 - an error is the case's result
            return {"id": case.id, "outcome": "ERROR", "discrepancies": 0, "error": type(e).__name__}

    with ThreadPoolExecutor(jobs) as pool:
        results = list(pool.map(one, cases))
    return {"cases": results, "outcome": worst([r["outcome"] for r in results])}


def assemble(plan: Sequence[Case], shards: Sequence[dict]) -> dict:
    """One suite result of shards that cover the plan without overlap."""
    by_id: dict[str, dict] = {}
    for r in (r for s in shards for r in s["cases"]):
        require(r["id"] not in by_id, f"case {r['id']} is in two shards")
        by_id[r["id"]] = r
    require(set(by_id) == {c.id for c in plan}, "the shards don't cover the plan")
    results = [by_id[c.id] for c in plan]
    return {"cases": results, "outcome": worst([r["outcome"] for r in results])}


def compare(before: dict, after: dict) -> dict:
    """Each case's outcome and inputs before and after, and how often each transition occurs."""
    a, b = ({r["id"]: r for r in x["cases"]} for x in (before, after))
    rows = []
    for i in sorted(a.keys() | b.keys()):
        old, new = (x[i]["outcome"] if i in x else None for x in (a, b))
        kind = "added" if old is None else "removed" if new is None else "unchanged" if old == new else "regressed" if outcome_rank(new) > outcome_rank(old) else "improved"
        inputs = [x[i].get("inputs") if i in x else None for x in (a, b)]
        rows.append({"id": i, "before": old, "after": new, "transition": kind, "inputs_changed": None not in inputs and inputs[0] != inputs[1]})
    kinds, outcomes = Counter(r["transition"] for r in rows), Counter(f"{r['before']}->{r['after']}" for r in rows)
    return {"cases": rows, "transitions": dict(sorted(kinds.items())), "outcomes": dict(sorted(outcomes.items()))}


def rollup(cases: DataFrame) -> DataFrame:
    """Cases by outcome and the worst outcome, of (case_id, outcome), as one row."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("outcome"))
    return cases.agg(F.count(F.lit(1)).alias("cases"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in PRECEDENCE), F.coalesce(F.max_by("outcome", rank), F.lit("PASS")).alias("outcome"))
