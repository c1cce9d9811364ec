"""Command line: comparisons, profiles, suites and evidence.

Exit codes follow the outcome: PASS 0, FAIL 1, ERROR 2, INCONCLUSIVE 3, INTERRUPTED 130.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import analysis, evidence, evolution, manifests, profile, ranges, reconcile, suites
from .catalog import Catalog
from .compare import EXIT_CODES, Limits, compare
from .parity import keyed
from .policy import PolicyError, Recipe, explain, load_recipe, require
from .scalars import parsed
from .sources import check_sizes, read_source


def session() -> SparkSession:
    return SparkSession.builder.appName("concordance").config("spark.scheduler.mode", "FAIR").getOrCreate()


def show(value: object) -> None:
    print(json.dumps(evidence.plain(value), indent=2, ensure_ascii=False))


def limits_of(a: argparse.Namespace) -> Limits:
    given = {f.name: getattr(a, f.name, None) for f in fields(Limits)}
    return replace(Limits(), **{k: v for k, v in given.items() if v is not None})


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def run_compare(a: argparse.Namespace) -> str:
    recipe = load_recipe(a.recipe)
    try:
        result = compare(session(), recipe, a.baseline, a.candidate, limits_of(a), a.expected_policy_sha256)
    except (PolicyError, KeyboardInterrupt) as e:
        outcome = "ERROR" if isinstance(e, PolicyError) else "INTERRUPTED"
        if not Path(a.output).exists():
            evidence.publish_terminal(a.output, outcome, str(e))
        raise
    evidence.publish(a.output, result, recipe)
    show({k: result[k] for k in ("outcome", "counts", "problems")})
    return result["outcome"]


def run_suite(a: argparse.Namespace) -> str:
    plan, base = suites.read_plan(read_json(a.plan)), Path(a.plan).resolve().parent
    chosen = suites.select(plan, a.case, a.tag, (a.shard_index, a.shard_count))
    spark, work = session(), suites.Workspace(a.output, plan, base)
    result = suites.run(spark, chosen, lambda case: suites.run_case(spark, case, work), a.jobs)
    work.folder.mkdir(parents=True, exist_ok=True)
    (work.folder / "suite.json").write_text(evidence.text(result), encoding="utf-8")
    show(result)
    return result["outcome"]


def assemble_suite(a: argparse.Namespace) -> str:
    result = suites.assemble(suites.read_plan(read_json(a.plan)), [read_json(f"{x}/suite.json") for x in a.shards])
    show(result)
    return result["outcome"]


def classified(a: argparse.Namespace, recipe: Recipe) -> DataFrame:
    spark = session()
    check_sizes([a.baseline, a.candidate], limits_of(a).max_input_bytes, limits_of(a).max_decoded_bytes)
    return keyed.classified(*(parsed(read_source(spark, x, recipe, i), recipe, i) for i, x in enumerate((a.baseline, a.candidate))), recipe)


def discover(a: argparse.Namespace) -> str:
    recipe, plan = load_recipe(a.recipe), ranges.RangePlan.of(read_json(a.plan))
    found = [r.asDict() for r in ranges.discover(classified(a, recipe), recipe, plan).orderBy("part").collect()]
    receipt = ranges.receipt(found, plan, recipe)
    show(receipt)
    return receipt["outcome"]


def investigate(a: argparse.Namespace) -> str:
    recipe, plan = load_recipe(a.recipe), ranges.RangePlan.of(read_json(a.plan))
    rows = classified(a, recipe)
    parts = a.part or [r["part"] for r in ranges.suspects(ranges.discover(rows, recipe, plan)).collect()]
    cases = [r.asDict() for r in ranges.investigate(rows, recipe, plan, parts, a.per_part, a.total).collect()]
    show(ranges.completeness(cases, parts, a.max_bytes))
    return "FAIL" if cases else "PASS"


def run_reconcile(a: argparse.Namespace) -> str:
    """The inputs file names, by dataset, recipe, baseline and candidate, relative to itself."""
    base, spark = Path(a.inputs).resolve().parent, session()
    inputs = {}
    for k, v in read_json(a.inputs).items():
        recipe = load_recipe(base / v["recipe"])
        inputs[k] = (recipe, *(read_source(spark, suites.beside(base, v[s]), recipe, i) for i, s in enumerate(("baseline", "candidate"))))
    result = reconcile.reconcile(read_json(a.alignment), read_json(a.reconciliation), Path(a.receipt).read_bytes(), inputs, limits_of(a))
    evidence.publish(a.output, result | {"counts": reconcile.diagnosis(result), "discrepancies": sum(reconcile.diagnosis(result).values())})
    show({"outcome": result["outcome"], "diagnosis": reconcile.diagnosis(result)})
    return result["outcome"]


def series(a: argparse.Namespace) -> str:
    """Discrepancy groups of bundles over runs, in the order given; one policy and mode."""
    results, spark = [evidence.verify(x) for x in a.bundles], session()
    require(len({r["policy"]["policy_sha256"] for r in results}) == 1, "a series is of runs under one policy")
    runs = [spark.createDataFrame([(g["kind"], g["classification"], g["name"], g["count"]) for g in r["groups"]], "kind string, classification string, name string, count long") for r in results]
    show([r.asDict() for r in analysis.series(runs).orderBy("kind", "classification", "name", "run").collect()])
    return results[-1]["outcome"]


def drill_down(a: argparse.Namespace) -> str:
    result = evidence.verify(a.bundle)
    chosen = [g for g in result["groups"] if g["group_id"] == a.group]
    require(len(chosen) == 1, "the bundle has no such group")
    g = chosen[0]
    rows = [r for r in result["sample"] if g["classification"] in (r.get("classification"), r.get("kind")) and g["name"] in ("", r.get("field"), r.get("measure"))]
    show({"group": g, "rows": rows[: a.limit], "complete": len(rows[: a.limit]) == g["count"]})
    return "PASS"


def diff_policy(a: argparse.Namespace) -> str:
    changes = evolution.read_evolution(read_json(a.evolution)) if a.evolution else []
    found = evolution.policy_diff(load_recipe(a.before), load_recipe(a.after), changes)
    show(found)
    return {"ACCEPT": "PASS", "DENY": "FAIL", "INCONCLUSIVE": "INCONCLUSIVE"}[found["decision"]]


def initialise(a: argparse.Namespace) -> str:
    """Starter files: two small inputs, a recipe and a plan that compares them."""
    folder = Path(a.folder)
    require(not folder.exists(), f"{folder} exists already")
    folder.mkdir(parents=True)
    for side, amount in (("baseline", "2.00"), ("candidate", "2.01")):
        (folder / f"{side}.csv").write_text(f"id,amount\n1,1.00\n2,{amount}\n", encoding="utf-8")
    scope = {"snapshot": "example", "cutoff": "example", "filters": [], "completeness": "full", "expected_empty": False}
    starter = {"recipe_version": 1, "comparison_mode": "keyed", "scope": scope, "keys": ["id"], "identity": {"null_keys": "reject", "duplicates": "reject"}, "nulls_equal": True, "columns": {"id": {"type": "integer"}, "amount": {"type": "decimal", "scale": 2}}}
    plan = {"suite_version": 2, "cases": [{"id": "example", "recipe": "recipe.json", "baseline": "baseline.csv", "candidate": "candidate.csv"}]}
    for name, value in (("recipe.json", starter), ("suite.json", plan)):
        (folder / name).write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    return "PASS"


def written(a: argparse.Namespace, text: str) -> str:
    with open(a.output, "x", encoding="utf-8") as f:
        f.write(text)
    return "PASS"


def validate(a: argparse.Namespace) -> str:
    recipe, spark, bad = load_recipe(a.recipe), session(), 0
    for i, locator in enumerate((a.baseline, a.candidate)):
        found = profile.preflight(read_source(spark, locator, recipe, i), recipe, i).first().asDict()
        show({locator: found})
        bad += found["invalid_fields"]
    return "FAIL" if bad else "PASS"


def draft(a: argparse.Namespace) -> str:
    spark = session()
    show(profile.draft_recipe(*(read_source(spark, x) for x in (a.baseline, a.candidate)), a.mode))
    return "PASS"


def catalog(a: argparse.Namespace) -> str:
    book = Catalog(session(), a.folder)
    if a.action in ("add", "remove"):
        getattr(book, a.action)(a.target)
    elif a.action == "history":
        show([r.asDict() for r in book.history(a.target).orderBy("added").collect()])
    else:
        show(book.states())
    return "PASS"


def shown(value: object) -> str:
    show(value)
    return "PASS"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="concordance")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in arguments:
            p.add_argument(x)
        p.set_defaults(run=run)
        return p

    def limited(p: argparse.ArgumentParser) -> None:
        for f in fields(Limits):
            if f.name.startswith("max_"):
                p.add_argument("--" + f.name.replace("_", "-"), type=int)

    p = command("compare", run_compare, "recipe", "baseline", "candidate", "output")
    p.add_argument("--expected-policy-sha256")
    p.add_argument("--sample-limit", dest="sample", type=int)
    limited(p)
    p = command("run-suite", run_suite, "plan", "output")
    p.add_argument("--case", action="append", default=[])
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("--shard-index", type=int, default=0)
    p.add_argument("--shard-count", type=int, default=1)
    p.add_argument("--jobs", type=int, default=1)
    p = command("assemble-suite", assemble_suite, "plan")
    p.add_argument("shards", nargs="+")
    command("compare-suites", lambda a: shown(suites.compare(*(read_json(f"{x}/suite.json") for x in (a.before, a.after)))), "before", "after")
    limited(command("discover", discover, "recipe", "plan", "baseline", "candidate"))
    p = command("investigate", investigate, "recipe", "plan", "baseline", "candidate")
    limited(p)
    p.add_argument("--part", action="append", type=int, default=[])
    for name, default in (("per-part", 100), ("total", 1000), ("max-bytes", 1_000_000)):
        p.add_argument(f"--{name}", type=int, default=default)
    command("verify-discovery", lambda a: ranges.verify_receipt(read_json(a.receipt), ranges.RangePlan.of(read_json(a.plan)))["outcome"], "receipt", "plan")
    limited(command("reconcile", run_reconcile, "alignment", "reconciliation", "receipt", "inputs", "output"))
    command("analyze", lambda a: shown(evidence.verify(a.bundle)["groups"]), "bundle")
    command("series", series).add_argument("bundles", nargs="+")
    p = command("drill-down", drill_down, "bundle", "group")
    p.add_argument("--limit", type=int, default=100)
    p = command("diff-policy", diff_policy, "before", "after")
    p.add_argument("--evolution")
    p = command("export", lambda a: shown({"rows": evidence.export(a.bundle, a.output, a.classification, a.kind, a.limit)}), "bundle", "output")
    p.add_argument("--classification")
    p.add_argument("--kind")
    p.add_argument("--limit", type=int, default=100)
    p = command("ci-report", lambda a: written(a, evidence.ci_report(evidence.verify(a.bundle), a.form)), "bundle", "output")
    p.add_argument("--form", choices=("markdown", "junit"), default="markdown")
    command("init", initialise, "folder")
    command("validate-recipe", lambda a: shown({"policy_sha256": load_recipe(a.recipe).fingerprint}), "recipe")
    command("explain", lambda a: shown(explain(load_recipe(a.recipe))), "recipe")
    command("validate-inputs", validate, "recipe", "baseline", "candidate")
    p = command("draft-recipe", draft, "baseline", "candidate")
    p.add_argument("--mode", choices=("keyed", "aggregate", "multiset"), default="keyed")
    command("verify", lambda a: evidence.verify(a.bundle)["outcome"], "bundle")
    command("inspect", lambda a: shown(evidence.inspect(a.bundle)), "bundle")
    command("statement", lambda a: shown(evidence.statement(a.bundle)), "bundle")
    command("validate-evolution", lambda a: shown(evolution.read_evolution(json.loads(Path(a.evolution).read_text()))), "evolution")
    command("compile-evolution", lambda a: shown(evolution.compile_mappings(evolution.read_evolution(json.loads(Path(a.evolution).read_text())))), "evolution")
    command("create-dataset-manifest", lambda a: shown(manifests.create(session(), a.root)), "root")
    command("verify-dataset-manifest", lambda a: manifests.verify(session(), json.loads(Path(a.manifest).read_text()), a.root)["outcome"], "manifest", "root")
    p = command("catalog", catalog, "folder", "action")
    p.add_argument("target", nargs="?")
    return top


def main(arguments: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
        outcome = a.run(a)
        require(outcome in EXIT_CODES, "an unknown outcome")
        return EXIT_CODES[outcome]
    except PolicyError as e:
        print(f"error: {e}", file=sys.stderr)
        return EXIT_CODES["ERROR"]
    except KeyboardInterrupt:
        return EXIT_CODES["INTERRUPTED"]


if __name__ == "__main__":
    sys.exit(main())
