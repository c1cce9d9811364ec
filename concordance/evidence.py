"""Evidence bundles: published results whose files are bound by digests."""

from __future__ import annotations

import hashlib
import html
import json
import os
import shutil
import tempfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from .policy import Recipe, canonical_json, explain, require

MEMBERS = ("result.json", "effective-recipe.json", "report.html")


def text(value: object) -> str:
    return canonical_json(value) + "\n"


def plain(value: object) -> object:
    """JSON values; decimals, dates and times as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def report(result: dict) -> str:
    """The result as a page: outcome, problems and every table of counts."""
    cell = lambda x: html.escape(str(x))
    rows = "".join(f"<tr><th>{cell(k)}<td>{cell(v)}" for k, v in result.get("counts", {}).items())
    tables = [f"<table>{rows}</table>"]
    for name in ("fields", "measures", "groups", "sample", "cases"):
        if entries := result.get(name):
            heads = list(entries[0])
            body = "".join("<tr>" + "".join(f"<td>{cell(e.get(h))}" for h in heads) for e in entries)
            tables.append(f"<h2>{name}</h2><table><tr>{''.join(f'<th>{cell(h)}' for h in heads)}{body}</table>")
    problems = "".join(f"<li>{cell(p)}" for p in result.get("problems", []))
    return f"<!doctype html><meta charset=utf-8><title>{cell(result['outcome'])}</title><h1>{cell(result['outcome'])}</h1><ul>{problems}</ul>{''.join(tables)}\n"


def publish(folder: str | Path, result: dict, recipe: Recipe | None = None) -> Path:
    """Write a bundle; it appears whole, and an existing folder is never replaced."""
    target = Path(folder)
    require(not target.exists(), f"{target} exists already")
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        result = plain(result)
        files = {"result.json": text(result), "report.html": report(result)}
        if recipe is not None:
            files["effective-recipe.json"] = text(explain(recipe))
        for name, content in files.items():
            (stage / name).write_text(content, encoding="utf-8")
        manifest = {n: hashlib.sha256(c.encode()).hexdigest() for n, c in files.items()}
        (stage / "manifest.json").write_text(text({"files": manifest, "outcome": result["outcome"]}), encoding="utf-8")
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return target


def publish_terminal(folder: str | Path, outcome: str, reason: str) -> Path:
    """A bundle for a run that ended in ERROR or INTERRUPTED."""
    require(outcome in ("ERROR", "INTERRUPTED"), "a terminal outcome is ERROR or INTERRUPTED")
    return publish(folder, {"outcome": outcome, "problems": [reason], "counts": {}, "discrepancies": 0})


def verify(folder: str | Path) -> dict:
    """The bundle's result, if all files are as published."""
    folder = Path(folder)
    manifest = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
    require({x.name for x in folder.iterdir()} == {*manifest["files"], "manifest.json"}, "the bundle's files differ from its manifest")
    for name, expected in manifest["files"].items():
        require(name in MEMBERS, f"{name} has no place in a bundle")
        require(hashlib.sha256((folder / name).read_bytes()).hexdigest() == expected, f"{name} was changed")
    result = json.loads((folder / "result.json").read_text(encoding="utf-8"))
    require(result["outcome"] == manifest["outcome"], "the outcome differs from the manifest")
    if "policy" in result and "effective-recipe.json" in manifest["files"]:
        policy = json.loads((folder / "effective-recipe.json").read_text(encoding="utf-8"))
        require(policy == result["policy"], "the policy differs from the result's")
    return result


def inspect(folder: str | Path) -> dict:
    result = verify(folder)
    return {k: result.get(k) for k in ("outcome", "mode", "counts", "problems", "discrepancies")}


def export(folder: str | Path, output: str | Path, classification: str | None = None, kind: str | None = None, limit: int = 100) -> int:
    """Sampled evidence as JSON lines; gives the number of lines."""
    rows = [r for r in verify(folder).get("sample", []) if (classification is None or r.get("classification") == classification) and (kind is None or r.get("kind") == kind)][:limit]
    with open(output, "x", encoding="utf-8") as f:
        f.writelines(text(r) for r in rows)
    return len(rows)


def ci_report(result: dict, form: str = "markdown") -> str:
    """A short report for continuous integration: markdown or JUnit."""
    require(form in ("markdown", "junit"), "a report is markdown or junit")
    cases = result.get("cases") or [{"id": result.get("mode", "comparison"), "outcome": result["outcome"], "discrepancies": result.get("discrepancies", 0)}]
    if form == "markdown":
        lines = [f"| {c['id']} | {c['outcome']} | {c.get('discrepancies', 0)} |" for c in cases]
        return "\n".join([f"**{result['outcome']}**", "", "| case | outcome | discrepancies |", "|-|-|-|", *lines]) + "\n"
    failures = sum(c["outcome"] == "FAIL" for c in cases)
    errors = sum(c["outcome"] not in ("PASS", "FAIL") for c in cases)
    body = "".join(f"<testcase name={quoteattr(c['id'])}>" + ("" if c["outcome"] == "PASS" else f"<{'failure' if c['outcome'] == 'FAIL' else 'error'}>{escape(c['outcome'])}</{'failure' if c['outcome'] == 'FAIL' else 'error'}>") + "</testcase>" for c in cases)
    return f'<testsuite name="concordance" tests="{len(cases)}" failures="{failures}" errors="{errors}">{body}</testsuite>\n'


def statement(folder: str | Path) -> dict:
    """An unsigned in-toto statement about a bundle."""
    result, folder = verify(folder), Path(folder)
    subject = [{"name": n, "digest": {"sha256": d}} for n, d in sorted(json.loads((folder / "manifest.json").read_text())["files"].items())]
    return {"_type": "https://in-toto.io/Statement/v1", "subject": subject, "predicateType": "urn:concordance:comparison:v1", "predicate": {"outcome": result["outcome"], "policy_sha256": result.get("policy", {}).get("policy_sha256"), "inputs": result.get("inputs", {})}}
