"""Rehearsals of a migration, the inputs that they are bound to, and what decides on them.

A rehearsal does range discovery of every dataset and the relations between them on both
sides.  Its receipt is bound to policies, plans and inputs by their digests; a dossier
binds a receipt to exceptions and sign-offs, which people give, and decides nothing itself.
"""

from __future__ import annotations

import html
import json
import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import evidence, manifests, ranges, reconcile
from .parity import keyed
from .policy import SIDES, Recipe, closed, digest, explain, require, texts
from .relations import outcome
from .scalars import parsed
from .sources import digest as source_digest
from .sources import file_of

BINDING = {"id", "role", "source_kind", "selection", "source_sha256", "policy_sha256"}
DISPOSITIONS = ("open", "accepted", "resolved")


def bindings(kind: str, policy_sha256: str, inputs: dict[str, tuple[Recipe, str, str]]) -> dict:
    """Which sources stand for which ids and roles, by digest, under one policy."""
    found = []
    for name, (recipe, *locators) in sorted(inputs.items()):
        for role, locator in zip(SIDES, locators, strict=True):
            selection = locator.partition("#")[2] or None
            found.append({"id": name, "role": role, "source_kind": "partition" if file_of(locator).is_dir() else "file", "selection": selection, "source_sha256": source_digest(locator), "policy_sha256": recipe.fingerprint})
    return read_bindings({"binding_version": 1, "policy": {"kind": kind, "sha256": policy_sha256}, "bindings": found})


def read_bindings(value: dict) -> dict:
    """The bindings by id and role; one for each, of known kinds, with digests."""
    closed(value, "bindings", {"binding_version", "policy", "bindings"})
    policy = closed(value["policy"], "policy", {"kind", "sha256"})
    require(value["binding_version"] == 1 and policy["kind"] in ("suite", "reconciliation"), "bindings must be version 1, of a suite or a reconciliation")
    for b in value["bindings"]:
        closed(b, "binding", BINDING)
        require(b["role"] in SIDES and b["source_kind"] in ("file", "partition"), "a binding has a role and a kind of source")
        require(all(len(b[x]) == 64 for x in ("source_sha256", "policy_sha256")), "a binding has digests")
    order = sorted(value["bindings"], key=lambda b: (b["id"], b["role"]))
    require(0 < len(order) == len({(b["id"], b["role"]) for b in order}), "each id and role is bound once")
    return value | {"bindings": order}


def bound_manifest(spark: SparkSession, root: str | Path, bound: dict, recipe: Recipe | None = None) -> dict:
    """A manifest of version 2: files with their digests, and the logical inputs that they are."""
    body = {k: v for k, v in manifests.create(spark, root, recipe).items() if k != "manifest_sha256"}
    body |= {"manifest_version": 2, "bindings": read_bindings(bound)}
    return body | {"manifest_sha256": digest(body)}


def publish_dataset_evidence(spark: SparkSession, folder: str | Path, manifest: dict, root: str | Path, recipe: Recipe, bundle: str | Path) -> dict:
    """One bundle of a manifest's verification, the policy, the runtime's facts and a verified result under that policy."""
    result = evidence.verify(bundle)
    require(result.get("policy", {}).get("policy_sha256") == recipe.fingerprint == manifest["policy_sha256"], "manifest, policy and result must belong together")
    checked = manifests.verify(spark, manifest, root)
    body = {"manifest": manifest, "verification": checked, "effective_policy": explain(recipe), "diagnostic": manifests.reproducibility(), "semantic_result": {"outcome": result["outcome"], "sha256": digest(result)}}
    body["outcome"] = outcome(checked["outcome"] == "FAIL" or result["outcome"] == "FAIL", result["outcome"] not in ("PASS", "FAIL"))
    target = evidence.publish(folder, body | {"counts": checked["states"], "problems": [], "discrepancies": result["discrepancies"]})
    shutil.copytree(bundle, target.with_name(target.name + ".result"))
    return body


def verify_dataset_evidence(folder: str | Path) -> dict:
    """The evidence, if its parts and the result beside it are as published."""
    body, result = evidence.verify(folder), evidence.verify(Path(folder).with_name(Path(folder).name + ".result"))
    require(body["semantic_result"] == {"outcome": result["outcome"], "sha256": digest(result)}, "the result isn't the one that the evidence names")
    named = {k: v for k, v in body["manifest"].items() if k != "manifest_sha256"}
    require(digest(named) == body["manifest"]["manifest_sha256"], "the manifest was changed")
    return body


def rehearse(inputs: dict[str, tuple[Recipe, DataFrame, DataFrame]], plans: dict[str, ranges.RangePlan], checks: Sequence[dict]) -> dict:
    """Discovery of every dataset by its plan, and the checks on both sides; a receipt."""
    require(set(plans) == set(inputs), "every dataset has a partition plan")
    recipes = {k: v[0] for k, v in inputs.items()}
    frames = {k: tuple(parsed(df, r, i) for i, df in enumerate(sides)) for k, (r, *sides) in inputs.items()}
    discovery = {}
    for k, r in recipes.items():
        rows = ranges.discover(keyed.classified(*frames[k], r), r, plans[k])
        discovery[k] = ranges.receipt([x.asDict() for x in rows.orderBy("part").collect()], plans[k], r)
    identities = {c["id"]: c for c in checks if c["kind"] == "identity"}
    relations = {s: [reconcile.checked(c, {k: f[i] for k, f in frames.items()}, recipes, identities) for c in checks] for i, s in enumerate(SIDES)}
    outcomes = [d["outcome"] for d in discovery.values()] + [c["outcome"] for by in relations.values() for c in by]
    body = {"policies": {k: r.fingerprint for k, r in recipes.items()}, "checks": list(checks), "discovery": discovery, "relations": relations, "outcome": outcome("FAIL" in outcomes, False)}
    return body | {"rehearsal_sha256": digest(evidence.plain(body))}


def verify_rehearsal(value: dict, plans: dict[str, ranges.RangePlan]) -> dict:
    """The receipt, if it is as published, its discoveries verify and its counts can be true."""
    body = {k: v for k, v in value.items() if k != "rehearsal_sha256"}
    require(digest(evidence.plain(body)) == value.get("rehearsal_sha256"), "the rehearsal was changed")
    for k, found in body["discovery"].items():
        require(ranges.verify_receipt(found, plans[k])["policy_sha256"] == body["policies"][k], f"the discovery of {k} has another policy")
    for i, side in enumerate(SIDES):
        rows = {k: d["totals"][SIDES[i]] for k, d in body["discovery"].items()}
        for c, found in zip(body["checks"], body["relations"][side], strict=True):
            reconcile.verify_counts(c, found, rows)
    return value


def dossier(rehearsal: dict, exceptions: Sequence[dict] = (), signoffs: Sequence[dict] = ()) -> dict:
    """A rehearsal with exceptions (id, reason, disposition) and sign-offs (by, role): what is still open, not a decision."""
    for e in exceptions:
        require(closed(e, "exception", {"id", "reason", "disposition"})["disposition"] in DISPOSITIONS, "an exception is open, accepted or resolved")
    texts([e["id"] for e in exceptions], "exceptions")
    for s in signoffs:
        closed(s, "signoff", {"by", "role"})
    body = {"rehearsal_sha256": rehearsal["rehearsal_sha256"], "outcome": rehearsal["outcome"], "exceptions": list(exceptions), "signoffs": list(signoffs)}
    body |= {"open": sum(e["disposition"] == "open" for e in exceptions), "authorization": "external-required"}
    return body | {"dossier_sha256": digest(body)}


def verify_dossier(value: dict, rehearsal: dict, plans: dict[str, ranges.RangePlan]) -> dict:
    """The dossier, if the rehearsal that it names verifies and it says of it what it would say now."""
    verify_rehearsal(rehearsal, plans)
    require(dossier(rehearsal, value["exceptions"], value["signoffs"]) == value, "the dossier was changed, or is of another rehearsal")
    return value


def cover_sheet(title: str, results: dict[str, dict]) -> str:
    """A page for a cutover: the worst outcome first, then a line for each bundle, by its policy."""
    cell = lambda x: html.escape(str(x))
    order = sorted(results, key=lambda k: (results[k]["outcome"] == "PASS", k))
    rows = "".join(f"<tr><td>{cell(k)}<td>{cell(results[k]['outcome'])}<td>{cell(results[k].get('discrepancies', 0))}<td><code>{cell(results[k].get('policy', {}).get('policy_sha256', ''))}</code>" for k in order)
    return f"<!doctype html><meta charset=utf-8><title>{cell(title)}</title><h1>{cell(title)}</h1><table><tr><th>bundle<th>outcome<th>discrepancies<th>policy{rows}</table><p>{cell(json.dumps({o: sum(r['outcome'] == o for r in results.values()) for o in sorted({r['outcome'] for r in results.values()})}))}\n"
