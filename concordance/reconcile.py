"""Reconciliation of several datasets: declarations, their checks, and one outcome.

An alignment declares the event window and how the snapshots belong together; a
reconciliation declares datasets and checks.  Both are closed JSON.  A run does parity of
every dataset, the window's counts, identity, references and conservation on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relations
from .compare import Limits, compare_parsed
from .policy import SIDES, Recipe, Tolerance, closed, digest, require
from .scalars import parsed

#: Modes of coordination, with the fields that each adds to the coordination and to its datasets.
MODES = {
    "source-snapshot": ((), ("snapshot_token", "token_domain")),
    "watermark": (("watermark_kind", "idle_partition_policy"), ("watermark", "allowed_lateness_seconds")),
    "declared-cutoff": ((), ()),
}
WATERMARKS = {"watermark_kind": ("closed-world", "heuristic"), "idle_partition_policy": ("not-applicable", "documented")}
#: Counters that explain a failure, by kind of check.
REASONS = {
    "identity": ("duplicate_keys", "null_key_rows"),
    "reference": ("orphan", "ambiguous", "null_failure"),
    "conservation": ("different", "child_only", "duplicate_parent", "null_measure_rows", "parent_without_children"),
}


def instant(value: object, where: str) -> datetime:
    try:
        found = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        found = None
    require(found is not None and found.tzinfo is not None, f"{where} must be a time with a zone")
    return found


def read_alignment(value: dict) -> dict:
    """The declaration with its digest."""
    closed(value, "alignment", {"alignment_version", "event_window", "coordination", "datasets"})
    require(value["alignment_version"] == 1, "alignment_version must be 1")
    window = closed(value["event_window"], "event_window", {"start", "end", "bounds"})
    require(instant(window["start"], "start") < instant(window["end"], "end"), "event_window.start must be before its end")
    require(window["bounds"] == "start-inclusive-end-exclusive", "event_window.bounds must be start-inclusive-end-exclusive")
    require(isinstance(value["coordination"], dict) and value["coordination"].get("mode") in MODES, "coordination.mode is unknown")
    mode = value["coordination"]["mode"]
    declared = closed(value["coordination"], "coordination", {"mode", "claim_id", "receipt_sha256", *MODES[mode][0]})
    for name, allowed in WATERMARKS.items():
        require(name not in declared or declared[name] in allowed, f"coordination.{name} must be {' or '.join(allowed)}")
    require(isinstance(value["datasets"], list) and bool(value["datasets"]), "an alignment has datasets")
    for d in value["datasets"]:
        closed(d, "alignment dataset", {"id", "event_time_column", *MODES[mode][1]})
        if mode == "watermark":
            instant(d["watermark"], f"the watermark of {d['id']}")
            late = d["allowed_lateness_seconds"]
            require(type(late) is int and late >= 0, f"allowed_lateness_seconds of {d['id']} must be a whole number of at least 0")
    require(len({d["id"] for d in value["datasets"]}) == len(value["datasets"]), "an alignment names a dataset once")
    return value | {"alignment_sha256": digest(value)}


def read_reconciliation(value: dict, recipes: dict[str, Recipe]) -> dict:
    """The declaration, if it agrees with the recipes and its checks with each other."""
    closed(value, "reconciliation", {"reconciliation_version", "alignment_sha256", "datasets", "checks"})
    require(value["reconciliation_version"] == 1, "reconciliation_version must be 1")
    types: dict[str, dict[str, str]] = {}
    for d in value["datasets"]:
        closed(d, "dataset", {"id", "policy_sha256", "columns"})
        require(d["id"] in recipes and d["id"] not in types, f"dataset {d['id']} is unknown or repeated")
        require(recipes[d["id"]].fingerprint == d["policy_sha256"], f"dataset {d['id']} has another policy")
        types[d["id"]] = {c["name"]: c["type"] for c in d["columns"]}
        for name, kind in types[d["id"]].items():
            field = recipes[d["id"]].columns.get(name)
            require(field is not None and field.type == kind, f"column {name} of {d['id']} isn't {kind}")
    identities = {c["id"]: c for c in value["checks"] if c.get("kind") == "identity"}
    require(len({c["id"] for c in value["checks"]}) == len(value["checks"]), "check ids must differ")

    def same(a: str, left: list[str], b: str, right: list[str]) -> None:
        kinds = [[types[d][c] for c in cols if c in types[d]] for d, cols in ((a, left), (b, right))]
        require(len(kinds[0]) == len(left) == len(right) and kinds[0] == kinds[1], "columns that meet must have the same types")
        scales = [[recipes[d].columns[c].scale for c in cols] for d, cols in ((a, left), (b, right))]
        require(scales[0] == scales[1], "decimal columns that meet must have the same scale")

    links = []
    for c in value["checks"]:
        kind = c["kind"]
        require(kind in REASONS and c.get("nulls") in relations.NULL_RULES[kind], f"check {c['id']} has an unknown kind or null rule")
        if kind == "identity":
            same(c["dataset"], c["columns"], c["dataset"], c["columns"])
            continue
        parent = identities.get(c["parent_identity"])
        require(parent is not None, f"check {c['id']} must name an identity check of its parent")
        if kind == "reference":
            same(c["child_dataset"], c["child_columns"], parent["dataset"], parent["columns"])
        else:
            require(c["parent_dataset"] == parent["dataset"] and c["parent_group_columns"] == parent["columns"], f"check {c['id']} must group its parent by its identity")
            same(c["child_dataset"], c["child_group_columns"], c["parent_dataset"], c["parent_group_columns"])
            same(c["child_dataset"], [c["child_measure"]], c["parent_dataset"], [c["parent_measure"]])
            require(c["operator"] == "sum" and types[c["parent_dataset"]][c["parent_measure"]] in ("integer", "decimal"), f"check {c['id']} must sum integers or decimals")
            require(c["comparison"] in ("exact", "tolerance"), f"check {c['id']} compares exactly or by a tolerance")
            require((c["comparison"] == "tolerance") == (c["tolerance"] is not None), f"check {c['id']} has a tolerance if it compares by one")
        links.append((c["child_dataset"], parent["dataset"]))
    require(relations.acyclic(links), "datasets refer to each other in a circle")
    return value


def checked(check: dict, frames: dict[str, DataFrame], recipes: dict[str, Recipe], identities: dict[str, dict], limits: Limits = Limits()) -> dict:
    """One check on one side: kind, counts and outcome; more keys or groups than the limits allow are an error."""
    kind = check["kind"]
    if kind == "identity":
        counts = relations.identity(frames[check["dataset"]], check["columns"], check["nulls"]).first().asDict()
        require(counts["distinct_keys"] <= limits.max_identity_keys, f"check {check['id']} has more than max_identity_keys keys")
        failed = counts["failures"] > 0
    elif kind == "reference":
        parent = identities[check["parent_identity"]]
        counts = relations.reference(frames[check["child_dataset"]], check["child_columns"], frames[parent["dataset"]], parent["columns"], check["nulls"]).first().asDict()
        failed = any(counts[x] for x in REASONS[kind])
    else:
        field = recipes[check["parent_dataset"]].columns[check["parent_measure"]]
        tolerance = Tolerance.of(check["tolerance"], check["id"]) if check["tolerance"] else None
        groups = relations.conservation_groups(frames[check["parent_dataset"]], check["parent_group_columns"], check["parent_measure"], frames[check["child_dataset"]], check["child_group_columns"], check["child_measure"], field.type, field.scale or 0, tolerance)
        counts = relations.conservation(groups).first().asDict()
        require(counts["groups"] <= limits.max_conservation_groups, f"check {check['id']} has more than max_conservation_groups groups")
        nulls = counts["null_measure_rows"] if check["nulls"] == "forbid" else 0
        failed = bool(nulls or any(counts[x] for x in ("different", "child_only", "duplicate_parent")))
    return {"id": check["id"], "kind": kind, "counts": counts, "outcome": "FAIL" if failed else "PASS"}


#: By kind of check: the dataset whose rows are counted, by the counter; and counters that add up to another, with what they add up to.
COUNTED = {"identity": {"rows": "dataset"}, "reference": {"child_rows": "child_dataset"}, "conservation": {"parent_rows": "parent_dataset", "child_rows": "child_dataset"}}
ADD_UP = {"reference": {"child_rows": ("exempt", "matched", "orphan", "ambiguous", "null_failure")}, "conservation": {"groups": ("exact", "within_tolerance", "different", "child_only", "duplicate_parent")}}
#: By kind of check: counters that are at most another.
AT_MOST = {
    "identity": (("null_key_rows", "rows"), ("duplicate_keys", "distinct_keys"), ("distinct_keys", "rows")),
    "conservation": (("parent_without_children", "groups"), ("duplicate_parent", "parent_rows"), ("child_only", "child_rows")),
}


def verify_counts(check: dict, found: dict, rows: dict[str, int]) -> None:
    """Whether a check's published counts can be true together, given the datasets' rows; else an error.

    Counters are whole and not negative, those of rows are the dataset's, parts add up to
    their whole, null rules and exact comparison leave no counts that they exclude, and the
    outcome is what the counts say.
    """
    kind, n = check["kind"], found["counts"]
    wrong = [f"{k} is no count" for k, x in n.items() if type(x) is not int or x < 0]
    wrong += [f"{c} isn't the rows of {check[d]}" for c, d in COUNTED[kind].items() if c in n and n[c] != rows[check[d]]]
    wrong += [f"{whole} isn't the sum of its parts" for whole, parts in ADD_UP.get(kind, {}).items() if n[whole] != sum(n[x] for x in parts)]
    wrong += [f"{a} is more than {b}" for a, b in AT_MOST.get(kind, ()) if b in n and n[a] > n[b]]
    never = {"reference": {"forbid": ("exempt",), "match-null": ("exempt", "null_failure"), "all-null-exempt": ()}}.get(kind, {}).get(check["nulls"], ())
    never += ("within_tolerance",) if kind == "conservation" and check["comparison"] == "exact" else ()
    wrong += [f"{x} can't be counted here" for x in never if n[x]]
    if kind == "identity":
        wrong += ["distinct and duplicate keys contradict the rows"] if (n["duplicate_keys"] == 0) != (n["distinct_keys"] == n["rows"]) else []
    decisive = {"identity": ("failures",), "reference": REASONS["reference"], "conservation": ("different", "child_only", "duplicate_parent", *(("null_measure_rows",) if check["nulls"] == "forbid" else ()))}[kind]
    wrong += ["the outcome isn't what the counts say"] if (found["outcome"] == "FAIL") != any(n[x] for x in decisive) else []
    require(not wrong, f"check {check['id']}: {'; '.join(wrong)}")


def aligned(alignment: dict, receipt: bytes, frames: dict[str, tuple[DataFrame, DataFrame]]) -> dict:
    """The window's counts by dataset and side, and whether the declaration holds."""
    window, coordination = alignment["event_window"], alignment["coordination"]
    start, end = (F.lit(window[x]).cast("timestamp") for x in ("start", "end"))
    counts = {d["id"]: {s: relations.window_counts(frames[d["id"]][i], d["event_time_column"], start, end).first().asDict() for i, s in enumerate(SIDES)} for d in alignment["datasets"]}
    outside = any(c["rows"] != c["in_window"] for by in counts.values() for c in by.values())
    holds, doubt = relations.coordination(alignment)
    bound = hashlib.sha256(receipt).hexdigest() == coordination.get("receipt_sha256")
    reasons = [n for n, x in (("event-time-scope-failed", outside), ("receipt-mismatch", not bound), (doubt, doubt)) if x]
    return {"counts": counts, "reason_codes": sorted(reasons), "outcome": relations.outcome(outside or not holds or not bound, doubt is not None)}


def reconcile(alignment: dict, reconciliation: dict, receipt: bytes, inputs: dict[str, tuple[Recipe, DataFrame, DataFrame]], limits: Limits = Limits(sample=0), progress: Callable[[str], None] = lambda _: None) -> dict:
    """Run everything; FAIL comes before INCONCLUSIVE before PASS.

    Each dataset's sides are parsed once and kept for all checks.
    """
    recipes = {k: v[0] for k, v in inputs.items()}
    alignment = read_alignment(alignment)
    read_reconciliation(reconciliation, recipes)
    require(reconciliation["alignment_sha256"] == alignment["alignment_sha256"], "the reconciliation is bound to another alignment")
    require({d["id"] for d in alignment["datasets"]} == {d["id"] for d in reconciliation["datasets"]} == set(inputs), "the declarations and inputs must have the same datasets")
    frames = {k: tuple(parsed(df, r, i).persist() for i, df in enumerate(sides)) for k, (r, *sides) in inputs.items()}
    try:
        progress("alignment")
        window = aligned(alignment, receipt, frames)
        parity = {}
        for k, (r, *_) in inputs.items():
            progress(f"parity {k}")
            parity[k] = compare_parsed(r, *frames[k], limits)
        identities = {c["id"]: c for c in reconciliation["checks"] if c["kind"] == "identity"}
        checks = {}
        for i, side in enumerate(SIDES):
            progress(f"checks {side}")
            checks[side] = [checked(c, {k: f[i] for k, f in frames.items()}, recipes, identities, limits) for c in reconciliation["checks"]]
            rows = {k: by[side]["rows"] for k, by in window["counts"].items()}
            for c, found in zip(reconciliation["checks"], checks[side], strict=True):
                verify_counts(c, found, rows)
    finally:
        for f in (x for pair in frames.values() for x in pair):
            f.unpersist()
    outcomes = [window["outcome"], *(p["outcome"] for p in parity.values()), *(c["outcome"] for by in checks.values() for c in by)]
    return {"alignment": window, "datasets": parity, "checks": checks, "outcome": relations.outcome("FAIL" in outcomes, "INCONCLUSIVE" in outcomes)}


def diagnosis(result: dict) -> dict[str, int]:
    """How often each reason occurs, over both sides."""
    out = {f"{k}_{n}": 0 for k, names in REASONS.items() for n in names}
    for c in (c for by in result["checks"].values() for c in by):
        for n in REASONS[c["kind"]]:
            out[f"{c['kind']}_{n}"] += c["counts"][n]
    return out
