"""URL filters: rules first, then a path-template tree judged by labelled purity.

Per host, paths form a tree of segments.  Variable segments become wildcards: at once
where their form says so (numbers, hexadecimal names), else where a node has many
children of which each is rare.  Sibling branches whose children and labels are alike
statistically are merged, so that they share their labels.  A template is rejected
when the smoothed part of blocked pages among its labelled ones reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, staged

#: Levels of a tree.  The last one has what remains of a path, all its segments put together:
#: a wildcard stands for it where it varies, as for any other.
DEPTH = 5
#: Children of a node that stay apart: beyond so many, those with less than that part go.
MOST_CHILDREN = 16
#: Blocked and labelled pages that are added to each template's own.
PRIOR_BLOCKED, PRIOR_LABELLED = 1.0, 4.0
#: Siblings are alike if their children's shares differ by this much at most (total
#: variation), and their labels by so many standard deviations.
SHAPE_DISTANCE, LABEL_SD = 0.25, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for ``host`` and its subdomains, paths beginning with ``path``."""

    action: str
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, _, rest = text.partition("/")
        return cls(action, host, f"/{rest}")

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after ``://``, A-Z in lower case) and path (up to ``?``, ``#`` or the end); else both empty."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    pick = lambda value: reduce(lambda c, r: c.when(r.fits(host, path), F.lit(value(r))), ordered, F.when(F.lit(False), F.lit("")))
    return pick(str), pick(lambda r: r.action)


def form(segment: Column) -> Column:
    """A segment's form: numbers and hexadecimal names are wildcards, an extension stays."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]\w{0,4})?$", 1)
    extension = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]\w{0,4})?$", 2)
    kind = F.when(stem.rlike(r"^\d+$"), F.lit("{n}")).when(stem.rlike(r"^(?=.*\d)[0-9A-Fa-f-]{8,}$"), F.lit("{x}")).otherwise(stem)
    return F.concat(kind, extension)


def templates(path: Column) -> Column:
    """The forms of a path's segments, those from DEPTH on put together as one."""
    forms = F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), form)
    rest = F.array(F.array_join(F.slice(forms, DEPTH, 1 << 30), "/"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.when(F.size(forms) > DEPTH, F.concat(F.slice(forms, 1, DEPTH - 1), rest)).otherwise(forms))


def merged_siblings(siblings: list[dict]) -> list[int]:
    """For each sibling (seg, n, blocked, labelled, kids: share by segment) the index of its branch.

    Labelled siblings first and then in order of their pages, a sibling joins the first
    branch that it is alike to, whose shares and labels are then those of all its members
    together.  One without labels so gets those of a branch of like shape.
    """
    order = sorted(range(len(siblings)), key=lambda i: (siblings[i]["labelled"] == 0, -siblings[i]["n"], siblings[i]["seg"]))
    branches: list[dict] = []
    out = [0] * len(siblings)
    for i in order:
        s = siblings[i]
        for b in branches:
            if alike(s, b):
                for k, v in s["kids"].items():
                    b["kids"][k] = b["kids"].get(k, 0) + v
                for x in ("n", "blocked", "labelled"):
                    b[x] += s[x]
                out[i] = b["first"]
                break
        else:
            branches.append(s | {"kids": dict(s["kids"]), "first": i})
            out[i] = i
    return out


def alike(a: dict, b: dict) -> bool:
    """Whether children and labels are alike; where one has no labels, there must be children to tell by."""
    ta, tb = sum(a["kids"].values()) or 1, sum(b["kids"].values()) or 1
    apart = sum(abs(a["kids"].get(k, 0) / ta - b["kids"].get(k, 0) / tb) for k in a["kids"].keys() | b["kids"].keys()) / 2
    if apart > SHAPE_DISTANCE:
        return False
    if not (a["labelled"] and b["labelled"]):
        return bool(a["kids"]) or a["labelled"] == b["labelled"]
    pa_, pb = purity(a["blocked"], a["labelled"]), purity(b["blocked"], b["labelled"])
    variance = sum(p * (1 - p) / (x["labelled"] + PRIOR_LABELLED) for p, x in ((pa_, a), (pb, b)))
    return abs(pa_ - pb) <= LABEL_SD * variance**0.5


def purity(blocked: float, labelled: float) -> float:
    return (blocked + PRIOR_BLOCKED) / (labelled + PRIOR_LABELLED)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, parent, siblings) to rows (host, parent, seg, branch)."""
    for batch in batches:
        out: dict[str, list] = {"host": [], "parent": [], "seg": [], "branch": []}
        for row in batch.to_pylist():
            siblings = [x | {"kids": {k["seg"]: k["n"] for k in x["kids"] or []}} for x in row["siblings"]]
            for s, i in zip(siblings, merged_siblings(siblings), strict=True):
                for k, v in (("host", row["host"]), ("parent", row["parent"]), ("seg", s["seg"]), ("branch", siblings[i]["seg"])):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, forms, template, branch, blocked, labelled): the tree's leaves for (host, forms, label).

    ``label`` is 1 (blocked), 0 (allowed) or null.  Pages are counted by host and forms
    before anything else, so that no host's pages are gathered; nodes are joined by host
    and the whole prefix.  A node keeps at most MOST_CHILDREN + 1 children, so the siblings
    that one row holds are bounded.
    """
    leaves = pages.groupBy("host", "forms").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("blocked"), F.count("label").alias("labelled"))
    leaves = staged(leaves.withColumn("t", F.col("forms")), "leaves")
    prefix = lambda d: F.array_join(F.slice("t", 1, d), "/")
    for d in range(1, DEPTH + 1):
        here = leaves.filter(F.size("t") >= d).select("host", prefix(d - 1).alias("parent"), F.element_at("t", d).alias("seg"), "n")
        kids = here.groupBy("host", "parent", "seg").agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all")).filter(F.col("kids") > MOST_CHILDREN)
        rare = kids.join(wide, ["host", "parent"]).filter(F.col("n") * MOST_CHILDREN < F.col("all")).select("host", "parent", "seg", F.lit(True).alias("rare"))
        rows = leaves.withColumn("parent", F.when(F.size("t") >= d, prefix(d - 1))).withColumn("seg", F.get("t", F.lit(d - 1)))
        rows = rows.join(rare, ["host", "parent", "seg"], "left")
        with_star = F.concat(F.slice("t", 1, d - 1), F.array(F.lit("*")), F.slice("t", d + 1, DEPTH + 1))
        leaves = staged(rows.select("host", "forms", "n", "blocked", "labelled", F.when(F.col("rare"), with_star).otherwise(F.col("t")).alias("t")), "leaves")
    depths = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t")))).alias("d")
    steps = leaves.filter(F.size("t") > 0).select("host", "t", "n", "blocked", "labelled", depths)
    steps = steps.select("host", F.array_join(F.slice("t", F.lit(1), F.col("d") - 1), "/").alias("parent"), F.element_at("t", F.col("d")).alias("seg"), F.get("t", F.col("d")).alias("kid"), "n", "blocked", "labelled")
    by_kid = steps.groupBy("host", "parent", "seg", "kid").agg(*(F.sum(x).alias(x) for x in ("n", "blocked", "labelled")))
    kid = F.when(F.col("kid").isNotNull(), F.struct(F.col("kid").alias("seg"), "n"))
    nodes = by_kid.groupBy("host", "parent", "seg").agg(*(F.sum(x).alias(x) for x in ("n", "blocked", "labelled")), F.collect_list(kid).alias("kids"))
    siblings = nodes.groupBy("host", "parent").agg(F.collect_list(F.struct("seg", "n", "blocked", "labelled", "kids")).alias("siblings"))
    branches = in_arrow(siblings, _merge, "host string, parent string, seg string, branch string")
    merged = staged(branches.filter("seg <> branch"), "branches")
    rows = leaves.withColumn("branch", F.col("t"))
    for d in range(1, DEPTH + 1):
        on = merged.select("host", "parent", "seg", F.col("branch").alias("to"))
        rows = rows.withColumn("parent", F.when(F.size("t") >= d, prefix(d - 1))).withColumn("seg", F.get("t", F.lit(d - 1))).join(on, ["host", "parent", "seg"], "left")
        rows = rows.withColumn("branch", F.when(F.col("to").isNotNull(), F.concat(F.slice("branch", 1, d - 1), F.array("to"), F.slice("branch", d + 1, DEPTH + 1))).otherwise(F.col("branch"))).drop("parent", "seg", "to")
    rows = staged(rows.select("host", "forms", F.col("t").alias("template"), "branch", "n", "blocked", "labelled"), "leaves")
    shared = rows.groupBy("host", "branch").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    return rows.drop("n", "blocked", "labelled").join(shared, ["host", "branch"])


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity``.

    The longest rule that fits decides.  The pages that rules decide are the labelled ones
    of the template tree (``template_tree``); a page without a rule is blocked if the
    smoothed purity of its template's branch is at least ``threshold``.  A branch that has
    no labels, its merged siblings' included, has the prior's purity, 0.25.

    Null urls and urls without ``://`` have empty host and path, no rule, and the template
    of these.  Null ids and repeated rows are judged like others (each row counts as a
    page); an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), templates(F.col("path")).alias("forms"))
    label = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    tree = template_tree(rows.select("host", "forms", label.alias("label")))
    share = (F.col("blocked") + PRIOR_BLOCKED) / (F.col("labelled") + PRIOR_LABELLED)
    judged = tree.select("host", "forms", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), share.alias("purity"))
    out = rows.join(judged, ["host", "forms"])
    verdict = F.coalesce("action", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
