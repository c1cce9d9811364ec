import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordance.llm import merkle as M
from concordance.llm import mixing as X
from concordance.llm import url_filters as U
from concordance.llm.queries import URL_RULES


def plain_unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def plain_poisson(u, mean):
    import math

    term = below = math.exp(-mean)
    k = 0
    while u >= below and k < 64:
        k += 1
        term = term * mean / k
        below += term
    return k


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, f"text {i}") for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_mixing_is_the_plain_replication(sources, monkeypatch, broadcast):
    monkeypatch.setattr(X, "MOST_BROADCAST", broadcast)
    rows = sources.collect()
    size = Counter(r.source for r in rows)
    weight = {s: n**0.5 for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(rows) / size[s] for s in size}
    want = Counter()
    for r in rows:
        want[r.doc_id] = plain_poisson(plain_unit("mix", "n", r.doc_id, 1), rate[r.source])
    got = X.mixed(sources, copy_col="copy").collect()
    assert Counter(r.doc_id for r in got) == +want
    assert all(sorted(c.copy for c in got if c.doc_id == i) == list(range(want[i])) for i in range(0, 2000, 97))


def test_weights_hold(sources):
    got = X.mixed(sources, {"hot": 1.0, "s1": 3.0}).groupBy("source").count().collect()
    shares = {r.source: r["count"] for r in got}
    assert set(shares) == {"hot", "s1"} and 2.5 < shares["s1"] / shares["hot"] < 3.5
    assert 1800 < sum(shares.values()) < 2200
    assert max(r["count"] for r in X.mixed(sources, {"s1": 1.0}).groupBy("doc_id").count().collect()) > 8


def test_mixing_awkward(awkward, no_docs):
    out = X.mixed(awkward, size_col="n_chars", temperature=1.0)
    assert out.columns == awkward.columns and out.count() > 0
    assert X.mixed(no_docs).count() == 0


def plain_tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    import re

    tree = [[[sha(c) for c in re.sub(r"([.!?,;|]) ", "\\1\n", p).split("\n")] for p in s.split("\n")] for s in text.split("\n\n")]
    root = sha("".join(sha("".join(sha("".join(p)) for p in s)) for s in tree))
    return root + "|" + ";".join("/".join(",".join(c[:12] for c in p) for p in s) for s in tree)


def plain_likeness(a, b):
    import re

    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(re.split("[,/;]", f[65:])) for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


@pytest.mark.parametrize("ranges", [1, 12])
def test_edits(awkward, no_docs, spark, monkeypatch, ranges):
    monkeypatch.setattr(M, "RANGES", ranges)
    for docs in (awkward, awkward.filter("doc_id = 1"), spark.createDataFrame([(i, f"a{i % 5}. b{i}é, c\n\nd 😀{i // 2}") for i in range(57)], "doc_id long, text string")):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        want = []
        for i, (known, doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][2]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            f, e, n = map(plain_tree, (text, edited, after))
            want.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, plain_likeness(f, e), plain_likeness(f, n)))
        got = [tuple(r) for r in M.edits(docs).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert M.edits(no_docs).count() == 0


def test_the_branches_locate_edits(spark):
    texts = ["a. b. c\nd\n\ne", "a. b. x\nd\n\ne"]
    f, g = (r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.fingerprint(F.col("t"))).collect())
    (s1, s2), (t1, t2) = (x[65:].split(";") for x in (f, g))
    assert s2 == t2 and s1.split("/")[1] == t1.split("/")[1] and s1.split("/")[0].split(",")[:2] == t1.split("/")[0].split(",")[:2] and f[:64] != g[:64]


RULES = [U.Rule.of(*x) for x in URL_RULES]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/1?q", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("x://example.com/de#a", "example.com", "/de", "com/", "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
        ("http://a.net/EN/1", "a.net", "/EN/1", None, "allow"),
        ("http://a.org?x/y", "a.org", "", None, "allow"),
        ("a.org/x", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.org/é#", "É.org", "/é", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = U.judge(df, RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_forms(spark):
    paths = {"/en/123.html": ["en", "{n}.html"], "/en/12/": ["en", "{n}", ""], "": [], "/": [""], "/a/deadbeef01/x": ["a", "{x}", "x"], "/1/2/3/4/5/6": ["{n}"] * 4 + ["{n}/{n}"], "/a/b/c/d/e": [*"abcde"]}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", U.templates(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in rows} == paths


def plain_tree_leaves(rows):
    """The tree of (host, forms, label) in plain Python: host and forms to (template, branch, blocked, labelled)."""
    leaves = {}
    for host, forms, label in rows:
        e = leaves.setdefault((host, forms), {"t": list(forms), "n": 0, "blocked": 0, "labelled": 0})
        e["n"] += 1
        e["blocked"] += label == 1
        e["labelled"] += label is not None
    for d in range(U.DEPTH):
        kids = Counter()
        for (host, _), e in leaves.items():
            if len(e["t"]) > d:
                kids[host, tuple(e["t"][:d]), e["t"][d]] += e["n"]
        parents, numbers = Counter(), Counter()
        for (h, p, _), n in kids.items():
            parents[h, p] += n
            numbers[h, p] += 1
        for (host, _), e in leaves.items():
            if len(e["t"]) > d:
                at = host, tuple(e["t"][:d])
                if numbers[at] > U.MOST_CHILDREN and kids[*at, e["t"][d]] * U.MOST_CHILDREN < parents[at]:
                    e["t"][d] = "*"
    nodes = {}
    for (host, _), e in leaves.items():
        for d in range(len(e["t"])):
            s = nodes.setdefault((host, tuple(e["t"][:d])), {}).setdefault(e["t"][d], {"seg": e["t"][d], "n": 0, "blocked": 0, "labelled": 0, "kids": {}})
            for x in ("n", "blocked", "labelled"):
                s[x] += e[x]
            if len(e["t"]) > d + 1:
                s["kids"][e["t"][d + 1]] = s["kids"].get(e["t"][d + 1], 0) + e["n"]
    branch = {}
    for at, siblings in nodes.items():
        each = [*siblings.values()]
        for s, i in zip(each, U.merged_siblings(each), strict=True):
            branch[*at, s["seg"]] = each[i]["seg"]
    totals = Counter()
    out = {}
    for (host, forms), e in leaves.items():
        b = tuple(branch[host, tuple(e["t"][:d]), e["t"][d]] for d in range(len(e["t"])))
        out[host, forms] = (tuple(e["t"]), b)
        totals[host, b, "blocked"] += e["blocked"]
        totals[host, b, "labelled"] += e["labelled"]
    return {k: (t, b, totals[k[0], b, "blocked"], totals[k[0], b, "labelled"]) for k, (t, b) in out.items()}


def test_tree(spark):
    r = random.Random(6)
    rows = []
    for i in range(900):
        host = r.choice(["a.com", "a.com", "b.net"])
        first = r.choice(["en", "de", "fr", "shop"])
        forms = [first, r.choice([f"slug{r.randrange(300)}", "{n}", "{n}", "index"]), *r.choice([[], [""], ["x", f"y{r.randrange(40)}", "**"]])]
        label = None if first == "fr" or r.random() < 0.3 else int(first == "shop" or (first == "de" and r.random() < 0.5))
        rows.append((host, tuple(forms), label))
    rows += [("", (), None), ("a.com", (), 1)]
    df = spark.createDataFrame([(h, list(f), x) for h, f, x in rows], "host string, forms array<string>, label int")
    got = {(r.host, tuple(r.forms)): (tuple(r.template), tuple(r.branch), r.blocked, r.labelled) for r in U.template_tree(df).collect()}
    want = plain_tree_leaves(rows)
    assert got == want
    assert any("*" in t for t, *_ in want.values()) and any(t != b for t, b, *_ in want.values())


def test_purity_rejects_templates(spark):
    urls = [(i, f"http://h.org/bad/{i}") for i in range(30)] + [(100 + i, f"http://h.org/good/{i}") for i in range(30)]
    rules = [U.Rule("block", "h.org", f"/bad/{d}") for d in (1, 2)] + [U.Rule("allow", "h.org", "/good/1")]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got[5].rule is None and got[5].verdict == "block" and got[5].purity > 0.7
    assert got[105].rule is None and got[105].verdict == "allow"


def test_urls_awkward(spark):
    rows = [(None, None, "h", 1), (1, "http://a.com/x", "h", 2), (1, "http://a.com/x", None, 2), (2, "://", "p", None), (3, "http://a.org/" + "s/" * 5000, "f", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, label int")
    got = U.judge(df, RULES)
    assert got.count() == 5 and U.judge(df.limit(0), RULES).count() == 0


def test_unlabelled_siblings_share_labels(spark):
    """On a.net the contract's rules block es and fr; en has their shape, docs has another and about has none."""
    paths = [f"{x}/{i}.html" for x in ("es", "fr", "en") for i in range(30)] + [f"docs/{i}/edit" for i in range(30)] + ["about"]
    urls = [f"http://a.net/{p}" for p in paths] + [f"http://b.org/en/{i}.html" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in U.judge(df, RULES).collect()}
    assert {got[u] for u in urls if "a.net/en/" in u} == {(None, "block")}
    assert {got[u] for u in urls if "docs/" in u or "about" in u or "b.org" in u} == {(None, "allow")}


def test_rows_without_ids_are_drawn_each_on_its_own(spark):
    """As many copies as of rows with ids, give or take five standard deviations, each with a sort key of its own."""
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    twice = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("x"), F.col("id")).alias("text"))
    own = spark.range(100, 4100).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("t").alias("text"))
    got = X.mixed(same.unionByName(twice).unionByName(own), weights={"a": 2.0, "b": 1.0}, copy_col="copy", key_col="k")
    counts = {r[0]: r[1] for r in got.groupBy("doc_id").count().filter("doc_id IS NULL OR doc_id = 7").collect()}
    assert abs(counts[None] - 4000) < 320 and abs(counts[7] - 4000) < 320
    assert got.filter("doc_id IS NULL").select("k").distinct().count() == counts[None]
    assert got.columns == ["doc_id", "source", "text", "copy", "k"]


def test_next_of_crowded_ids(spark):
    """A third without id, a third with one id: every row has the next one, in order of ids and beginnings of texts."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"{i * 7919 % 1000:04d} text") for i in range(900)] + [(None, "0000 text")] * 40
    got = M.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", {}).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1]) for r in rows))
    want = sorted((a, b[2]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(((r.id is not None, r.id or 0, r.text), r.next_text) for r in got) == want
