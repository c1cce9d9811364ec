"""Semantics of recipes, scalars, parity and the rest, case by case."""

import copy
import json
import sqlite3
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concordance import analysis, cli, evidence, evolution, manifests, profile, ranges, reconcile, rehearsal, relations, suites
from concordance.catalog import Catalog
from concordance.compare import Limits, compare, compare_frames
from concordance.parity import aggregate, keyed, multiset
from concordance.policy import PolicyError, Tolerance, check_lock, explain, load_recipe, parse_recipe
from concordance.scalars import parsed
from concordance.sources import digest, read_source

SCOPE = {"snapshot": "s", "cutoff": "c", "filters": [], "completeness": "full", "expected_empty": False}
CENT = {"formula": "symmetric-v1", "absolute": "0.01", "relative": "0"}
KEYED = {
    "recipe_version": 1,
    "comparison_mode": "keyed",
    "keys": ["id"],
    "scope": SCOPE,
    "identity": {"null_keys": "reject", "duplicates": "reject"},
    "nulls_equal": True,
    "columns": {"id": {"type": "string"}, "v": {"type": "decimal", "scale": 2, "comparison": "numeric", "tolerance": CENT}},
}


def recipe(**more):
    return parse_recipe(copy.deepcopy(KEYED | more))


def of_type(kind, **more):
    return recipe(columns={"id": {"type": "string"}, "v": {"type": kind, **more}})


def texts(spark, rows, names=("id", "v")):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def result(spark, left, right, r=None, **limits):
    return compare_frames(r or recipe(), texts(spark, left), texts(spark, right), Limits(**limits))


@pytest.mark.parametrize(
    "change",
    [
        {"recipe_version": 9},
        {"comparison_mode": "aggregate"},
        {"keys": []},
        {"keys": ["id", "id"]},
        {"keys": ["other"]},
        {"unknown": 1},
        {"nulls_equal": None},
        {"identity": {"null_keys": "reject", "duplicates": "keep"}},
        {"scope": SCOPE | {"completeness": "partial"}},
        {"scope": SCOPE | {"expected_empty": 1}},
        {"columns": {"id": {"type": "text"}}},
        {"columns": {"id": {"type": "string", "scale": 1}}},
        {"columns": {"id": {"type": "decimal"}}},
        {"columns": {"id": {"type": "timestamp"}}},
        {"columns": {"id": {"type": "integer", "comparison": "numeric", "tolerance": CENT}}},
        {"columns": {"id": {"type": "string"}, "v": {"type": "string", "comparison": "numeric", "tolerance": CENT}}},
        {"columns": {"id": {"type": "string"}, "v": {"type": "float", "comparison": "numeric", "tolerance": CENT | {"absolute": "-1"}}}},
        {"columns": {"id": {"type": "string"}, "v": {"type": "float", "comparison": "numeric", "tolerance": CENT | {"absolute": "NaN"}}}},
        {"columns": {"id": {"type": "string", "normalize": ["trim", "trim"]}}},
        {"columns": {"id": {"type": "integer", "normalize": ["trim"]}}},
        {"excluded_columns": {"v": "why"}},
        {"excluded_columns": {"w": ""}},
        {"column_mappings": {"v": {"baseline": "id", "candidate": "v"}}},
        {"delimiters": {"baseline": ",,", "candidate": ","}},
        {"null_tokens": {"baseline": [""], "candidate": []}},
        {"output": {"sensitivity": "full"}},
    ],
)
def test_recipes_that_are_refused(change):
    with pytest.raises(PolicyError):
        recipe(**change)


def test_policy_lock_and_fingerprint():
    r = recipe()
    assert r.fingerprint == recipe(output={"sensitivity": "summary"}).fingerprint != recipe(nulls_equal=False).fingerprint
    assert explain(r)["policy_sha256"] == r.fingerprint
    check_lock(r, r.fingerprint)
    with pytest.raises(PolicyError):
        check_lock(r, "0" * 64)


def test_published_fingerprint():
    """A recipe whose fingerprint was published by others for the same canonical policy."""
    source = {"recipe_version": 3, "comparison_mode": "multiset", "scope": SCOPE, "columns": {"b": {"type": "string"}, "a": {"type": "integer"}}}
    policy = explain(parse_recipe(source))
    assert policy["column_order"] == ["a", "b"] and policy["nulls_equal"] is True
    assert policy["columns"]["a"] == {"type": "integer", "normalize": [], "comparison": "exact", "baseline_column": "a", "candidate_column": "a"}


ADMITTED = {
    "integer": {"1": 1, "-007": -7, "9007199254740993": 9007199254740993, "": None},
    "decimal": {"1.10": Decimal("1.10"), ".5": Decimal("0.50"), "1e-2": Decimal("0.01"), "1.500": Decimal("1.50"), "": None},
    "float": {"1.5": 1.5, "-0.0": 0.0, "1e300": 1e300},
    "boolean": {"true": True, "false": False},
}
REFUSED = {
    "integer": ["1.0", "1_000", "x", " 1"],
    "decimal": ["1.001", "NaN", "1,5", "1e-3"],
    "float": ["NaN", "Infinity", "1e999", "x"],
    "boolean": ["TRUE", "t", "1"],
    "date": ["2026-1-1", "2026-02-30", "x"],
    "timestamp": ["2026-01-01T00:00:00", "2026-01-01T00:00:00.1234567Z", "2026-01-01"],
}
EXTRA = {"decimal": {"scale": 2}, "timestamp": {"timezone": "require-aware"}}


@pytest.mark.parametrize("kind", sorted(ADMITTED))
def test_admitted_text(spark, kind):
    r = of_type(kind, **EXTRA.get(kind, {}))
    got = parsed(texts(spark, list(ADMITTED[kind].items())[:0] + [(k, k) for k in ADMITTED[kind]]), r, 0).collect()
    assert {x.id: x.v for x in got} == ADMITTED[kind]


@pytest.mark.parametrize("kind", sorted(REFUSED))
def test_refused_text(spark, kind):
    r = of_type(kind, **EXTRA.get(kind, {}))
    df = texts(spark, [(x, x) for x in REFUSED[kind]])
    assert profile.preflight(df, r, 0).first().invalid_v == len(REFUSED[kind])
    with pytest.raises(Exception, match="column v holds") as e:
        parsed(df, r, 0).collect()
    assert REFUSED[kind][0] not in str(e.value).splitlines()[0]


def test_instants_and_folding(spark):
    r = of_type("timestamp", timezone="require-aware")
    assert result(spark, [("a", "2026-01-01T02:00:00+02:00")], [("a", "2026-01-01T00:00:00Z")], r)["outcome"] == "PASS"
    r = of_type("string", normalize=["trim", "casefold", "unicode_nfc"])
    assert result(spark, [("a", " Straße é\t")], [("a", "STRASSE é")], r)["outcome"] == "PASS"
    assert result(spark, [("a", "x")], [("a", " x")], of_type("string"))["outcome"] == "FAIL"


def test_native_columns(spark):
    r = of_type("timestamp", timezone="require-aware")
    naive = spark.sql("SELECT 'a' AS id, TIMESTAMP_NTZ '2026-01-01' AS v")
    with pytest.raises(PolicyError):
        parsed(naive, r, 0)
    nested = spark.sql("SELECT 'a' AS id, array(1) AS v")
    with pytest.raises(PolicyError):
        parsed(nested, of_type("string"), 0)
    with pytest.raises(PolicyError):
        parsed(spark.sql("SELECT 'a' AS id, 1 AS v, 2 AS w"), of_type("integer"), 0)


@pytest.mark.parametrize(
    ("left", "right", "outcome"),
    [
        ([("a", "1.00")], [("a", "1.01")], "PASS"),
        ([("a", "1.00")], [("a", "1.02")], "FAIL"),
        ([("a", "-1.00")], [("a", "-1.01")], "PASS"),
        ([("a", "1")], [("b", "1")], "FAIL"),
        ([("a", "")], [("a", "")], "PASS"),
        ([("a", "")], [("a", "0")], "FAIL"),
        ([("a", "1"), ("a", "1")], [("a", "1")], "INCONCLUSIVE"),
        ([(None, "1")], [("a", "1")], "INCONCLUSIVE"),
        ([], [("a", "1")], "INCONCLUSIVE"),
        ([], [], "INCONCLUSIVE"),
        ([("01", "1")], [("1", "1")], "FAIL"),
    ],
)
def test_keyed_outcomes(spark, left, right, outcome):
    got = result(spark, left, right)
    back = result(spark, right, left)
    assert got["outcome"] == back["outcome"] == outcome
    assert (got["counts"]["baseline_only"], got["counts"]["candidate_only"]) == (back["counts"]["candidate_only"], back["counts"]["baseline_only"])
    c = got["counts"]
    if outcome != "INCONCLUSIVE":
        assert c["common_keys"] == c["matched_exact"] + c["matched_within_tolerance"] + c["matched_with_required_difference"]


def test_empty_where_expected(spark):
    r = recipe(scope=SCOPE | {"expected_empty": True})
    assert result(spark, [], [], r)["outcome"] == "PASS"


def test_nulls_distinct_and_float_text(spark):
    assert result(spark, [("a", "")], [("a", "")], recipe(nulls_equal=False))["outcome"] == "FAIL"
    r = of_type("float", comparison="numeric", tolerance=CENT)
    assert result(spark, [("a", "0.30")], [("a", "0.29")], r)["outcome"] == "PASS"


def test_typed_keys_are_not_joined_text(spark):
    r = recipe(keys=["a", "b"], columns={"a": {"type": "string"}, "b": {"type": "string"}})
    left, right = texts(spark, [("a|b", "c")], ("a", "b")), texts(spark, [("a", "b|c")], ("a", "b"))
    got = compare_frames(r, left, right)
    assert got["counts"]["common_keys"] == 0 and got["outcome"] == "FAIL"


def test_raw_sample_is_ordered_and_bounded(spark):
    r = recipe(output={"sensitivity": "raw"})
    left = [("a", "1"), ("b", "2"), ("c", "3"), ("z", "1")]
    right = [("b", "2.01"), ("c", "9"), ("y", "1"), ("z", "1")]
    got = result(spark, left, right, r)["sample"]
    assert [(x["kind"], x["key_id"]) for x in got] == [("baseline_only", "a"), ("candidate_only", "y"), ("field", "b"), ("field", "c")]
    assert [x["classification"] for x in got[2:]] == ["within_tolerance", "different"]
    assert len(result(spark, left, right, r, sample=2)["sample"]) == 2
    assert result(spark, left, right)["sample"] == []


def test_limits_fail_closed(spark):
    with pytest.raises(PolicyError):
        result(spark, [("a", "1"), ("b", "1")], [("a", "1")], max_rows=1)


AGGREGATE = {"recipe_version": 2, "comparison_mode": "aggregate", "group_by": ["g"], "measures": {"n": {"operator": "count"}, "s": {"operator": "sum", "column": "v", "nulls": "reject", "comparison": "numeric", "tolerance": CENT}, "m": {"operator": "max", "column": "v", "nulls": "ignore"}}, "scope": SCOPE, "columns": {"g": {"type": "string"}, "v": {"type": "decimal", "scale": 2}}}


@pytest.mark.parametrize(
    ("left", "right", "outcome"),
    [
        ([("x", "1"), ("x", "2")], [("x", "2"), ("x", "1")], "PASS"),
        ([("x", "1"), ("x", "-1")], [("x", "5"), ("x", "-5")], "FAIL"),
        ([("x", "1.00")], [("x", "1.01")], "FAIL"),
        ([("x", "1")], [("y", "1")], "FAIL"),
        ([("x", "")], [("x", "")], "INCONCLUSIVE"),
        ([(None, "1"), ("x", "1")], [("x", "1")], "INCONCLUSIVE"),
        ([], [("x", "1")], "INCONCLUSIVE"),
    ],
)
def test_aggregate_outcomes(spark, left, right, outcome):
    r = parse_recipe(copy.deepcopy(AGGREGATE))
    sides = [texts(spark, x, ("g", "v")) for x in (left, right)]
    assert compare_frames(r, *sides)["outcome"] == outcome


def test_global_group_of_no_rows(spark):
    r = parse_recipe(AGGREGATE | {"group_by": []})
    got = aggregate.grouped(parsed(texts(spark, [], ("g", "v")), r, 0), r).collect()
    assert len(got) == 1 and got[0].v_n == 0 and got[0].v_s is None


MULTISET = {"recipe_version": 3, "comparison_mode": "multiset", "scope": SCOPE, "columns": {"a": {"type": "string"}, "b": {"type": "float"}}}


def test_multiset(spark):
    r = parse_recipe(MULTISET | {"output": {"sensitivity": "raw"}})
    left = texts(spark, [("x", "0.0"), ("x", "-0.0"), ("y", "1"), (None, "")], ("a", "b"))
    right = texts(spark, [("x", "0"), (None, ""), (None, ""), ("z", "2")], ("a", "b"))
    got = compare_frames(r, left, right)
    c = got["counts"]
    assert (c["common_rows"], c["baseline_surplus_rows"], c["candidate_surplus_rows"]) == (2, 2, 2) and got["outcome"] == "FAIL"
    assert c["baseline_rows"] == c["common_rows"] + c["baseline_surplus_rows"]
    assert [x["a"] for x in got["sample"]] == [None, "x", "y", "z"]
    assert compare_frames(r, left, left)["outcome"] == "PASS"
    assert compare_frames(r, left.limit(0), right)["outcome"] == "FAIL"
    assert compare_frames(r, left.limit(0), left.limit(0))["outcome"] == "INCONCLUSIVE"
    exact = [parsed(x, r, 0) for x in (left, right)]
    assert exact[0].exceptAll(exact[1]).count() == c["baseline_surplus_rows"]
    assert multiset.counters(multiset.folded(*exact, ["a", "b"])).first().common_rows == exact[0].intersectAll(exact[1]).count()


def test_references_and_conservation(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "a"), (None, None)], "k int, t string")
    parent = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (None, "a")], "k int, t string")
    for nulls, want in {"forbid": (6, 0, 2, 1, 1, 2), "all-null-exempt": (6, 1, 2, 1, 1, 1), "match-null": (6, 0, 3, 2, 1, 0)}.items():
        got = tuple(relations.reference(child, ["k", "t"], parent, ["k", "t"], nulls).first())
        assert got == want and got[0] == sum(got[1:])
    p = spark.createDataFrame([("g", 3), ("h", 5), ("i", 0), ("d", 1), ("d", 1), (None, 2)], "g string, m int")
    c = spark.createDataFrame([("g", 1), ("g", 2), ("h", 4), ("j", 1), (None, 2), ("h", None)], "g string, m int")
    got = relations.conservation(relations.conservation_groups(p, ["g"], "m", c, ["g"], "m", "integer", 0, Tolerance(Decimal(1), Decimal(0)))).first()
    assert tuple(got) == (6, 3, 1, 0, 1, 2, 1, 1)
    assert relations.acyclic([("a", "b"), ("b", "c")]) and not relations.acyclic([("a", "b"), ("b", "a")])
    assert relations.coordination({"event_window": {"end": "2025-01-01T00:00:00Z"}, "coordination": {"mode": "watermark", "watermark_kind": "heuristic"}, "datasets": [{"watermark": "2026-01-01T00:00:00Z"}]}) == (True, "heuristic-watermark")
    assert relations.outcome(True, True) == "FAIL"


def test_ranges_add_up(spark):
    r = recipe(columns={"id": {"type": "integer"}, "v": KEYED["columns"]["v"]})
    left = texts(spark, [(str(i), str(i)) for i in range(40)])
    right = texts(spark, [(str(i), str(i + (i % 7 == 0))) for i in range(2, 43)])
    rows = keyed.classified(parsed(left, r, 0), parsed(right, r, 1), r)
    plan = ranges.RangePlan.of({"partition_plan_version": 1, "ranges": [{"upper": 2}, {"upper": 20}, {"upper": 100}, {"upper": None}]})
    found = ranges.discover(rows, r, plan)
    total = found.agg(*(F.sum(c) for c in keyed.COUNTERS)).first()
    assert tuple(total) == tuple(keyed.counters(rows).first()) and found.count() == 4
    assert [x.part for x in ranges.suspects(found).orderBy("part").collect()] == [0, 1, 2]
    cases = ranges.investigate(rows, r, plan, [1, 2], 2, 3).collect()
    assert [(x.part, x.rank, x.case_count) for x in cases] == [(1, 1, 2), (1, 2, 2), (2, 1, 6)]
    with pytest.raises(PolicyError):
        ranges.RangePlan.of({"partition_plan_version": 1, "ranges": [{"upper": 5}, {"upper": 5}, {"upper": None}]})


def write_all_formats(spark, folder, rows):
    names = ["id", "v"]
    (folder / "a.csv").write_text('id,v\n' + "".join(f'"{i}",{v}\n' for i, v in rows))
    (folder / "a.tsv").write_text("id\tv\n" + "".join(f"{i}\t{v}\n" for i, v in rows))
    (folder / "a.jsonl").write_text("".join(json.dumps({"id": i, "v": v}) + "\n" for i, v in rows))
    (folder / "a.json").write_text(json.dumps({"x": {"y": [{"id": i, "v": v} for i, v in rows]}}))
    (folder / "a.xml").write_text("<r><s>" + "".join(f"<e><id>{i}</id><v>{v}</v></e>" for i, v in rows) + "</s></r>")
    with sqlite3.connect(folder / "a.db") as con:
        con.execute("CREATE TABLE t (id TEXT, v TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(folder / "parts"))
    (folder / "p.parquet").write_bytes(next((folder / "parts").glob("*.parquet")).read_bytes())
    return [str(folder / f"a.{x}") for x in ("csv", "tsv", "jsonl")] + [f"sqlite:{folder}/a.db#t", f"json:{folder}/a.json#/x/y", f"xml:{folder}/a.xml#r/s/e", str(folder / "p.parquet")]


def test_formats_converge(spark, tmp_path):
    rows = [("001", "1.10"), ("b", "2"), ("c", "-3.05")]
    locators = write_all_formats(spark, tmp_path, rows)
    want = sorted(tuple(r) for r in parsed(texts(spark, rows), recipe(), 0).collect())
    for x in locators:
        assert sorted(tuple(r) for r in parsed(read_source(spark, x, recipe()).select("id", "v"), recipe(), 0).collect()) == want, x
    assert compare(spark, recipe(), locators[0], locators[3])["outcome"] == "PASS"


def test_strict_text(spark, tmp_path):
    def read(name, content):
        (tmp_path / name).write_text(content)
        return read_source(spark, str(tmp_path / name)).collect()

    assert [tuple(r) for r in read("q.csv", 'id,v\n"a ""x""\nline",\n')] == [('a "x"\nline', "")]
    for name, content in {"r.csv": "id,v\n1\n", "d.csv": "id,id\n1,2\n", "n.jsonl": '{"a": 1}\n{"a": [1]}\n', "k.jsonl": '{"a": 1}\n{"a": 1, "a": 2}\n', "f.jsonl": '{"a": 1}\n{"b": 1}\n', "e.csv": ""}.items():
        with pytest.raises(Exception):  # noqa: B017
            read(name, content)
    (tmp_path / "dir").mkdir()
    for n in "ab":
        (tmp_path / "dir" / f"{n}.csv").write_text(f"id,v\n{n},1\n")
    assert read_source(spark, str(tmp_path / "dir")).count() == 2
    before = digest(str(tmp_path / "dir"))
    (tmp_path / "dir" / "a.csv").write_text("id,v\na,2\n")
    assert digest(str(tmp_path / "dir")) != before


def test_null_tokens_are_exact(spark):
    r = recipe(null_tokens={"baseline": ["NULL"], "candidate": []}, columns={"id": {"type": "string"}, "v": {"type": "string"}})
    got = {x.id: x.v for x in parsed(texts(spark, [("a", "NULL"), ("b", "null"), ("c", "")]), r, 0).collect()}
    assert got == {"a": None, "b": "null", "c": ""}


def test_profiles(spark):
    df = texts(spark, [("1", "x"), ("2", "x"), ("3", "y")], ("order_id", "name"))
    assert profile.suggested_key(df, ["name", "order_id"]) == ["order_id"]
    draft = profile.draft_recipe(df, df)
    assert draft["columns"]["order_id"] == {"type": "integer"} and parse_recipe(draft).keys == ("order_id",)
    assert parse_recipe(profile.draft_recipe(df, df, "multiset")).mode == "multiset"
    assert parse_recipe(profile.draft_recipe(df, df, "aggregate")).mode == "aggregate"


def test_bundles_and_catalog(spark, tmp_path):
    results = [result(spark, [("a", "1"), ("b", "1")], right) for right in ([("a", "1")], [("a", "1"), ("b", "1")])]
    paths = [evidence.publish(tmp_path / f"run{i}", r, recipe()) for i, r in enumerate(results)]
    assert evidence.verify(paths[0])["outcome"] == "FAIL" and evidence.inspect(paths[1])["outcome"] == "PASS"
    with pytest.raises(PolicyError):
        evidence.publish(paths[0], results[0])
    assert evidence.statement(paths[0])["predicate"]["outcome"] == "FAIL"
    assert "<failure>" in evidence.ci_report(results[0], "junit") and "FAIL" in evidence.ci_report(results[0])
    assert evidence.verify(evidence.publish_terminal(tmp_path / "t", "ERROR", "why"))["outcome"] == "ERROR"
    book = Catalog(spark, str(tmp_path / "book"))
    assert book.states() == []
    for p in paths:
        book.add(str(p))
    assert [x.transition for x in book.history(recipe().fingerprint).orderBy("added").collect()] == [None, "resolved"]
    assert set(book.diff(*map(str, paths))) == {"sha256", "outcome", "discrepancies"}
    (paths[0] / "result.json").write_text("{}")
    with pytest.raises(PolicyError):
        evidence.verify(paths[0])
    (paths[0] / "manifest.json").write_text("{}")
    assert [x["state"] for x in book.states()] == ["modified", "current"]
    book.remove(str(paths[0]))
    assert len(book.states()) == 1


def test_key_search(spark):
    rows = [(a, b, c, "x" if a else None) for a in range(4) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "a long, b long, c long, valid string")
    assert profile.suggested_key(df, ["c", "b", "a", "valid"]) == ["a", "b", "c"]
    five = spark.createDataFrame([tuple(i >> k & 1 for k in range(5)) for i in range(32)], "v long, w long, x long, y long, z long")
    assert sorted(profile.suggested_key(five, five.columns)) == five.columns
    assert profile.suggested_key(df, ["a", "b"]) == [] and profile.suggested_key(df.limit(0), ["a"]) == []
    # On the other side a repeats: the pair is needed there.
    one = spark.createDataFrame([(1, 1), (2, 2)], "a_id long, b long")
    assert profile.suggested_key(one, ["a_id", "b"]) == ["a_id"]
    assert profile.suggested_key(one, ["a_id", "b"], spark.createDataFrame([(1, 1), (1, 2)], one.schema)) == ["a_id", "b"]
    assert not profile.named_like_a_key("valid") and profile.named_like_a_key("Order_ID")


def test_key_of_a_size(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, None), (4, 2, None)], "a long, b_id long, c long")
    assert [profile.suggested_key(df, ["b_id", "c", "a"], size=n) for n in (1, 2, 4)] == [["a"], ["a", "b_id"], []]
    assert profile.suggested_key(df, ["b_id", "c"], size=2) == [] and profile.suggested_key(df.filter("a < 4"), ["b_id", "c"], size=2) == ["b_id", "c"]


def test_float_tolerance_beyond_decimals(spark):
    from concordance.parity.classes import code
    from concordance.policy import Tolerance

    rows = [(1e25, 1.1e25), (1e-25, 3e-25), (1e25, 1.0000001e25), (1.7e308, -1.7e308), (5e-324, 0.0), (0.1, 0.1 + 1e-12), (1e15, 1e15 + 1), (2.0, 2.000002)]
    df = spark.createDataFrame(rows, "l double, r double")
    got = [x[0] for x in df.select(code(F.col("l"), F.col("r"), "float", Tolerance(Decimal(0), Decimal("0.000001")), True)).collect()]
    exact = [abs(Fraction(repr(b)) - Fraction(repr(a))) <= Fraction(1, 10**6) * max(abs(Fraction(repr(a))), abs(Fraction(repr(b)))) for a, b in rows]
    assert got == [1 if x else 2 for x in exact] and got[:2] == [2, 2]
    big = spark.createDataFrame([(Decimal(10) ** 37, 5 * Decimal(10) ** 37)], "l decimal(38,0), r decimal(38,0)")
    with pytest.raises(Exception, match="too large") as e:
        big.select(code(F.col("l"), F.col("r"), "integer", Tolerance(Decimal(0), Decimal(100)), True)).collect()
    assert "1000000000" not in str(e.value)


def test_watermarks_are_instants(spark):
    base = {"alignment_version": 1, "event_window": {"start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z", "bounds": "start-inclusive-end-exclusive"}}
    how = {"mode": "watermark", "claim_id": "c", "receipt_sha256": "0" * 64, "watermark_kind": "closed-world", "idle_partition_policy": "documented"}

    def judged(watermark, kind="closed-world", lateness=0):
        dataset = {"id": "d", "event_time_column": "t", "watermark": watermark, "allowed_lateness_seconds": lateness}
        return relations.coordination(reconcile.read_alignment(base | {"coordination": how | {"watermark_kind": kind}, "datasets": [dataset]}))

    assert judged("2024-02-01T00:30:00+02:00") == (False, "watermark-before-window-end")
    assert judged("2024-01-31T23:00:00-01:00") == (True, None)
    assert judged("2024-02-01T00:00:00Z", "heuristic") == (True, "heuristic-watermark")
    for bad in (("2024-02-01T00:00:00",), ("soon",), ("2024-02-01T00:00:00Z", "sure"), ("2024-02-01T00:00:00Z", "heuristic", -1)):
        with pytest.raises(PolicyError):
            judged(*bad)


def test_null_keys_have_no_range(spark):
    r = parse_recipe(copy.deepcopy(KEYED | {"columns": {"id": {"type": "integer"}, "v": {"type": "string"}}}))
    df = texts(spark, [("1", "a"), ("", "b")])
    rows = keyed.classified(parsed(df, r, 0), parsed(df, r, 1), r)
    plan = ranges.RangePlan((5,))
    with pytest.raises(Exception, match="null key"):
        ranges.discover(rows, r, plan).collect()
    found = [x.asDict() for x in ranges.discover(rows.filter("id IS NOT NULL"), r, plan).orderBy("part").collect()]
    receipt = ranges.receipt(found, plan, r)
    assert ranges.verify_receipt(receipt, plan)["outcome"] == "PASS"
    for bad in (receipt | {"outcome": "FAIL"}, ranges.receipt([found[0] | {"baseline": 7}, found[1]], plan, r), ranges.receipt(found[:1], plan, r)):
        with pytest.raises(PolicyError):
            ranges.verify_receipt(bad, plan)


def test_counts_that_cannot_be(spark):
    check = {"id": "i", "kind": "identity", "dataset": "d", "columns": ["a"], "nulls": "forbid"}
    counts = {"rows": 3, "distinct_keys": 2, "null_key_rows": 0, "duplicate_keys": 1, "failures": 1}
    reconcile.verify_counts(check, {"counts": counts, "outcome": "FAIL"}, {"d": 3})
    for bad, outcome in (({"rows": 4}, "FAIL"), ({}, "PASS"), ({"duplicate_keys": 0, "failures": 0}, "PASS"), ({"null_key_rows": 9}, "FAIL"), ({"rows": -3}, "FAIL")):
        with pytest.raises(PolicyError):
            reconcile.verify_counts(check, {"counts": counts | bad, "outcome": outcome}, {"d": 3})


def test_aggregate_evidence(spark):
    r = parse_recipe({"recipe_version": 2, "comparison_mode": "aggregate", "scope": KEYED["scope"], "columns": {"id": {"type": "string"}, "v": {"type": "integer"}}, "group_by": ["id"], "measures": {"n": {"operator": "count"}, "s": {"operator": "sum", "column": "v", "nulls": "reject", "comparison": "numeric", "tolerance": CENT}}, "output": {"sensitivity": "raw"}})
    got = compare_frames(r, texts(spark, [("a", "1"), ("b", "2"), ("c", "3")]), texts(spark, [("a", "1"), ("b", "3"), ("d", "1")]))
    assert [(x["kind"], x["classification"], x["group_id"], x["measure"], x["baseline"], x["candidate"], x["delta"]) for x in got["sample"]] == [("group", "baseline_only", "c", None, None, None, None), ("group", "candidate_only", "d", None, None, None, None), ("measure", "different", "b", "s", "2", "3", "1")]
    assert got["discrepancies"] == 3 == sum(g["count"] for g in got["groups"]) and {g["kind"] for g in got["groups"]} == {"group", "measure"}
    assert compare_frames(r, texts(spark, [("a", "1"), ("b", "2")]), texts(spark, [("a", ""), ("b", "3")]))["sample"] == []


def test_strings_that_look_nested(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "it's": "[draft] hello"}) + "\n" + json.dumps({"id": "2", "it's": "{x"}) + "\n")
    assert sorted(tuple(x) for x in read_source(spark, str(tmp_path / "a.jsonl")).collect()) == [("1", "[draft] hello"), ("2", "{x")]


def test_series_and_groups(spark):
    counts = {"baseline_only": 2, "candidate_only": 0}
    groups = analysis.groups(counts, [{"field": "v", "within_tolerance": 0, "different": 3}])
    assert [(g["classification"], g["count"]) for g in groups] == [("baseline_only", 2), ("different", 3)]
    schema = "kind string, classification string, name string, count long"
    runs = [spark.createDataFrame(x, schema) for x in ([("field", "different", "v", 3)], [("field", "different", "v", 3), ("key", "baseline_only", "", 1)], [])]
    got = {(r.kind, r.run): (r["count"], r.transition) for r in analysis.series(runs).collect()}
    assert got["key", 1] == (1, "introduced") and got["field", 1] == (3, "unchanged") and got["field", 2] == (0, "resolved") and got["key", 0] == (0, None)
    suite = analysis.suite_series(spark, [{"a": {"outcome": "FAIL", "discrepancies": 2}}, {"a": {"outcome": "PASS", "discrepancies": 0}}]).collect()
    assert [r.transition for r in sorted(suite, key=lambda r: r.run)] == [None, "resolved"]


def test_suites(spark):
    plan = suites.read_plan({"suite_version": 2, "cases": [{"id": f"c{i}", "recipe": "r", "baseline": "b", "candidate": "c", "tags": ["x"] if i % 2 else []} for i in range(5)]})
    assert [c.id for c in suites.select(plan, shard=(1, 2))] == ["c1", "c3"] and [c.id for c in suites.select(plan, tags=["x"])] == ["c1", "c3"]
    run = lambda c: {"outcome": "PASS", "discrepancies": 0} if c.id != "c3" else 1 / 0
    got = suites.run(spark, plan, run, jobs=3)
    assert [r["id"] for r in got["cases"]] == [c.id for c in plan] and got["outcome"] == "ERROR"
    shards = [suites.run(spark, suites.select(plan, shard=(i, 2)), run) for i in range(2)]
    assert suites.assemble(plan, shards) == got
    with pytest.raises(PolicyError):
        suites.assemble(plan, [shards[0]])
    with pytest.raises(PolicyError):
        suites.assemble(plan, [got, got])
    better = {"cases": [{"id": "c3", "outcome": "PASS"}]}
    assert suites.compare(got, better)["transitions"] == {"improved": 1, "removed": 4}
    assert suites.worst(["PASS", "INCONCLUSIVE", "FAIL"]) == "INCONCLUSIVE"


def test_published_plans():
    base = {"id": "orders-keyed", "recipe": "../r.json", "baseline": "../a.csv", "candidate": "json:../b.json#/x"}
    lock = "88de243927d26e234bff123a62f4b5f9d92a5a0df7024ed9c7b31d57466b6bf9"
    (one,) = suites.read_plan({"suite_version": 1, "cases": [base | {"expected_policy_sha256": lock}]})
    assert one.expected_policy_sha256 == lock
    two = suites.read_plan({"suite_version": 2, "defaults": {"limits": {"max_rows": 10, "max_groups": 5}}, "cases": [base | {"tags": ["critical", "orders"], "description": "d", "limits": {"max_groups": 7}, "execution": {"engine": "sqlite", "max_temp_bytes": 9}}]})[0].limited
    assert (two.max_rows, two.max_groups, two.max_temp_bytes, two.max_distinct_rows) == (10, 7, 9, 100_000)
    bad = [{"limits": {"max_rows": 0}}, {"limits": {"rows": 1}}, {"tags": ["b", "a"]}, {"execution": {"engine": "other"}}, {"id": "a--b"}, {"id": "A"}, {"description": ""}, {"baseline": "/etc/x.csv"}, {"expected_policy_sha256": "0"}]
    for more in bad:
        with pytest.raises(PolicyError):
            suites.read_plan({"suite_version": 2, "cases": [base | more]})
    with pytest.raises(PolicyError):
        suites.read_plan({"suite_version": 1, "defaults": {}, "cases": [base]})


def test_suite_resume(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(KEYED))
    for name, v in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text(f"id,v\nx,{v}\n")
    cases = [{"id": "same", "recipe": "r.json", "baseline": "a.csv", "candidate": "a.csv"}, {"id": "other", "recipe": "r.json", "baseline": "a.csv", "candidate": "b.csv"}, {"id": "broken", "recipe": "r.json", "baseline": "a.csv", "candidate": "a.csv", "limits": {"max_input_bytes": 1}}]
    (tmp_path / "plan.json").write_text(json.dumps({"suite_version": 2, "cases": cases}))

    def go():
        code = cli.main(["run-suite", str(tmp_path / "plan.json"), str(tmp_path / "work"), "--jobs", "2"])
        return code, {r["id"]: (r["outcome"], r.get("reused")) for r in json.loads((tmp_path / "work" / "suite.json").read_text())["cases"]}

    assert go() == (2, {"same": ("PASS", False), "other": ("FAIL", False), "broken": ("ERROR", None)})
    assert go()[1] == {"same": ("PASS", True), "other": ("FAIL", True), "broken": ("ERROR", None)}
    (tmp_path / "b.csv").write_text("id,v\nx,1\n")
    (tmp_path / "work" / "same" / "report.html").write_text("changed")
    assert go()[1] == {"same": ("PASS", False), "other": ("PASS", False), "broken": ("ERROR", None)}


def field(i, name):
    return {"id": i, "name": name, "presence": "required", "nullability": "non-null"}


def test_evolution():
    changes = [{"change": "renamed", "baseline": [field("g", "gross")], "candidate": [field("g", "total")]}, {"change": "added", "baseline": [], "candidate": [field("b", "batch")]}]
    value = {"evolution_version": 1, "direction": "baseline-to-candidate", "changes": changes}
    found = evolution.read_evolution(value)
    assert evolution.compile_mappings(found) == {"gross": {"baseline": "gross", "candidate": "total"}}
    for bad in ([changes[0] | {"change": "unchanged"}], [changes[0] | {"candidate": [field("h", "total")]}], [changes[1] | {"change": "split"}], [changes[0], changes[0]]):
        with pytest.raises(PolicyError):
            evolution.read_evolution(value | {"changes": bad})
    before = recipe(columns={"id": {"type": "string"}, "gross": {"type": "decimal", "scale": 2}})
    after = recipe(columns={"id": {"type": "string"}, "total": {"type": "decimal", "scale": 2}, "batch": {"type": "string"}})
    assert evolution.policy_diff(before, after, found)["decision"] == "ACCEPT"
    assert evolution.policy_diff(before, after, [])["decision"] == "DENY"
    loose = recipe(columns={"id": {"type": "string"}, "gross": {"type": "decimal", "scale": 2, "comparison": "numeric", "tolerance": CENT}})
    assert evolution.policy_diff(before, loose, [])["reasons"] == ["tolerance-loosened"]


def test_manifests(spark, tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / "a.csv").write_text("x")
    (root / "sub" / "b.csv").write_text("y")
    m = manifests.create(spark, root, recipe())
    assert [x["path"] for x in m["members"]] == ["a.csv", "sub/b.csv"]
    assert manifests.verify(spark, m, root) == {"outcome": "PASS", "states": {"match": 2}}
    (root / "a.csv").write_text("z")
    (root / "c.csv").write_text("new")
    assert manifests.verify(spark, m, root)["states"] == {"match": 1, "digest_mismatch": 1, "undeclared": 1}
    with pytest.raises(PolicyError):
        manifests.verify(spark, m | {"policy_sha256": None}, root)
    assert manifests.reproducibility_diff({"a": 1, "b": 2}, {"a": 1, "b": 3}) == {"b": [2, 3]}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(KEYED))
    (tmp_path / "a.csv").write_text("id,v\na,1\n")
    (tmp_path / "b.csv").write_text("id,v\na,2\n")
    at = lambda x: str(tmp_path / x)
    assert cli.main(["compare", at("r.json"), at("a.csv"), at("a.csv"), at("out")]) == 0
    assert cli.main(["compare", at("r.json"), at("a.csv"), at("b.csv"), at("out2")]) == 1
    assert cli.main(["compare", at("r.json"), at("a.csv"), at("b.csv"), at("out3"), "--expected-policy-sha256", "0"]) == 2
    assert cli.main(["verify", at("out2")]) == 1 and cli.main(["explain", at("r.json")]) == 0
    assert load_recipe(tmp_path / "r.json").fingerprint in capsys.readouterr().out
    assert evidence.verify(tmp_path / "out3")["outcome"] == "ERROR"
    assert cli.main(["compare", at("r.json"), at("a.csv"), at("b.csv"), at("out4"), "--max-input-bytes", "3"]) == 2
    assert cli.main(["compare", at("r.json"), at("a.csv"), at("b.csv"), at("out5"), "--max-input-bytes", "5000000000"]) == 1
    assert cli.main(["analyze", at("out2")]) == 0 and cli.main(["series", at("out"), at("out2")]) == 1
    assert cli.main(["ci-report", at("out2"), at("ci.md")]) == 0 and "FAIL" in (tmp_path / "ci.md").read_text()
    assert cli.main(["export", at("out2"), at("rows.jsonl")]) == 0 and cli.main(["diff-policy", at("r.json"), at("r.json")]) == 0
    assert cli.main(["init", at("new")]) == 0 and cli.main(["run-suite", at("new/suite.json"), at("new/work")]) == 1
    (tmp_path / "keyed.json").write_text(json.dumps(KEYED | {"columns": {"id": {"type": "integer"}, "v": {"type": "string"}}}))
    (tmp_path / "ranges.json").write_text(json.dumps({"partition_plan_version": 1, "ranges": [{"upper": 5}, {"upper": None}]}))
    (tmp_path / "n.csv").write_text("id,v\n1,a\n7,b\n")
    (tmp_path / "m.csv").write_text("id,v\n1,a\n7,c\n")
    capsys.readouterr()
    assert cli.main(["discover", at("keyed.json"), at("ranges.json"), at("n.csv"), at("m.csv")]) == 1
    (tmp_path / "receipt.json").write_text(capsys.readouterr().out)
    assert cli.main(["verify-discovery", at("receipt.json"), at("ranges.json")]) == 1
    assert cli.main(["investigate", at("keyed.json"), at("ranges.json"), at("n.csv"), at("m.csv")]) == 1
    assert json.loads(capsys.readouterr().out)["ranges"] == [{"part": 1, "shown": 1, "case_count": 1, "complete": True}]
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    assert cli.main(["explain", at("twice.json")]) == 2


def test_projected_recipes(spark, tmp_path):
    record = {"a": {"x": "k1"}, "v": [None, "1.5"]}
    (tmp_path / "d.json").write_text(json.dumps([record]))
    (tmp_path / "d.xml").write_text('<r xmlns:n="urn:n"><e id="k1"><n:p><q>1.5</q></n:p></e></r>')
    projection = {
        "version": 1,
        "baseline": {"kind": "json-pointer-v1", "fields": {"id": "/a/x", "v": "/v/1"}},
        "candidate": {"kind": "xml-field-v1", "namespaces": {"n": "urn:n"}, "fields": {"id": "@id", "v": "n:p/q"}},
    }
    r = recipe(recipe_version=4, input_projection="semantic-scalar-v1", field_projection=projection)
    assert compare(spark, r, f"json:{tmp_path}/d.json#", f"xml:{tmp_path}/d.xml#r/e")["outcome"] == "PASS"
    direct = {"version": 1} | {s: {"kind": "direct-v1", "fields": {"id": "key", "v": "val"}} for s in ("baseline", "candidate")}
    r = recipe(recipe_version=4, input_projection="semantic-scalar-v1", field_projection=direct)
    df = texts(spark, [("a", "1")], ("key", "val"))
    assert compare_frames(r, df, df)["outcome"] == "PASS"
    for bad in ({"fields": {"id": "a/x", "v": "/v"}}, {"fields": {"id": "/a~2", "v": "/v"}}, {"fields": {"id": "/a"}}, {"kind": "other"}):
        with pytest.raises(PolicyError):
            recipe(recipe_version=4, input_projection="semantic-scalar-v1", field_projection=projection | {"baseline": projection["baseline"] | bad})
    with pytest.raises(PolicyError):
        recipe(input_projection="loose")


def test_reconciliation(spark):
    def keyed_recipe(key, **columns):
        base = {"at": {"type": "timestamp", "timezone": "require-aware"}, "amount": {"type": "decimal", "scale": 2}}
        return parse_recipe(copy.deepcopy(KEYED | {"keys": [key], "columns": {key: {"type": "string"}, **columns, **base}}))

    pay, out = keyed_recipe("pid", oid={"type": "string"}), keyed_recipe("oid")
    payments = texts(spark, [("p1", "o1", "2026-09-02T00:00:00Z", "1.00"), ("p2", "o1", "2026-09-03T00:00:00Z", "2.00")], ("pid", "oid", "at", "amount"))
    payouts = texts(spark, [("o1", "2026-09-04T00:00:00Z", "3.00")], ("oid", "at", "amount"))
    inputs = {"payments": (pay, payments, payments), "payouts": (out, payouts, payouts)}
    receipt = b"receipt"
    import hashlib

    tokens = [{"id": i, "event_time_column": "at", "snapshot_token": "s", "token_domain": "d"} for i in inputs]
    alignment = {"alignment_version": 1, "event_window": {"start": "2026-09-01T00:00:00Z", "end": "2026-10-01T00:00:00Z", "bounds": "start-inclusive-end-exclusive"}, "coordination": {"mode": "source-snapshot", "claim_id": "c", "receipt_sha256": hashlib.sha256(receipt).hexdigest()}, "datasets": tokens}
    checks = [
        {"id": "payout-id", "kind": "identity", "dataset": "payouts", "columns": ["oid"], "nulls": "forbid"},
        {"id": "link", "kind": "reference", "child_dataset": "payments", "child_columns": ["oid"], "parent_identity": "payout-id", "nulls": "forbid"},
        {"id": "sum", "kind": "conservation", "parent_dataset": "payouts", "parent_identity": "payout-id", "parent_group_columns": ["oid"], "child_dataset": "payments", "child_group_columns": ["oid"], "parent_measure": "amount", "child_measure": "amount", "operator": "sum", "nulls": "forbid", "comparison": "exact", "tolerance": None},
    ]

    def declared(recipes=inputs, checks=checks, alignment=alignment):
        columns = {k: [{"name": n, "type": f.type} for n, f in r[0].columns.items()] for k, r in recipes.items()}
        return {"reconciliation_version": 1, "alignment_sha256": reconcile.read_alignment(alignment)["alignment_sha256"], "datasets": [{"id": k, "policy_sha256": r[0].fingerprint, "columns": columns[k]} for k, r in recipes.items()], "checks": checks}

    got = reconcile.reconcile(alignment, declared(), receipt, inputs)
    assert got["outcome"] == "PASS" and not any(reconcile.diagnosis(got).values())
    wrong = payments.withColumn("oid", F.when(F.col("pid") == "p2", "o9").otherwise(F.col("oid")))
    got = reconcile.reconcile(alignment, declared(), receipt, inputs | {"payments": (pay, payments, wrong)})
    found = reconcile.diagnosis(got)
    assert got["outcome"] == "FAIL" and (found["reference_orphan"], found["conservation_different"], found["conservation_child_only"]) == (1, 1, 1)
    assert reconcile.reconcile(alignment, declared(), b"other", inputs)["alignment"]["reason_codes"] == ["receipt-mismatch"]
    late = alignment | {"coordination": alignment["coordination"] | {"mode": "declared-cutoff"}, "datasets": [{k: d[k] for k in ("id", "event_time_column")} for d in tokens]}
    assert reconcile.reconcile(late, declared(alignment=late), receipt, inputs)["outcome"] == "INCONCLUSIVE"
    for bad in ([checks[1]], [checks[0], checks[0]], [checks[0], checks[1] | {"child_columns": ["amount"]}], [checks[0] | {"nulls": "zero"}]):
        with pytest.raises(PolicyError):
            reconcile.read_reconciliation(declared(checks=bad), {k: v[0] for k, v in inputs.items()})


def test_rehearsal_and_dossier(spark):
    def own(key, **columns):
        return parse_recipe(copy.deepcopy(KEYED | {"keys": [key], "columns": {key: {"type": "integer"}, **columns, "amount": {"type": "decimal", "scale": 2}}}))

    recipes = {"orders": own("oid"), "lines": own("lid", oid={"type": "integer"})}
    orders = texts(spark, [("1", "3.00"), ("12", "1.00")], ("oid", "amount"))
    lines = texts(spark, [("1", "1", "1.00"), ("2", "1", "2.00"), ("3", "12", "1.00")], ("lid", "oid", "amount"))
    moved = lines.withColumn("oid", F.when(F.col("lid") == "3", "9").otherwise(F.col("oid")))
    plans = dict.fromkeys(recipes, ranges.RangePlan((10,)))
    checks = [
        {"id": "order", "kind": "identity", "dataset": "orders", "columns": ["oid"], "nulls": "forbid"},
        {"id": "link", "kind": "reference", "child_dataset": "lines", "child_columns": ["oid"], "parent_identity": "order", "nulls": "forbid"},
    ]
    good = rehearsal.rehearse({"orders": (recipes["orders"], orders, orders), "lines": (recipes["lines"], lines, lines)}, plans, checks)
    bad = rehearsal.rehearse({"orders": (recipes["orders"], orders, orders), "lines": (recipes["lines"], lines, moved)}, plans, checks)
    assert good["outcome"] == "PASS" and bad["outcome"] == "FAIL" and bad["relations"]["candidate"][1]["counts"]["orphan"] == 1
    assert rehearsal.verify_rehearsal(good, plans) == good
    found = rehearsal.dossier(bad, [{"id": "e1", "reason": "late order", "disposition": "open"}], [{"by": "A. Reviewer", "role": "owner"}])
    assert found["open"] == 1 and rehearsal.verify_dossier(found, bad, plans) == found
    for wrong in (lambda: rehearsal.verify_rehearsal(good | {"outcome": "FAIL"}, plans), lambda: rehearsal.verify_dossier(found, good, plans), lambda: rehearsal.dossier(bad, [{"id": "e", "reason": "r", "disposition": "ignored"}])):
        with pytest.raises(PolicyError):
            wrong()


def test_dataset_evidence(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "a.csv").write_text("id,v\na,1\n")
    r, at = recipe(), str(root / "a.csv")
    bound = rehearsal.bindings("suite", "0" * 64, {"case": (r, at, at)})
    assert [(b["role"], b["source_sha256"]) for b in bound["bindings"]] == [(s, digest(at)) for s in ("baseline", "candidate")]
    manifest = rehearsal.bound_manifest(spark, root, bound, r)
    assert manifest["manifest_version"] == 2 and manifests.verify(spark, manifest, root)["outcome"] == "PASS"
    bundle = evidence.publish(tmp_path / "run", compare(spark, r, at, at), r)
    assert rehearsal.publish_dataset_evidence(spark, tmp_path / "evidence", manifest, root, r, bundle)["outcome"] == "PASS"
    assert rehearsal.verify_dataset_evidence(tmp_path / "evidence")["diagnostic"] == manifests.reproducibility()
    assert "PASS" in rehearsal.cover_sheet("cutover <1>", {"run": evidence.verify(bundle)}) and "<1>" not in rehearsal.cover_sheet("cutover <1>", {})
    with pytest.raises(PolicyError):
        rehearsal.read_bindings(bound | {"bindings": bound["bindings"] * 2})
    (tmp_path / "evidence.result" / "report.html").write_text("changed")
    with pytest.raises(PolicyError):
        rehearsal.verify_dataset_evidence(tmp_path / "evidence")
