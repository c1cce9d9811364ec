import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordance.llm import shingles as S


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_pairs(sets, least=0.8):
    """All pairs of distinct sets, found through every shared shingle."""
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for p in itertools.combinations(ids, 2):
            shared[p] = shared.get(p, 0) + 1
    return [(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]


@pytest.fixture(scope="module")
def texts():
    """Unrelated texts, each with copies in which 1 to 12 of 200 words are others."""
    rng = np.random.default_rng(7)
    out = []
    for c in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        out.append(" ".join(words))
        for edits in (1, 3, 4, 5, 12):
            changed = list(words)
            for at in rng.integers(0, 200, edits):
                changed[at] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(changed))
    return out


def kept_by_brute_force(texts):
    sets = [plain_set(x) for x in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if x == old else x for x in root]
    return {i for i, x in enumerate(root) if i == x}


def test_the_stage_drops_what_brute_force_drops(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    want = kept_by_brute_force(texts)
    assert got == want and 25 < len(want) < len(texts)


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = docs.select("doc_id", "text")
    rows = texts.collect()
    sets = list({plain_set(r.text) for r in rows})
    want = similar_pairs(sets)
    assert want
    kept = {plain_set(r.text) for r in S.without_similar(texts).collect()}
    assert not [p for p in want if sets[p[0]] in kept and sets[p[1]] in kept]
    assert len(kept) >= len(sets) - len(want)
    print("distinct sets", len(sets), "similar pairs", len(want), "kept", len(kept))


def test_awkward(awkward, no_docs):
    kept = S.without_similar(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "8", "None", "None"]
    assert S.without_similar(no_docs).count() == 0


def test_a_long_text_is_hashed_in_chunks():
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 3 * S.CHUNK + 1, dtype=np.uint64)
    assert len(set(S.band_keys(hashes).tolist())) == S.BANDS and len(S.band_keys(hashes[:0])) == 0
    assert (S.band_keys(hashes) == S.band_keys(hashes[::-1])).all()


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "m n o p q r")]
    kept = S.without_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == [1, 3]


def test_the_fingerprint_is_a_simhash():
    hashes = np.random.default_rng(2).integers(0, 1 << 64, S.CHUNK + 301, dtype=np.uint64)
    bits = lambda words: words[..., None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    for some in (hashes[:1], hashes[:4], hashes):
        assert (bits(S.simhash(some)) == (2 * bits(S.mixed(some)).sum(0) > len(some))).all()
    assert not S.simhash(hashes[:0]).any()


@pytest.mark.parametrize(("shared", "a", "b"), [(4, 1, 0), (8, 1, 1), (40, 5, 5), (178, 22, 22), (800, 200, 0)])
def test_similar_sets_share_a_golay_key(shared, a, b):
    rng = np.random.default_rng(11)
    found = 0
    for _ in range(500):
        x = rng.integers(0, 1 << 64, shared + a + b, dtype=np.uint64)
        prints = np.stack([S.simhash(x[: shared + a]), S.simhash(np.concatenate([x[:shared], x[shared + a :]]))])
        band = S.bands(prints, *S.exact_bits(1000))
        near = S.codewords(band.reshape(-1) & (1 << 23) - 1).reshape(2, -1, 6)
        meet = ((near[0][:, :, None] == near[1][:, None, :]) & (near[0][:, :, None] >= 0)).any((1, 2)) & (band[0] >> 23 == band[1] >> 23)
        found += meet.any() and np.bitwise_count(prints[0, S.SEGMENT_WORDS :] ^ prints[1, S.SEGMENT_WORDS :]).sum() <= S.RADIUS
    assert found >= 495


def test_a_crowd_costs_rows_and_not_pairs(spark):
    """700 variants of one text, few of them similar: more than a task's block, connected as by brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    crowd = [list(base) for _ in range(700)]
    for words in crowd:
        for at in rng.integers(0, 120, rng.integers(1, 7)):
            words[at] = f"x{rng.integers(0, 10**9)}"
    crowd = [" ".join(x) for x in crowd]
    docs = spark.createDataFrame(list(enumerate(crowd)), "id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.withColumnRenamed("id", "doc_id"), "").collect()} == kept_by_brute_force(crowd)
    sets = S._sets(docs, 5).selectExpr("id AS node", "*").localCheckpoint()
    assert 0 < S.similar(docs, sets, 5, 0.8).count() <= 700 * 3


def test_crowded_keys_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 40)
    monkeypatch.setattr(S, "STEPS", 8)
    rng = np.random.default_rng(6)
    key = np.repeat(np.arange(30), [3, 50, 20] * 10)
    word = lambda: rng.integers(-(1 << 63), 1 << 63, 30)[key]
    rows = {"key": key, "node": np.arange(len(key)), "p": word(), "q": word()}
    batch = pa.RecordBatch.from_pydict(rows)
    out = pa.Table.from_batches([*S._candidates(iter([batch.slice(i, 17) for i in range(0, len(key), 17)]))]).to_pylist()
    linked, handed = [x for x in out if x["b"] is not None], [x for x in out if x["b"] is None]
    assert sorted(x["a"] for x in handed) == np.flatnonzero(np.repeat([False, True, False] * 10, [3, 50, 20] * 10)).tolist()
    assert all(x["p"] == rows["p"][x["a"]] and x["key"] == key[x["a"]] for x in handed)
    assert len(linked) == 10 * (2 + 19) and all(key[x["a"]] == key[x["b"]] for x in linked)
    tasks = pa.RecordBatch.from_pydict({"task": [x["key"] for x in handed], "node": [x["a"] for x in handed], "p": [x["p"] for x in handed], "q": [x["q"] for x in handed]})
    assert sum(x.num_rows for x in S._near_blocks(iter([tasks]))) == 10 * 49


def test_keys_grow_with_the_sets():
    assert S.exact_bits(1000) == S.exact_bits(1 << 18) == (2, 1) and S.exact_bits(1 << 24)[0] == 8
    prints = np.random.default_rng(8).integers(0, 1 << 64, (5, S.WORDS), dtype=np.uint64)
    for n in (1, 1 << 19, 1 << 24, 1 << 30):
        found = S.bands(prints, *S.exact_bits(n))
        assert found.shape == (5, S.BANDS * S.exact_bits(n)[1]) and len(np.unique(found)) == found.size
