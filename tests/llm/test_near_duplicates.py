import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from concordance.llm import components as C
from concordance.llm import embeddings as E
from concordance.llm import simhash as S


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "none"])
def test_components(spark, shape):
    r = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(150)],
        "star": [(0, i) for i in range(1, 150)],
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(120)],
        "loops": [(3, 3), (4, 5), (5, 4), (4, 5), (None, 4)],
        "none": [],
    }[shape]
    got = {x.node: x.root for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [x for x in links if None not in x and x[0] != x[1]]
    assert got == roots_of({n for x in clean for n in x}, clean)


def test_golay_codewords_meet_within_two_bits():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    near = S.codewords(words)
    for bits in [(), (5,), (0, 22), (7, 8)]:
        other = S.codewords(words ^ sum(1 << b for b in bits))
        assert ((near[:, :, None] == other[:, None, :]) & (near[:, :, None] >= 0)).any((1, 2)).all()


@pytest.mark.parametrize("finer", [False, True])
def test_keys_meet_within_two_bits(finer):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for one, two in itertools.product((0, 21, 22, 42, 43, 63), repeat=2):
        b = a ^ np.uint64(1 << one) ^ np.uint64(1 << two)
        sides = [set(zip(*(x.tolist() for x in S.keys(p, finer)), strict=True)) for p in (a, b)]
        assert {owner for _, owner in sides[0] & sides[1]} == set(range(500))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "One", "One TWO", "a b c", "a b c a b c a b c", "É x y \x0b z", "w " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def linked_prints(rng):
    """Clusters around centres, close together and in chains, and lone prints."""
    out = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for c in out[:6]:
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("bucket", [512, 8, 2])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    prints = linked_prints(np.random.default_rng(4))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "print long, id long")
    got = [tuple(x) for x in S.links(df).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in got)
    assert roots_of(range(len(prints)), got) == roots_of(range(len(prints)), pairs)


def test_near_duplicates(awkward, no_docs):
    got = S.near_duplicates(awkward).collect()
    rows = awkward.collect()
    want = sorted((str(r.doc_id), f"{plain_fingerprint(r.text):016x}") for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == want
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[7] == 1 and by[3] == 2 and by[6] == 6 and by[5] == 5
    assert {r.component_id for r in got if r.doc_id is None} == {2, None}
    assert S.near_duplicates(no_docs).count() == 0


def test_without_near_duplicates(awkward, no_docs):
    kept = S.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(str(x) for x in ids) == ["1", "2", "4", "5", "6", "8", "None", "None"]
    assert S.without_near_duplicates(no_docs).count() == 0


def plain_vectors(rows, least):
    good = [(i, v, x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= least]
    n = {i: sum(i in x for x in links) for i, _, _ in rows}
    return n, roots_of([i for i, _, _ in rows], links)


@pytest.mark.parametrize("block", [2048, 20])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for c in rng.normal(size=(12, 8)):
        rows += [(c + rng.normal(size=8) * s).tolist() for s in [0, 0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5]]
    rows += [(np.array(rows[4]) * 3).tolist(), [0.0] * 8, [-0.0] * 8, None, [], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] * 8, [1.0, 0.0], [1.0, 0.0]]
    data = [(i + 100, v, None if i % 17 == 0 else i % 3 if i % 2 else 0) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    n, roots = plain_vectors(data, 0.98)
    got = E.near_duplicates(df).collect()
    assert {r.vec_id: r.n_links for r in got} == n
    assert {r.vec_id: r.component_id for r in got} == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(data)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vectors_count_as_links(spark):
    rows = [(i, [1.0, 2.0], 1) for i in (5, 3, 9)] + [(4, [1.0, 2.01], 1), (3, [1.0, 2.0], 1), (None, [9.0, 0.0], 1)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(r.n_links for r in got) == [0, 4, 4, 4, 4, 4]
    assert {r.component_id for r in got} == {3, None}


def test_vectors_of_any_size(spark):
    """Components whose squares vanish or overflow count as they are."""
    rows = [(1, [1e-200, 1e-200, 0.0], 1), (2, [1.0, 1.0, 0.0], 1), (3, [1e200, 1e200, 1e180], 1), (4, [5e-324, 0.0, 0.0], 1), (5, [3.0, 0.0, 0.0], 1), (6, [-1e300, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


@pytest.mark.parametrize("spread", [0.02, 0.1, 1.0])
def test_traversal_is_all_pairs(spread):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(20, 16)), 30, 0) + spread * r.normal(size=(600, 16))
    x = x[r.permutation(600)]
    x[7], x[8] = 3 * x[5], 0.5 * x[5]
    side, weight = np.arange(600) % 2, r.integers(1, 4, 600)
    cosine = x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    for sides, across in ((np.zeros(600, int), False), (side, True)):
        count, a, b = E.block_links(np.arange(600), x, weight, sides, 0.98)
        links = (cosine >= 0.98) & ~np.eye(600, dtype=bool)
        if across:
            links &= side[:, None] != side
        assert count.tolist() == (links @ weight).tolist()
        assert all(links[i, j] or i == j or not across for i, j in zip(a, b, strict=True))
        roots = np.arange(600)
        for _ in range(600):
            new = np.array([min(roots[i], *roots[links[i]]) if links[i].any() else roots[i] for i in range(600)])
            if (new == roots).all():
                break
            roots = new
        found = np.arange(600)
        for _ in range(600):
            before = found.copy()
            np.minimum.at(found, a, before[b])
            np.minimum.at(found, b, found[a])
            if (found == before).all():
                break
        assert found.tolist() == roots.tolist()
