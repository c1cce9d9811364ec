"""Near-duplicates by the shingles that texts share: long SimHash fingerprints, Golay keys, exact Jaccard similarity.

A text is the set of its shingles.  Its SimHash has WORDS * 64 bits.  Of the first 384 bits,
each 24 make a segment, whose first 23 are decoded with the Golay code as op1 does it
(``simhash.codewords``); a band's keys are the segment's codewords, each with a few bits of
another segment as they are.  What shares a key and differs in at most RADIUS of the last 128
bits is a candidate.  Components of candidates are compared pair by pair on the whole sets,
so what is linked is right.

Sets of similarity 0.8 differ in 15 % of the bits: a segment's codewords meet with
probability 0.60 and bands are as many as find such a pair with probability 0.9999,
about (sets of a few shingles: 0.99).  How many bits are taken as they are grows with the
logarithm of the sets, and bands with them, so keys don't fill up.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, in_arrow, kept, staged
from .components import components
from .encoding import gathered
from .simhash import LOWER, SEED, _within, codewords

#: 64-bit words of a fingerprint; segments, and the words that hold them, the others are for RADIUS.
WORDS, BANDS, SEGMENT_WORDS = 8, 16, 6
#: Differing bits, of 128, of a candidate: similarity 0.8 has 19, by 4 a standard deviation, unrelated sets 64 by 6.
RADIUS = 38
#: Least bits of a key that are taken as they are, and the logarithm of the sets for which they do.
LEAST_EXACT, LEAST_LOG = 2, 18
#: Shingles that are hashed for all words at once.
CHUNK = 8192
#: Rows of a key that are compared in steps, and that one task compares; more are dealt out.
STEPS, BUCKET = 256, 4096
#: Sets of a component that one task compares with as many others.
BLOCK = 512
_LANES = np.uint64(0x0101010101010101)


def hashed_shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending; a shorter text is one, without words there are none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]).tolist()
    stops = [x - 1 for x in ends[shingle - 1 :]] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip([0, *ends[: n - 1]], stops, strict=True)], np.uint64))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of random bits of each hash (SplitMix64); shape (hashes, WORDS)."""
    z = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of a set of hashes: a bit is 1 if it is in over half of the mixed hashes; zeros for an empty set."""
    counts = np.zeros((8, WORDS * 8), np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = mixed(hashes[i : i + CHUNK])
        for j in range(8):  # bits j, j + 8, ...: a byte each, which holds the sum of 255
            lanes = np.add.reduceat(some >> np.uint64(j) & _LANES, np.arange(0, len(some), 255), axis=0)
            counts[j] += lanes.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts.T > len(hashes), axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def exact_bits(n: int) -> tuple[int, int]:
    """For so many sets: bits of a key that are taken as they are, and bands of a segment.

    Bands are as many as let a segment of a pair of similarity 0.8 meet with probability 0.42.
    """
    exact = min(20, max(LEAST_EXACT, ceil(log(max(n, 2), 2)) - LEAST_LOG + LEAST_EXACT))
    return exact, min(BANDS - 1, ceil(1.19 / -log(1 - 0.8485**exact)))


def bands(prints: np.ndarray, exact: int, width: int) -> np.ndarray:
    """Of fingerprints, shape (sets, WORDS): number of a band, exact bits of another segment, 23 bits of its own; shape (sets, BANDS * width)."""
    octets = np.ascontiguousarray(prints[:, :SEGMENT_WORDS]).view(np.uint8).reshape(len(prints), BANDS, 3).astype(np.int64)
    own = octets[:, :, 0] | octets[:, :, 1] << 8 | (octets[:, :, 2] & 127) << 16
    out = [np.roll(own, -i - 1, axis=1) & (1 << exact) - 1 for i in range(width)]
    return np.concatenate([(np.arange(BANDS) + BANDS * i) << 43 | x << 23 | own for i, x in enumerate(out)], axis=1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS bands of a set of hashes, as for a small table; none of an empty set."""
    return bands(simhash(hashes)[None], LEAST_EXACT, 1)[0] if len(hashes) else np.empty(0, np.int64)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, digest of the set, size, fingerprint) of (id, text); one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingles")
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = [hashed_shingles(x, shingle) for x in part.column("text").to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                prints = pa.array([simhash(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "digest": digests, "size": pa.array([len(x) for x in sets], pa.int64()), "print": prints})

    return in_arrow(docs, run, "id long, digest binary, size long, print array<long>")


def _hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, digest, hashes) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = [hashed_shingles(x, shingle).view(np.int64) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    return in_arrow(docs, run, "id long, digest binary, hashes array<long>")


def _keyed(nodes: DataFrame, exact: int, width: int) -> DataFrame:
    """(key, node, p, q: the last two words) for all keys of (node, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                prints = some.column("print").flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
                node, (p, q) = some.column("node").to_numpy(), prints[:, SEGMENT_WORDS:].view(np.int64).T
                for band in bands(prints, exact, width).T:
                    near = codewords(band & (1 << 23) - 1)
                    owner, column = np.nonzero(near >= 0)
                    yield pa.RecordBatch.from_pydict({"key": (band[owner] >> 23) << 12 | near[owner, column], "node": node[owner], "p": p[owner], "q": q[owner]})

    return in_arrow(nodes, run, "key long, node long, p long, q long")


def _far(p: np.ndarray, q: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Differing bits of unsigned words; of signed ones numpy would count the absolute value's."""
    return np.bitwise_count(p[a] ^ p[b]).astype(np.int64) + np.bitwise_count(q[a] ^ q[b])


def spread(n: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """A forest of the graph on 0 .. n-1: (node, those that it reaches first); ``near(i, others)`` says which are neighbours."""
    waiting, left = [], np.arange(n)
    while len(left) or waiting:
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        if not len(left):
            return
        i = waiting.pop()
        hit = near(i, left)
        if hit.any():
            yield i, left[hit]
            waiting.extend(left[hit].tolist())
            left = left[~hit]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """Columns of sorted rows, cut where the first column changes; a run that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        by = batch.column(names[0]).to_numpy()
        cut = int(np.searchsorted(by, by[-1]))
        if held and (cut or held[0].column(names[0])[0].as_py() != by[0]):
            yield [pa.chunked_array([x.column(c) for x in [*held, batch.slice(0, cut)]]).combine_chunks() for c in names]
            held = []
        elif cut:
            yield [batch.slice(0, cut).column(c) for c in names]
        held.append(batch.slice(cut))
    if held:
        yield [pa.chunked_array([x.column(c) for x in held]).combine_chunks() for c in names]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within keys, of rows sorted by key; rows of a key with over BUCKET are handed on (a, without b)."""
    kept("candidates")
    for columns in _runs(batches, ["key", "node", "p", "q"]):
        key, node, p, q = (x.to_numpy() for x in columns)
        p, q = p.view(np.uint64), q.view(np.uint64)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(begins)
        a_out, b_out = [], []
        few = np.flatnonzero(np.repeat(sizes <= STEPS, sizes))
        for a, b in _within(key[few]):
            a, b = few[a], few[b]
            near = _far(p, q, a, b) <= RADIUS
            a_out.append(node[a[near]])
            b_out.append(node[b[near]])
        for g in np.flatnonzero((sizes > STEPS) & (sizes <= BUCKET)).tolist():
            at = np.arange(begins[g], begins[g + 1])
            for i, reached in spread(len(at), lambda i, others, at=at: _far(p, q, at[i], at[others]) <= RADIUS):  # noqa: B023
                a_out.append(np.full(len(reached), node[at[i]]))
                b_out.append(node[at[reached]])
        a, b = forest(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (a_out, b_out)))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "key": pa.nulls(len(a), pa.int64()), "p": pa.nulls(len(a), pa.int64()), "q": pa.nulls(len(a), pa.int64())})
        many = np.flatnonzero(np.repeat(sizes > BUCKET, sizes))
        if len(many):
            yield pa.RecordBatch.from_pydict({"a": node[many], "b": pa.nulls(len(many), pa.int64()), "key": key[many], "p": p[many].view(np.int64), "q": q[many].view(np.int64)})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the links join: each node with the least one that it reaches."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        s, t = top(x), top(y)
        root[max(s, t)] = min(s, t)
    own = [x for x in root if top(x) != x]
    return np.array(own, np.int64), np.array([top(x) for x in own], np.int64)


def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a key, of rows sorted by task; among both, which does no harm."""
    for columns in _runs(batches, ["task", "node", "p", "q"]):
        task, node, p, q = (x.to_numpy() for x in columns)
        p, q = p.view(np.uint64), q.view(np.uint64)
        for at in np.split(np.arange(len(task)), np.flatnonzero(np.diff(task)) + 1):
            for i, reached in spread(len(at), lambda i, others, at=at: _far(p, q, at[i], at[others]) <= RADIUS):  # noqa: B023
                yield pa.RecordBatch.from_pydict({"a": np.full(len(reached), node[at[i]]), "b": node[at[reached]]})


def dealt(rows: DataFrame, by: str, node: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks of their group that they are in, as ``task``, sorted; a block has about ``block`` rows."""
    blocks = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = rows.join(blocks, by).withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other")).alias("task")
    return each.select(task, *rows.columns).repartition("task").sortWithinPartitions("task")


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what shares a key and lies within RADIUS, of (node, print); no more than rows with keys."""
    found = staged(in_arrow(_keyed(nodes, *exact_bits(nodes.count())).repartition("key").sortWithinPartitions("key"), _candidates, "a long, b long, key long, p long, q long"), "candidates")
    links = found.filter("b IS NOT NULL").select("a", "b").distinct()
    crowded = found.filter("b IS NULL").select("key", F.col("a").alias("node"), "p", "q")
    if crowded.isEmpty():
        return links
    return links.unionByName(in_arrow(dealt(crowded, "key", "node", BUCKET).drop("key"), _near_blocks, "a long, b long"))


def alike(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """A forest of the sets (of distinct hashes, not empty) whose Jaccard similarity is ``least`` or more."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, begins, at = owner[np.argsort(column, kind="stable")], np.cumsum(times) - times, np.cumsum(sizes) - sizes

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = column[at[i] : at[i] + sizes[i]]
        shared = np.bincount(gathered(holders, begins[own], times[own]), minlength=len(sets))[others]
        return shared >= least * (sizes[i] + sizes[others] - shared)

    return spread(len(sets), near)


def similar(docs: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b: nodes) of (id, text) that connect whatever is similar and a candidate.

    ``nodes`` (node, id, digest, size, print) are the distinct sets; ``id`` is a document
    that has the set.  All links returned are similar by ``least``; not all similar pairs are
    returned, but those that aren't are connected by others.

    The sets of a component of candidates are compared with each other through the holders
    of each shingle, a pair of blocks of BLOCK sets a task, and a task hands on a forest: pairs
    are never rows, and a set has one row for each block of its component.
    """
    roots = staged(components(candidates(nodes.filter("size > 0").select("node", "print"))), "roots")
    wanted = staged(nodes.join(roots, "node").select("node", "root", "id", "digest"), "members")
    texts = docs.join(wanted.select("id"), "id", "left_semi")
    # An id may be repeated with other texts: the digest tells which one is meant.
    sets = staged(_hashes(texts, shingle).join(wanted, ["id", "digest"]).select("root", "node", "hashes").dropDuplicates(["node"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("similar")
        for task, node, hashes in _runs(batches, ["task", "node", "hashes"]):
            task, node, ends = task.to_numpy(), node.to_numpy(), hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy()
            a_out, b_out = [], []
            for at in np.split(np.arange(len(task)), np.flatnonzero(np.diff(task)) + 1):
                for i, reached in alike([flat[ends[x] : ends[x + 1]] for x in at.tolist()], least):
                    a_out.append(np.full(len(reached), node[at[i]]))
                    b_out.append(node[at[reached]])
            yield pa.RecordBatch.from_pydict({x: np.concatenate([np.empty(0, np.int64), *y]) for x, y in (("a", a_out), ("b", b_out))})

    return in_arrow(dealt(sets, "root", "node", BLOCK).select("task", "node", "hashes"), run, "a long, b long")


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the one with the least id; columns as in ``docs``.

    Texts with A-Z in lower case are cut into words at ASCII white space and words into
    shingles.  Texts are linked if the Jaccard similarity of their sets of shingles is
    ``least`` or more; texts with the same set are one node, made by a partial
    aggregation, so copies cost a row each.  Distinct sets whose fingerprints are near are
    compared whole (``similar``).

    Null and empty texts have the empty set and are linked with each other only.  Of rows
    that repeat an id one stays (the one whose text hashes least) if one of its texts
    does; rows with a null id can't be told apart and all stay.  An empty table gives an
    empty result.
    """
    row = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), row.alias("row"))
    texts = rows.filter("__id IS NOT NULL").select(F.col("__id").alias("id"), F.col("row").getField(text_col).alias("text"))
    found = staged(_sets(texts, shingle), "shingles")
    # Two texts of one id may both be nodes, so nodes are named by digest and not by id.
    node = F.xxhash64("digest").alias("node")
    nodes = staged(found.groupBy("digest").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("print").alias("print")).select(node, "digest", "id", "size", "print"), "nodes")
    roots = components(similar(texts, nodes, shingle, least))
    named = nodes.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    stay = named.groupBy("root").agg(F.min("id").alias("__kept_id")).select("__kept_id").distinct()
    out = rows.filter("__id IS NOT NULL").join(stay, F.col("__id") == F.col("__kept_id"), "left_semi")
    out = out.groupBy("__id").agg(F.min_by("row", F.xxhash64(F.col("row").getField(text_col))).alias("row")).select("row").unionByName(rows.filter("__id IS NULL").select("row"))
    return out.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
