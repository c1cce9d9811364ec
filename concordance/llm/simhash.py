"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

Fingerprints are linked if they differ in at most two bits.  A fingerprint is cut
into three segments of 22, 21 and 21 bits.  Two differing bits leave one segment
alone (pigeonhole), and the next segment has at most two errors.  So a key is one
segment as it is, together with a codeword index of the next one.

A segment, filled up with zeros to 23 bits, is decoded with the perfect Golay code:
every word lies within 3 bits of just one codeword.  A word at distance 3 also gets
the five codewords at distance 4.  Then any two words that differ in two bits or fewer
have a codeword in common, at one to six keys a word.  What shares a key is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, kept, prepare, staged, text_slices
from .components import components

#: A to Z in lower case, byte by byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a shingle, hash seed, and differing bits that still link.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Low bit and bits of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code of 23 bits, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
#: Fingerprints of a key that one task compares with each other; more are refined or dealt out.
BUCKET = 512


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text's UTF-8: bit i is 1 if it is in over half of the shingles' hashes; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]).tolist()
    stops = [x - 1 for x in ends[shingle - 1 :]] or [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip([0, *ends[: n - 1]], stops, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i, byte in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        counts[8 * i : 8 * i + 8] = np.bincount(byte, minlength=256) @ BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Of the syndromes (23-bit word modulo the generator): the leader, and the other errors to codewords at distance 4.

    The second has -1 where there are none: only leaders of weight 3 have five.
    """

    def remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> shift + 11 & 1:
                word ^= GENERATOR << shift
        return word

    single = [remainder(1 << i) for i in range(23)]
    leader = np.full(2048, -1, np.int64)
    fours: list[list[int]] = [[] for _ in range(2048)]
    for a in range(-1, 23):
        for b in range(a, 23) if a < 0 else range(a + 1, 23):
            for c in range(b, 23) if b < 0 else range(b + 1, 23):
                picked = [x for x in (a, b, c) if x >= 0]
                s = 0
                for x in picked:
                    s ^= single[x]
                leader[s] = sum(1 << x for x in picked)
                if len(picked) == 3:
                    for d in range(c + 1, 23):
                        fours[s ^ single[d]].append(sum(1 << x for x in (*picked, d)))
    other = np.full((2048, 5), -1, np.int64)
    for s in range(2048):
        if int(leader[s]).bit_count() == 3:
            other[s] = fours[s]
    return leader, other


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 11 bits (themselves) and of the high 12 bits of a word."""
    high = np.zeros(4096, np.int64)
    for x in range(4096):
        word = x << 11
        for shift in range(11, -1, -1):
            if word >> shift + 11 & 1:
                word ^= GENERATOR << shift
        high[x] = word
    return np.arange(2048), high


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the nearby codewords of 23-bit words; shape (words, 6), -1 where there are fewer."""
    leader, other = golay()
    _, high = _syndromes()
    s = (words & 2047) ^ high[words >> 11]
    out = np.empty((len(words), 6), np.int64)
    out[:, 0] = (words ^ leader[s]) >> 11
    out[:, 1:] = np.where(other[s] >= 0, (words[:, None] ^ other[s]) >> 11, -1)
    return out


def segment(prints: np.ndarray, i: int) -> np.ndarray:
    at, bits = SEGMENTS[i % 3]
    return (prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)


def keys(prints: np.ndarray, finer: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64), and whose they are.

    Key: number and value of the exact segment, codeword of the next one, and for finer
    keys also of the one after it, at up to six times as many keys.
    """
    found, owners = [], []
    for i in range(3):
        near = codewords(segment(prints, i + 1))
        owner, column = np.nonzero(near >= 0)
        key = (segment(prints, i)[owner] << 12 | near[owner, column]) << 2 | i
        if finer:
            after = codewords(segment(prints, i + 2))[owner]
            at, column = np.nonzero(after >= 0)
            owner, key = owner[at], key[at] | after[at, column] << 36
        found.append(key)
        owners.append(owner)
    return np.concatenate(found), np.concatenate(owners)


def forest(prints: np.ndarray, ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that join what the index pairs within MAX_BITS of each other join, without circles."""
    root = np.arange(len(prints))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    for a, b in pairs:
        near = np.bitwise_count(prints[a] ^ prints[b]) <= MAX_BITS
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                a_out.append(x)
                b_out.append(y)
    return ids[a_out] if a_out else ids[:0], ids[b_out] if b_out else ids[:0]


def _within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with equal keys, of sorted keys: each with the next, the one after it and so on."""
    alive = np.arange(len(key) - 1)
    step = 1
    while len(alive):
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive] == key[alive + step]]
        yield alive, alive + step
        step += 1


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within keys, of rows (key, print, id) sorted by key; a key that goes on in the next batch waits for it."""
    held = (np.empty(0, np.int64),) * 3

    def links(key, prints, ids):
        a, b = forest(prints.view(np.uint64), ids, _within(key))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        rows = tuple(np.concatenate([h, batch.column(x).to_numpy()]) for h, x in zip(held, ("key", "print", "id"), strict=True))
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = tuple(x[cut:] for x in rows)
        if cut:
            yield links(*(x[:cut] for x in rows))
    if len(held[0]):
        yield links(*held)


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a key, of rows (task, side, print, id) sorted by task."""
    held = (np.empty(0, np.int64),) * 4

    def links(task, side, prints, ids):
        for t in np.unique(task):
            here = np.flatnonzero(task == t)
            left, right = here[side[here] == 0], here[side[here] == 1]
            pairs = ((np.full(len(right), x), right) for x in left) if len(right) else ((np.full(len(left) - i - 1, x), left[i + 1 :]) for i, x in enumerate(left))
            a, b = forest(prints.view(np.uint64), ids, pairs)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        rows = tuple(np.concatenate([h, batch.column(x).to_numpy()]) for h, x in zip(held, ("task", "side", "print", "id"), strict=True))
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = tuple(x[cut:] for x in rows)
        if cut:
            yield from links(*(x[:cut] for x in rows))
    if len(held[0]):
        yield from links(*held)


def _keyed(prints: DataFrame, finer: bool) -> DataFrame:
    """(key, print, id) for all keys of (print, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, ids = batch.column("print").to_numpy(), batch.column("id").to_numpy()
            key, owner = keys(p.view(np.uint64), finer)
            yield pa.RecordBatch.from_pydict({"key": key, "print": p[owner], "id": ids[owner]})

    return in_arrow(prints, run, "key long, print long, id long")


def _crowded(keyed: DataFrame) -> DataFrame:
    """Keys of over BUCKET rows, with their rows; one partial aggregation."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b: ids) that connect all (print, id) within two bits; prints must be distinct.

    The fingerprints are counted by key first.  Keys of at most BUCKET fingerprints are
    compared where the shuffle brings them together.  Fingerprints of a more crowded key
    take finer keys, which hold the codeword of the third segment too; should one of these
    be crowded still, its fingerprints are dealt into blocks of about BUCKET, and each pair
    of blocks is a task of its own.  A task hands on no more links than it has fingerprints.
    """
    keyed = staged(_keyed(prints, False), "keys")
    crowded = staged(_crowded(keyed), "crowded")
    if crowded.isEmpty():
        return _in_buckets(keyed)
    out = [_in_buckets(keyed.join(crowded.select("key"), "key", "left_anti"))]
    members = keyed.join(crowded.select("key"), "key", "left_semi").select("print", "id").distinct()
    finer = staged(_keyed(members, True), "keys")
    dense = staged(_crowded(finer), "crowded")
    out.append(_in_buckets(finer.join(dense.select("key"), "key", "left_anti")))
    if not dense.isEmpty():
        blocks = F.ceil(F.col("n") / BUCKET).cast("int")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = finer.join(dense.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
        dealt = dealt.select("key", "print", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        tasks = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long").alias("side"), "print", "id")
        tasks = tasks.repartition("task").sortWithinPartitions("task")
        out.append(in_arrow(tasks, _link_blocks, "a long, b long"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def _in_buckets(keyed: DataFrame) -> DataFrame:
    return in_arrow(keyed.repartition("key").sortWithinPartitions("key"), _link_buckets, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print): the whole texts' fingerprints as longs; one narrow pass."""
    prepare(docs.sparkSession)

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        kept("simhash")
        out = [fingerprint((x or "").encode(), shingle) for some in text_slices(texts) for x in some]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("id"), run(F.col(text_col)).alias("print"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts with A-Z in lower case are cut into words at ASCII white space and words into
    shingles, repeats included (a shorter text is one shingle); hashes are XXH64 with seed
    42.  ``component_id`` is the least id reachable over fingerprints that differ in at
    most two bits.  Equal fingerprints are one node, made by a partial aggregation, so
    copies cost a row each and no more.

    Null and empty texts have fingerprint 0 and are linked like others.  Rows with a null
    id belong to their fingerprint's component but name none (component_id is null if it
    has null ids only).  Repeated rows are returned as they are; an empty table gives an
    empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("id").alias("id")), "nodes")
    roots = components(links(nodes.filter("id IS NOT NULL")))
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("print", F.coalesce("root", "id").alias("component_id"))
    named = staged(named, "components")
    return prints.join(named, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id; columns as in ``docs``.

    Of rows that repeat an id one stays (the one whose text hashes least); rows with a
    null id can't be told apart and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, shingle).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept_id")).distinct()
    row = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), row.alias("row"))
    found = rows.filter("__id IS NOT NULL").join(kept, F.col("__id") == F.col("__kept_id"), "left_semi")
    out = found.groupBy("__id").agg(F.min_by("row", F.xxhash64(F.col("row").getField(text_col))).alias("row")).select("row").unionByName(rows.filter("__id IS NULL").select("row"))
    return out.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
