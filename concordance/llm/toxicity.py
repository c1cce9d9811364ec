"""Toxicity: class-conditional Kneser-Ney bigram models with shared backoff counts.

Each class (ordinary 0, toxic 1) has an interpolated Kneser-Ney model of words with
discounts of its own.  From the highest order down, each a proper distribution:

* the class's bigram counts, discounted;
* behind them the bigram counts of both classes, discounted by SHARED_DISCOUNT;
* behind them the class's word counts, discounted;
* behind them the continuation counts of both classes, with Kneser-Ney's own discount,
  and behind these the uniform distribution.

A class's discount of a count is what the shared proportion explains of it and
DISCOUNT_SD standard deviations and one more, so that a class departs from the shared
counts where there is evidence, and rare expressions are left to the shared ones.  A
text's statistic is the difference of the two log-likelihoods per word; a logistic
function of it, fitted on labelled rows, is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, kept, prepare, staged, text_slices
from .lookup import Lookup, Reader, parts_for, write_lookup

WORD = re.compile(r"\w+")
#: Texts that a word must be in to have an entry of its own, whatever the number of texts; other words are one.
LEAST_COUNT = 5
#: Of the counts: fold a or b, then the class.
COUNTS = ("a0", "a1", "b0", "b1")
#: Standard deviations in the discount of a class's count, and the discount of a shared bigram count.
DISCOUNT_SD, SHARED_DISCOUNT = 4.0, 3.0
#: Parts that a context's bigrams are dealt to.
CONTEXT_PARTS = 8
#: Labelled rows that the logistic function is fitted on, about, half of them of each class.
FIT_ROWS = 8192
#: Words that a worker remembers; beyond it, it forgets and starts anew.
REMEMBERED = 150_000
#: Bytes of text that are counted, and that are scored, at once.
SLICE, SCORED = 1 << 21, 1 << 20
#: Of a word: its id, its probability by class, and as a context what its bigrams need.
WORD_VALUES = ("id", "p0", "p1", "per0", "per1", "left0", "left1", "per", "left")


def word_key(word: str) -> int:
    """The 64-bit key of a word, signed."""
    x = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


class Lexicon:
    """Rows of a table of words by word; slot 0 is the unknown word's."""

    def __init__(self, table: Lookup, unknown: np.ndarray):
        self.read, self.unknown = table.reader(), unknown
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.rows = self.unknown[None, :]

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """The slots of all words of the texts, one after another; ``rows`` has their values."""
        if len(self.slots) > REMEMBERED:
            self._forget()
        slots = self.slots
        new = [w for w in set().union(*texts) if w not in slots]
        if new:
            here, rows = self.read(np.array([word_key(w) for w in new], np.int64))
            at = iter(range(len(self.rows), len(self.rows) + int(here.sum())))
            slots.update((w, next(at) if h else 0) for w, h in zip(new, here.tolist(), strict=True))
            self.rows = np.concatenate([self.rows, rows[here]])
        return np.fromiter((s for words in texts for s in map(slots.__getitem__, words)), np.int64)


def in_order(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
    """The words of each text in lower case, and their number."""
    words = [WORD.findall(x.lower()) if x else [] for x in texts]
    return words, np.array([len(x) for x in words], np.int64)


def words_before(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The id before each; 0 at a text's begin."""
    before = np.concatenate([[0], ids[:-1]]).astype(np.int64) if len(ids) else ids
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return before


@dataclass(frozen=True)
class Model:
    """Where the tables are, and the few numbers that go with them.

    ``words``: WORD_VALUES by ``word_key``; ``unknown``: those of all other words;
    ``bigrams``: discounted counts (class 0, class 1, both) by id before x ``n`` + id;
    ``fit``: intercept and slope of the score; ``prior``: the score of a text without words.
    """

    words: Lookup
    unknown: tuple[float, ...]
    bigrams: Lookup
    n: int
    fit: tuple[float, float] = (0.0, 0.0)
    prior: float = 0.5


class Scorer:
    """A worker's view of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.words, np.array(model.unknown))
        self.bigrams: Reader = model.bigrams.reader()

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By class, of every word after the one before it; and words by text."""
        words, counts = in_order(texts)
        slots = self.lexicon(words)
        rows = dict(zip(WORD_VALUES, self.lexicon.rows.T, strict=True))
        ids = rows["id"].astype(np.int64)[slots]
        before_slot = words_before(slots, counts)
        before = rows["id"].astype(np.int64)[before_slot]
        _, found = self.bigrams(before * self.model.n + ids)
        both = found[:, 2] * rows["per"][before_slot]
        out = np.empty((2, len(ids)))
        for c in (0, 1):
            behind = both + rows["left"][before_slot] * rows[f"p{c}"][slots]
            out[c] = found[:, c] * rows[f"per{c}"][before_slot] + rows[f"left{c}"][before_slot] * behind
        return out, counts

    def statistic(self, texts: list[str | None]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood per word; not a number for a text without words."""
        p, counts = self.probabilities(texts)
        text = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(text, np.log(p[1]) - np.log(p[0]), len(texts))
        return np.divide(total, counts, out=np.full(len(texts), np.nan), where=counts > 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.model.fit
        x = self.statistic(texts)
        return np.where(np.isnan(x), self.model.prior, 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700))))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Texts with their label (0 or 1), as a written table: (id, text, toxic).

    The labels lie in a table that workers search by id (its hash, where ids are no
    integers), so documents aren't shuffled; only those with a label are written.  An id
    with several labels counts as toxic if one of them is.
    """
    key = lambda rows: F.col(id_col).cast("long") if rows.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(F.col(id_col).cast("string"))
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(key(labels).alias("key")).agg(F.max(label_col).alias("toxic"))
    known = staged(known, "labels")
    table = write_lookup(known, "key", ["toxic"], parts_for(known.count()), "labels")
    discard(known)
    prepare(docs.sparkSession)

    @F.arrow_udf("int")
    def label(keys: pa.Array) -> pa.Array:
        own = kept(("toxicity labels", table))
        read = own["it"] if own else own.setdefault("it", table.reader())
        here, found = read(keys.to_numpy(zero_copy_only=False))
        return pa.array(found[:, 0].astype(np.int32), mask=~here)

    some = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    # Spark would evaluate a deterministic function in the filter and again in what is written, each in a worker of its own.
    some = some.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.asNondeterministic()(key(docs)).alias("toxic"))
    return staged(some.filter("toxic IS NOT NULL"), "labelled")


def _flush(counts: tuple[Counter, ...]) -> pa.RecordBatch:
    words = [*set().union(*counts)]
    out = pa.RecordBatch.from_pydict({"hash": pa.array(map(word_key, words), pa.int64())} | {x: pa.array([c[w] for w in words], pa.int64()) for x, c in zip(COUNTS, counts, strict=True)})
    for c in counts:
        c.clear()
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each word, by fold and class."""
    kept("toxicity")
    counts = tuple(Counter() for _ in COUNTS)
    for batch in batches:
        for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            counts[kind].update(set(WORD.findall(text.lower())))
            if sum(map(len, counts)) > 150_000:
                yield _flush(counts)
    yield _flush(counts)


def _bigram_counts(table: Lookup, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with each bigram, by fold and class: key x 4 + kind."""
        own = kept(("toxicity words", table))
        lexicon = own.setdefault("lexicon", Lexicon(table, np.zeros(1)))
        for batch in batches:
            begin, all_kinds = 0, batch.column("kind").to_numpy()
            for some in text_slices(batch.column("text"), SLICE):
                words, counts = in_order(some)
                slots = lexicon(words)
                ids = lexicon.rows[:, 0].astype(np.int64)[slots]
                key = words_before(ids, counts) * n + ids
                text = np.repeat(np.arange(len(some)), counts)
                # A text's bigrams once: equal pairs of text and key have equal mixtures.
                mixture = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                once = np.unique(mixture, return_index=True)[1]
                kind = all_kinds[begin : begin + len(some)][text[once]]
                begin += len(some)
                keys, texts = np.unique(key[once] * len(COUNTS) + kind, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": keys, "texts": texts.astype(np.int32)})

    return run


def excess(count: Column, both: Column, share: float) -> Column:
    """What is left of a class's count: beyond its part of the shared count, DISCOUNT_SD standard deviations and one."""
    expected = both * share
    return F.greatest(count - expected - DISCOUNT_SD * F.sqrt(expected * (1 - share)) - 1, F.lit(0.0))


def train(labelled: DataFrame) -> Model | None:
    """Fit the model on a written table (id, text, toxic); None if a class has no row.

    Counts are numbers of texts that hold a word or bigram, so that one text repeating
    itself teaches nothing, and are over all rows.  To fit the logistic function on texts
    that its model has not seen, counts are kept in two folds, four fifths and a fifth by a
    hash of the id: the larger fold's model gives the statistic of the other's texts, and
    both folds together the final model.  Where a fold lacks a class, the final model gives
    the statistics of all rows.

    The model's tables grow with the labelled texts and lie in the shared folder; the
    driver has one row a part of them.  Bounded are only the statistics that the logistic
    function is fitted on: those of about ``FIT_ROWS`` rows drawn by a hash of their id,
    weighted by the part of their class that was drawn.
    """
    fold = (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)) == 0).cast("int")
    texts = labelled.select("id", "text", "toxic", (2 * fold + F.col("toxic")).cast("int").alias("kind"))
    sizes = texts.agg(*(F.count_if(F.col("kind") == k) for k in range(len(COUNTS)))).first()
    if not (sizes[0] + sizes[2] and sizes[1] + sizes[3]):
        return None
    sums = [F.sum(x).alias(x) for x in COUNTS]
    every = sum((F.col(x) for x in COUNTS[1:]), F.col(COUNTS[0]))
    kinds = ", ".join(f"{x} long" for x in COUNTS)
    counted = staged(in_arrow(texts.select("text", "kind"), _word_counts, f"hash long, {kinds}").groupBy("hash").agg(*sums).filter(every >= LEAST_COUNT), "words")
    # Ids ascend by part and hash; a part's base is the number of words in those before it.
    n_words = counted.count()
    n_parts, n = parts_for(n_words), n_words + 1
    words = counted.withColumn("part", F.pmod("hash", F.lit(n_parts)))
    bases = words.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("hash"))
    words = staged(words.withColumn("rank", rank).join(F.broadcast(bases), "part").select((F.col("base") + F.col("rank")).alias("id"), "hash", *COUNTS), "words")
    discard(counted)
    listed = write_lookup(words, "hash", ["id"], n_parts, "ids")
    # One exchange, by context and a part of its bigrams: what is summed by context later is nearly in place.
    pairs = in_arrow(texts.select("text", "kind"), _bigram_counts(listed, n), "key long, texts int")
    key, before = F.expr(f"key div {len(COUNTS)}"), F.expr(f"key div {n * len(COUNTS)}")
    part = F.pmod(key, F.lit(CONTEXT_PARTS))
    of_kind = lambda k: F.sum(F.when(F.pmod("key", F.lit(len(COUNTS))) == k, F.col("texts")).otherwise(0))
    pairs = pairs.repartition(before, part).groupBy(before.alias("before"), part.alias("part"), key.alias("key")).agg(*(of_kind(k).alias(x) for k, x in enumerate(COUNTS)))
    pairs = staged(pairs.select("key", *COUNTS), "bigrams")
    final = _model(words, pairs, n, n_parts, ("a0 + b0", "a1 + b1"))
    if all(sizes):
        fitted, rows, of_class = _model(words, pairs, n, n_parts, ("a0", "a1")), texts.filter("kind >= 2"), sizes[2:]
    else:
        fitted, rows, of_class = final, texts, (sizes[0] + sizes[2], sizes[1] + sizes[3])
    steps = [-(-x * 2 // FIT_ROWS) for x in of_class]
    step = F.when(F.col("toxic") == 0, steps[0]).otherwise(steps[1])
    for table in (words, pairs):
        discard(table)
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("fit")), step) == 0)
    found = drawn.select("toxic", scorer(drawn, fitted, "statistic")(F.col("text")).alias("x")).toArrow()
    x, toxic = found["x"].to_numpy(), found["toxic"].to_numpy().astype(float)
    x, toxic = x[~np.isnan(x)], toxic[~np.isnan(x)]
    fit = calibrated(x, toxic, np.where(toxic == 0, *steps))
    return replace(final, fit=fit, prior=(sizes[1] + sizes[3] + 1) / (sum(sizes) + 2))


def _model(words: DataFrame, pairs: DataFrame, n: int, n_parts: int, counts: tuple[str, str]) -> Model:
    """The model of the counts that two expressions give: ordinary, toxic."""
    of_class = lambda rows, *names: rows.select(*names, *(F.expr(x).cast("double").alias(f"n{c}") for c, x in enumerate(counts)))
    both = F.col("n0") + F.col("n1")
    pairs = of_class(pairs, "key").filter(both > 0)
    seen = pairs.agg(F.sum("n0"), F.sum("n1"), F.count_if(both == 1), F.count_if(both == 2), F.count(F.lit(1))).first()
    share = [(x or 0.0) / max(1.0, (seen[0] or 0.0) + (seen[1] or 0.0)) for x in seen[:2]]
    once, twice, types = seen[2:]
    continuation_discount = once / (once + 2 * twice) if once else 0.5
    pairs = pairs.select("key", both.alias("both"), "n0", "n1", *(excess(F.col(f"n{c}"), both, share[c]).alias(f"e{c}") for c in (0, 1)), F.greatest(both - SHARED_DISCOUNT, F.lit(0.0)).alias("e"))
    before, word = F.expr(f"key div {n}").alias("id"), F.pmod("key", F.lit(n)).alias("id")
    sums = ("n0", "n1", "both", "e0", "e1", "e")
    contexts = pairs.groupBy(before).agg(*(F.sum(x).alias(f"sum_{x}") for x in sums))
    after = pairs.groupBy(word).agg(F.count(F.lit(1)).cast("double").alias("types"))

    texts = of_class(words, "id", "hash")
    total = texts.agg(F.sum("n0"), F.sum("n1")).first()
    word_share = [(x or 0.0) / max(1.0, (total[0] or 0.0) + (total[1] or 0.0)) for x in total]
    # A table of local rows would start another daemon and its workers in the executors.
    rows = texts.unionByName(texts.sparkSession.range(0, 1, 1, 1).selectExpr("id", "CAST(NULL AS LONG) AS hash", "0D AS n0", "0D AS n1"))
    rows = rows.select("id", "hash", *(excess(F.col(f"n{c}"), F.col("n0") + F.col("n1"), word_share[c]).alias(f"x{c}") for c in (0, 1)))
    rows = rows.join(contexts, "id", "left").join(after, "id", "left").fillna(0.0, [*(f"sum_{x}" for x in sums), "types"])
    rows = staged(rows, "rows")
    sum_ = rows.agg(F.sum("x0"), F.sum("x1"), F.sum(F.least("types", F.lit(continuation_discount)))).first()
    shared = (F.greatest(F.col("types") - continuation_discount, F.lit(0.0)) + sum_[2] / n) / max(1, types) if types else F.lit(1.0 / n)
    per = lambda x: F.when(F.col(x) > 0, 1 / F.col(x)).otherwise(0.0)
    left = lambda kept_, all_: F.when(F.col(all_) > 0, 1 - F.col(kept_) / F.col(all_)).otherwise(1.0)
    values = {"id": F.col("id").cast("double")}
    for c in (0, 1):
        size = (total[c] or 0.0) or 1.0
        values[f"p{c}"] = F.col(f"x{c}") / size + (1 - sum_[c] / size) * shared
        values |= {f"per{c}": per(f"sum_n{c}"), f"left{c}": left(f"sum_e{c}", f"sum_n{c}")}
    values |= {"per": per("sum_both"), "left": left("sum_e", "sum_both")}
    values_ = rows.select("hash", *(values[x].alias(x) for x in WORD_VALUES))
    unknown = values_.filter("hash IS NULL").select(*WORD_VALUES).first()
    found = pairs.filter("e0 > 0 OR e1 > 0 OR e > 0").select("key", "e0", "e1", "e")
    found = staged(found, "discounted")
    model = Model(write_lookup(values_.filter("hash IS NOT NULL"), "hash", [*WORD_VALUES], n_parts, "words"), tuple(unknown), write_lookup(found, "key", ["e0", "e1", "e"], parts_for(found.count()), "bigrams"), n)
    for table in (rows, found):
        discard(table)
    return model


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Intercept and slope of the logistic function that fits labels to statistics best.

    Newton's method on the weighted log-likelihood with one row's worth of a Gaussian
    prior on the slope of the standardised statistic, which keeps it finite where
    the classes are apart.  Of one class only: the smoothed share of toxic rows.
    """
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    share = (weight @ y + 1) / (weight.sum() + 2)
    mean, sd = (np.average(x, weights=weight), float(np.sqrt(np.cov(x, aweights=weight)))) if len(x) > 1 else (0.0, 0.0)
    at = np.array([np.log(share / (1 - share)), 0.0])
    if not (sd > 0 and 0 < y.sum() < len(y)):
        return float(at[0]), 0.0
    z = np.stack([np.ones(len(x)), (x - mean) / sd])
    ridge = np.array([0.0, 1.0])
    loss = lambda at: weight @ (np.logaddexp(0, at @ z) - y * (at @ z)) + ridge @ at**2 / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -700, 700)))
        slope = z @ (weight * (p - y)) + ridge * at
        step = np.linalg.solve((z * (weight * p * (1 - p))) @ z.T + np.diag(ridge + 1e-9), slope)
        scale = 1.0
        while loss(at - scale * step) > loss(at) and scale > 1e-6:
            scale /= 2
        at = at - scale * step
        if abs(scale * step).max() < 1e-10:
            break
    return float(at[0] - at[1] * mean / sd), float(at[1] / sd)


def scorer(docs: DataFrame, model: Model, what: str = "score") -> Callable[[Column], Column]:
    """A function from a text column to the score or statistic; Arrow batches, no shuffle."""
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        own = kept(("toxicity", model))
        it = own.setdefault("it", Scorer(model)) if not own else own["it"]
        parts = [getattr(it, what)(some) for some in text_slices(texts, SCORED)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return run


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Score every whole text of ``docs``: id, ``keep`` columns, ``score``, ``predicted``.

    The model learns from ``train_docs`` joined with ``labels`` by id.  ``score`` is in
    0 to 1, ``predicted`` 1 if it is at least ``threshold``.  Very long texts are scored
    whole.  Texts without words, null and empty ones too, get the smoothed share of toxic
    labels; without labels of both classes every text does.  Null ids and
    repeated rows are scored like others; an empty table gives an empty result.

    No shuffle of ``docs``; a worker searches the model's tables in the shared folder
    (mapped into memory where that is a local or mounted one).
    """
    labelled = labelled_texts(train_docs, labels, id_col, text_col, label_col)
    model = train(labelled)
    if model is None:
        rows, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        score = F.lit((toxic + 1) / (rows + 2))
    else:
        score = scorer(docs, model)(F.col(text_col))
    discard(labelled)
    out = docs.select(F.col(id_col), *keep, score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``; columns as in ``docs``.

    Without labels of both classes all rows stay: there is nothing to tell by.
    """
    labelled = labelled_texts(train_docs, labels, id_col, text_col, label_col)
    model = train(labelled)
    discard(labelled)
    if model is None:
        return docs
    row = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), scorer(docs, model)(F.col(text_col)).alias("score"))
    return row.filter(F.col("score") < threshold).select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
