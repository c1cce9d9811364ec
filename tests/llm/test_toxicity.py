import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordance.llm import toxicity as X
from concordance.llm.queries import op2_toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op2_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").toPandas()
    assert (got.toxic == got.predicted).mean() > 0.97
    assert got.predicted[got.toxic == 1].mean() > 0.85
    assert got.predicted[got.toxic == 0].mean() < 0.02
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, k=40)) + (" vile foul" if i % 5 == 1 else ""), int(i % 5 == 1)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


class Brute:
    """The model by its definition, with dictionaries: texts by class, probabilities one at a time."""

    def __init__(self, rows, vocabulary):
        self.known = vocabulary
        split = [(["", *(w if w in vocabulary else "" for w in re.findall(r"\w+", text.lower()))], y) for text, y in rows]
        self.words, self.pairs = [Counter(), Counter()], [Counter(), Counter()]
        for words, y in split:
            self.words[y].update(set(words[1:]) - {""})
            self.pairs[y].update(set(itertools.pairwise(words)))
        self.both = self.pairs[0] + self.pairs[1]
        self.after = Counter(w for _, w in self.both)
        once, twice = (sum(n == k for n in self.both.values()) for k in (1, 2))
        self.d = once / (once + 2 * twice)

    def excess(self, counts, c, x):
        share = counts[c].total() / (counts[0].total() + counts[1].total())
        expected = share * (counts[0][x] + counts[1][x])
        return max(0.0, counts[c][x] - expected - X.DISCOUNT_SD * math.sqrt(expected * (1 - share)) - 1)

    def word(self, c, w):
        n_words = len(self.known) + 1
        shared = max(self.after[w] - self.d, 0) / len(self.both) + sum(min(n, self.d) for n in self.after.values()) / len(self.both) / n_words
        total = self.words[c].total()
        left = 1 - sum(self.excess(self.words, c, x) for x in self.known) / total
        return self.excess(self.words, c, w) / total + left * shared

    def pair(self, c, v, w):
        every, own = ([(x, n) for x, n in counts.items() if x[0] == v] for counts in (self.both, self.pairs[c]))
        behind, total = self.word(c, w), sum(n for _, n in every)
        if total:
            behind = max(self.both[v, w] - X.SHARED_DISCOUNT, 0) / total + sum(min(n, X.SHARED_DISCOUNT) for _, n in every) / total * behind
        total = sum(n for _, n in own)
        return (self.excess(self.pairs, c, (v, w)) + sum(n - self.excess(self.pairs, c, x) for x, n in own) * behind) / total if total else behind


@pytest.fixture(scope="module")
def trained(corpus):
    labelled = X.labelled_texts(corpus.drop("toxic"), corpus.drop("text"), "doc_id", "text", "toxic")
    rows = labelled.collect()
    assert sorted((r.id, r.toxic) for r in rows) == sorted((r.doc_id, r.toxic) for r in corpus.collect())
    seen = Counter(w for r in rows for w in set(r.text.lower().split()))
    brute = Brute([(r.text, r.toxic) for r in rows], {w for w, n in seen.items() if n >= X.LEAST_COUNT})
    return X.Scorer(X.train(labelled)), brute


def test_probabilities_are_those_of_brute_force(trained):
    scorer, brute = trained
    assert scorer.model.n == len(brute.known) + 1
    texts = ["w1 w2 w3 vile foul w4", "Vile w5 foul, foul vile", "unheard w7 of w7 w7 w8 vile", "w9"]
    got, counts = scorer.probabilities(texts)
    pairs = [p for x in texts for p in itertools.pairwise(["", *(w if w in brute.known else "" for w in re.findall(r"\w+", x.lower()))])]
    assert counts.tolist() == [6, 5, 7, 1]
    for c in (0, 1):
        assert got[c] == pytest.approx([brute.pair(c, *p) for p in pairs], rel=1e-9)
    assert scorer.statistic(texts)[3] == pytest.approx(np.log(got[1, -1] / got[0, -1]))
    assert brute.pair(1, "w1", "vile") > 2 * brute.pair(0, "w1", "vile")
    assert brute.word(1, "w1") / brute.word(0, "w1") == pytest.approx(brute.word(1, "w2") / brute.word(0, "w2"))


def test_distributions_sum_to_one(trained):
    scorer, brute = trained
    words = [*sorted(brute.known), "unheardof"]
    for context in ("w1", "vile", "foul", "unheardof"):
        p, counts = scorer.probabilities([f"{context} {w}" for w in words])
        assert p[:, 1::2].sum(1) == pytest.approx([1, 1], rel=1e-9)
    assert np.isnan(scorer.statistic(["", None, "..."])).all()
    assert scorer.score(["", None, "..."]) == pytest.approx([81 / 402] * 3)


def test_statistic_is_the_mean_log_ratio(trained):
    scorer, _ = trained
    p, _ = scorer.probabilities(["w1 vile foul", "w3 w4"])
    ratio = np.log(p[1] / p[0])
    assert scorer.statistic(["w1 vile foul", None, "w3 w4"]) == pytest.approx([ratio[:3].mean(), np.nan, ratio[3:].mean()], nan_ok=True)


def test_logistic_function():
    x = np.array([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
    y = np.array([0, 0, 1, 0, 1, 0, 1, 1.0])
    a, b = X.calibrated(x, y)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert (p - y).sum() == pytest.approx(0, abs=1e-6)  # the intercept has no prior
    assert a + b * 0.35 == pytest.approx(0, abs=0.1) and b > 0
    a, b = X.calibrated(np.array([0, 0.1, 0.9, 1.0]), np.array([0, 0, 1, 1.0]))
    assert np.isfinite([a, b]).all() and -a / b == pytest.approx(0.5)
    assert X.calibrated(np.array([0.2, 0.4]), np.array([1.0, 1.0])) == (pytest.approx(np.log(3)), 0.0)
    assert X.calibrated(np.empty(0), np.empty(0)) == (0.0, 0.0)


def test_a_fold_without_toxic_rows(spark, corpus):
    """One toxic label only lies in one of the two folds; the model is fitted all the same."""
    few = corpus.filter("toxic = 0 OR doc_id = 1").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("vile foul "), 30)).otherwise(F.col("text")))
    assert X.train(few.withColumnRenamed("doc_id", "id")) is not None
    assert X.train(few.filter("toxic = 0").withColumnRenamed("doc_id", "id")) is None
    assert X.not_toxic(few.drop("toxic"), few.drop("toxic"), few.select("doc_id", F.lit(1).alias("toxic"))).count() == few.count()


def test_awkward(spark, awkward, no_docs, corpus):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (4, None), (5, 7), (6, 0)], "doc_id long, toxic int")
    got = X.toxicity(awkward, awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert X.toxicity(no_docs, awkward, labels).count() == 0
    one = {r.score for r in X.toxicity(awkward, no_docs, labels).collect()}
    assert len(one) == 1
    judged = {r.doc_id: r for r in X.toxicity(corpus, corpus, corpus.select("doc_id", "toxic")).collect()}
    assert all(judged[i].predicted == (i % 5 == 1) for i in range(400))
    assert X.toxicity(awkward, corpus, corpus.select("doc_id", "toxic")).filter("predicted = 1").count() == 0


def test_rejection(corpus, awkward):
    extra = corpus.withColumn("score", F.lit("s")).withColumn("row", F.lit(1)).drop("toxic")
    kept = X.not_toxic(extra, corpus, corpus.select("doc_id", "toxic"))
    assert kept.columns == extra.columns and kept.count() == 320
    assert kept.filter("doc_id % 5 = 1").count() == 0
    assert X.not_toxic(awkward, corpus, corpus.select("doc_id", "toxic")).count() == awkward.count()


def test_entries_need_the_same_count_on_large_tables(spark):
    """1.6 million word-text counts, of which a word and its bigram have six."""
    common = " ".join(f"w{i}" for i in range(400))
    texts = F.when(F.col("id") < 6, f"rarevile phrase {common}").otherwise(common)
    rows = spark.range(4000).select("id", texts.alias("text"), (F.col("id") < 6).cast("int").alias("toxic"))
    scorer = X.Scorer(X.train(rows))
    evidence, ordinary = scorer.statistic(["rarevile phrase", "w1 w2 w3"])
    assert evidence > 1 and ordinary < 0
    here, found = scorer.lexicon.read(np.array([X.word_key(x) for x in ("rarevile", "phrase", "absent")]))
    assert here.tolist() == [True, True, False]
    assert scorer.bigrams((found[:1, 0] * scorer.model.n + found[1:2, 0]).astype(np.int64))[0].all()


def test_lookup_in_parts(spark, monkeypatch):
    from concordance.llm import lookup as L

    rows = spark.range(1000).select(F.xxhash64("id").alias("key"), F.col("id").cast("double").alias("x"), (-F.col("id")).alias("y"))
    table = L.write_lookup(rows, "key", ["x", "y"], 7, "numbers")
    keys = np.array([r.key for r in rows.orderBy("x").collect()] + [5, -5])
    want = np.array([[i, -i] for i in range(1000)] + [[0, 0]] * 2)
    for local in (True, False):
        read = table.reader()
        if not local:
            plain = L.mapped
            monkeypatch.setattr(L, "mapped", lambda *x: np.array(plain(*x)))
        here, got = read(keys)
        assert here.tolist() == [True] * 1000 + [False] * 2 and (got == want).all()
        assert len(read.parts) == (7 if local else L.HELD_PARTS)
    assert L.write_lookup(rows.limit(0), "key", ["x", "y"], 1, "none").reader()(keys)[0].sum() == 0
