import random

import pytest
from pyspark.sql import functions as F

from concordance.llm import languages as L
from concordance.llm.queries import op7_languages

SAMPLES = {"en": "the cat sat on the mat and the dog ran home with the cat", "de": "der hund und die katze sind im haus und der hund bellt", "xx": "ababab cdcdcd"}


def plain_phrases(symbols, sample):
    """Greedy longest matches in a sample, by stretches."""
    total = 0
    for begin in range(0, len(symbols), L.STRETCH):
        part, at = symbols[begin : begin + L.STRETCH], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in sample and part[at : at + n] in sample:
                n += 1
            at += n
            total += 1
    return total


@pytest.mark.parametrize("stretch", [1024, 7])
def test_phrases_are_longest_matches(monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    parser = L.CrossParser(SAMPLES)
    r = random.Random(1)
    texts = ["", " 1 2 ", "the", "zzz", "the cat", "zthez", "Katze, HAUS; hund!", "日本語", "a" * 50] + ["".join(r.choice("thecatdog undhz.,1") for _ in range(r.randrange(60))) for _ in range(200)]
    total, size, letters = parser.phrases(texts)
    for i, x in enumerate(texts):
        own = bytes(parser.symbols([x])[0])
        assert size[i] == len(own) and letters[i] == sum(c.isalpha() for c in x)
        assert total[i].tolist() == [plain_phrases(own, bytes(parser.symbols([SAMPLES[n]])[0])) for n in parser.languages], x


def test_a_text_does_not_depend_on_its_batch():
    parser = L.CrossParser(SAMPLES)
    texts = ["the cat", "  der hund. ", "x", "", "katze 12", "und die"]
    alone = [parser([x]) for x in texts]
    langs, scores, rates = parser(texts)
    assert langs == [a[0][0] for a in alone]
    assert scores.tolist() == [a[1][0] for a in alone] and rates.tolist() == [a[2][0] for a in alone]


def test_one_and_no_language():
    assert L.CrossParser({"en": "abc"})(["abd"])[0] == ["en"]
    langs, score, _ = L.CrossParser({})(["abc", None])
    assert langs == ["und", "und"] and score.tolist() == [0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = op7_languages(spark, "/root/testdata/sf0.001").join(docs, "doc_id").filter("held_out")
    assert got.count() > 20
    assert got.filter("lang_pred = lang").count() / got.count() > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_awkward(awkward, no_docs):
    got = L.identify(awkward, awkward).collect()
    assert len(got) == awkward.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.doc_id: r.lang_pred for r in got}[6] == "de"
    assert L.identify(no_docs, awkward).count() == 0
    assert {r.lang_pred for r in L.identify(awkward, no_docs).collect()} == {"und"}


def test_rejection(awkward, no_docs):
    kept = L.in_a_language(awkward, awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "6", "7", "8", "None"]
    other = awkward.filter("doc_id = 1").withColumn("text", F.lit("日本語の文章です"))
    assert L.in_a_language(other, awkward).count() == 0
    assert L.in_a_language(no_docs, awkward).count() == 0


def test_scripts_of_thousands_of_letters():
    """Three languages of words from one block of 6,000 letters, most of them in none of the symbols of their own."""
    r = random.Random(5)
    words = {x: ["".join(chr(0x4E00 + r.randrange(6000)) for _ in range(r.choice((1, 2, 2, 3)))) for _ in range(900)] for x in "abc"}
    text = lambda x, n: "".join(r.choices(words[x], k=n))
    parser = L.CrossParser({x: text(x, 8000) for x in words})
    tested = [(x, text(x, 30)) for x in words for _ in range(100)]
    total, size, _ = parser.phrases([t for _, t in tested])
    best = [parser.languages[i] for i in (total * parser.bits).argmin(1)]
    assert sum(a == b for a, (b, _) in zip(best, tested, strict=True)) >= 297
