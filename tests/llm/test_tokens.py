import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from concordance.llm import encoding, packing, token_counts, token_files

WORD, BYTE, PIECE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = [*"abcdefgABC" * 3, *"  \n\n.,|'!%*0123-_" * 2, *"éèñüßΣςİıáà̧́̈你好ﬁ①²½\t\r\x0b\x1c\x85\xa0 ​　▁😀�", "'s", "'ll", "don't", "<|endoftext|>", "</s>", "<s>", "  ", "\n\n", "the ", "..", " |", "▁▁"]


@pytest.fixture
def random_texts():
    r = random.Random(7)
    return ["".join(r.choices(ALPHABET, k=r.randrange(40))) for _ in range(4000)]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("segment", [16, 1 << 18])
def test_ids_are_the_librarys(path, segment, random_texts, monkeypatch):
    cut = encoding.segments
    monkeypatch.setattr(encoding, "segments", lambda x, **more: cut(x, segment, **more))
    monkeypatch.setattr(encoding, "SEGMENT", segment)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoding.IdEncoder(path)(random_texts)]
    assert got == [x.ids for x in Tokenizer.from_file(path).encode_batch(random_texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_flat_ids(path, random_texts):
    encoder, texts = encoding.IdEncoder(path), random_texts[:500]
    want = [[*x.ids, 7] for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for some, ids in ((texts, want), ([], []), ([None, ""], [[7], [7]]), (["a", None], [[*encoder.library.encode("a").ids, 7], [7]])):
        got, offsets = encoder.flat(pa.array(some, pa.string()), 7)
        assert [got[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == ids
        if some:
            sliced, cuts = encoder.flat(pa.array(["x y", *some], pa.string()).slice(1), 7)
            assert sliced.tolist() == got.tolist() and cuts.tolist() == offsets.tolist()


class Counting:
    """The library, counting the texts that it gets."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.library.encode_batch_fast(texts, **more)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_new_words_are_one_text(path):
    encoder = encoding.IdEncoder(path)
    texts = [f"ab{i}cd, ab{i}cd. x ab{i}cd" for i in range(500)]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    encoder.library = counting = Counting(encoder.library)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
    assert counting.n < 5 and len(encoder.words.slots) == 1003  # a word is the same with a stop or without
    assert encoder(texts) and counting.n < 5


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_with_special_strings(path):
    encoder = encoding.IdEncoder(path)
    texts = ["a<|endoftext|>b c", "<|endoftext|>", "<|endoftext|", "|>d <|endoftext|><|endoftext|>", "<|endof text|> e", "<|startoftext|>f.<|endoftext|>"]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.mark and [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
    encoder = encoding.IdEncoder(path)
    encoder.mark = None
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want


def test_lengths_are_the_librarys(random_texts, monkeypatch):
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(random_texts)]
    counter = encoding.LengthCounter(PIECE)
    assert counter(random_texts) == want and not counter.whole
    assert counter([]) == [] and counter.counts(pa.array([None, "a"], pa.string())).tolist() == [0, 2 - 1]
    cut = encoding.segments
    monkeypatch.setattr(encoding, "segments", lambda x, **more: cut(x, 16, **more))
    monkeypatch.setattr(encoding, "SEGMENT", 16)
    assert counter(random_texts) == want


def test_memory_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_CHARACTERS", 2000)
    encoder = encoding.IdEncoder(BYTE)
    want = encoder.library.encode("ab" * 400 + " c").ids
    for _ in range(9):
        assert np.frombuffer(encoder(["ab" * 400 + " c"])[0], "<u4").tolist() == want
        encoder([f"{i} " + "x" * 300 for i in range(20)])
    assert encoder.words.characters < 2 * 7000 and len(encoder.words.slots) < 50


def test_tabs_are_no_slower():
    counter = encoding.LengthCounter(PIECE)
    begin = time.process_time()
    assert len(set(counter([f"one two\tthree {i % 10}" for i in range(10_000)]))) < 4
    assert time.process_time() - begin < 1.5
    long = "word\tother thing " * 100_000
    small = len(counter.library.encode("word\tother thing " * 100))
    assert counter([long])[0] == (small - 1) * 1000 + 1


def test_forgotten_pieces_come_back():
    calls = []
    e = encoding.PieceEncoder(encoding.WORDS, lambda x: calls.append(len(x)) or [len(p) for p in x], sum, remembered=4)
    assert [e([x])[0] for x in ("a b c", "a b c d", "a b c")] == [5, 7, 5]
    assert sum(calls) == 4


def text_of(row):
    return row.text or ""


def test_counts(awkward, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.count_tokens(awkward, PIECE, limit=100).collect()
    want = [(r.doc_id, len(text_of(r).encode()), len(sp.encode(text_of(r)))) for r in awkward.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(no_docs, PIECE).count() == 0


def test_files_round_trip(awkward, no_docs):
    t = Tokenizer.from_file(WORD)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, text_of(r)) for r in awkward.collect()))
    ids = [np.array([*t.encode(x[2], add_special_tokens=False).ids, 2], "<u4") for x in rows]
    starts = np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]
    want = [(x[1] if x[0] else None, int(s), len(i), zlib.crc32(i.tobytes())) for x, s, i in zip(rows, starts, ids, strict=True)]
    got = sorted((tuple(r) for r in token_files.token_output(awkward, WORD, 2).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.token_output(no_docs, WORD, 2).count() == 0


def test_wide_ids_need_wide_files():
    with pytest.raises(ValueError):
        encoding.IdEncoder(BYTE, "<u1")


def check_packed(rows, sizes, limits):
    """Each id in one piece, pieces gapless, limits kept, full or powers of two."""
    parts, bins = {}, {}
    for doc, start, n, seq, offset in rows:
        parts.setdefault(doc, []).append((start, n))
        bins.setdefault(seq, []).append((offset, n))
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {d: n for d, n in sizes.items() if n}
    for p in (*parts.values(), *bins.values()):
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
    for p in bins.values():
        total = sum(n for _, n in p)
        assert total <= limits.tokens and len(p) <= limits.segments
        assert total == limits.tokens or total & (total - 1) == 0


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(64, 64, 20), packing.Limits(2048)])
def test_packer(limits):
    r = random.Random(3)
    packer, rows, seq, loss = packing.Packer(limits, window=8), [], 0, {}
    sizes = {i: r.choice([1, 2, 5, 63, 64, 65, r.randrange(1, 400)]) for i in range(300)}

    def take(sequences):
        nonlocal seq
        for pieces in sequences:
            at = 0
            for doc, start, n in pieces:
                rows.append((doc, start, n, seq, at))
                at += n
            loss[seq] = sum(max(0, s + n - max(s, sizes[d] // 3)) for d, s, n in pieces)
            seq += 1

    for i, n in sizes.items():
        take(packer.add(packing.Example(i, 0, n, n // 3)))
    take(packer.finish())
    check_packed(rows, sizes, limits)
    assert max(loss.values()) <= limits.loss_tokens


def test_pack(awkward, no_docs):
    t = Tokenizer.from_file(BYTE)
    rows = packing.pack(awkward, BYTE, 1).collect()
    want = sorted(len(t.encode(text_of(r), add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r.length for r in rows) == sum(want)
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
    five = np.array([*t.encode(text_of(awkward.filter("doc_id = 5").first()), add_special_tokens=False).ids, 1], "<u4")
    for r in rows:
        if r.doc_id == 5:
            assert zlib.crc32(five[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    bins = {}
    for r in rows:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in bins.values())
    assert packing.pack(no_docs, BYTE, 1).count() == 0
