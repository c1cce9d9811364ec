"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built of a sample of labelled text.  A text is
parsed into phrases, each the longest match from where the last one ended to
anything in the sample; the language that needs the fewest phrases, normalised by
the length and by the bits of a pointer into its sample, wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare, text_slices

#: Stands for "no language".
UNDETERMINED = "und"
#: Letters with a symbol of their own, the most frequent of all samples together; the others
#: share symbols by a hash of the letter, so that scripts of thousands of letters keep most
#: of what tells their words apart.
OWN_SYMBOLS, HASHED_SYMBOLS = 160, 32
#: A text is parsed in stretches of so many letters and gaps, all of them at once.
STRETCH = 1024


def automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence, one row a state, -1 where there is none."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        here = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in after[p]:
            after[p][s] = here
            p = link[p]
        if p >= 0:
            q = after[p][s]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(s) == q:
                    after[p][s] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    table = np.full((len(after), n_symbols), -1, np.int32)
    for i, row in enumerate(after):
        if row:
            table[i, list(row)] = list(row.values())
    return table


class CrossParser:
    """Parses texts with the automata of all languages.

    ``samples``: text per language.  The automata stand in one table, whose entries
    are the row where the next state begins; a negative entry ends a phrase.  Each
    automaton gets one more state, for after a letter that its sample lacks.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = Counter(c for x in samples.values() for c in x.lower() if c.isalpha())
        own = {c: 1 + i for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OWN_SYMBOLS])}
        self.n_symbols = 1 + len(own) + HASHED_SYMBOLS
        self.symbol = np.zeros(0x110000, np.uint8)  # 0: no letter
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                self.symbol[code] = own.get(low) or 1 + len(own) + (ord(low[0]) * 0x9E3779B1 >> 16) % HASHED_SYMBOLS
        tables, starts, n = [], [], 0
        for x in self.languages:
            table = automaton(self.symbols([samples[x]])[0].tolist(), self.n_symbols)
            root, lost = table[0], len(table)
            table = np.vstack([table, np.full((1, self.n_symbols), -1, np.int32)])
            again = np.where(root < 0, lost, root)
            ends = table < 0
            table = np.where(ends, again, table)
            ends[0] = False
            at = (table.astype(np.int64) + n) * self.n_symbols
            tables.append(np.where(ends, at - (1 << 31), at))
            starts.append(n * self.n_symbols)
            n += len(table)
        if n * self.n_symbols >= 1 << 31:
            raise ValueError("the samples are too large together")
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.empty(0, np.int32)
        self.starts = np.array(starts, np.int32)
        self.bits = np.log2([2 + len(samples[x]) for x in self.languages])

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters' symbols, a 0 after each run of letters; where each text ends there; its letters."""
        joined = "\n".join(texts) + "\n"
        all_ = self.symbol[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        letter = all_ > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        upto, letters = np.cumsum(keep)[ends], np.cumsum(letter)[ends]
        return all_[keep], upto, np.diff(letters, prepend=0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, symbols and letters by text."""
        symbols, upto, letters = self.symbols(texts)
        begin = np.concatenate([[0], upto[:-1]])
        size = upto - begin
        n_parts = -(-size // STRETCH)
        text = np.repeat(np.arange(len(texts)), n_parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        at = begin[text] + part * STRETCH
        long = np.minimum(STRETCH, upto[text] - at)
        order = np.argsort(-long, kind="stable")
        at, long, text = at[order], long[order], text[order]
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")
        state = np.repeat(self.starts[:, None], len(at), 1)
        breaks = np.zeros(state.shape, np.int32)
        for j, n in enumerate(active.tolist()):
            to = self.table.take(state[:, :n] + symbols[at[:n] + j])
            breaks[:, :n] += to < 0
            state[:, :n] = to & 0x7FFFFFFF
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(total, text, breaks.T + 1)
        return total, size, letters

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per symbol (of the winner) of each text."""
        total, size, letters = self.phrases(["" if x is None else x for x in texts])
        bits = total * self.bits
        best = bits.argmin(1) if len(self.languages) else np.zeros(len(texts), int)
        known = (letters > 0) & (len(self.languages) > 0)
        score, rate = np.zeros(len(texts)), np.ones(len(texts))
        if len(self.languages):
            low = bits.min(1)
            second = np.partition(bits, 1, 1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(known, 1 - low / np.where(known, second, 1), 0.0)
                rate = np.where(known, total[np.arange(len(texts)), best] / np.maximum(size, 1), 1.0)
        return [self.languages[i] if k else UNDETERMINED for i, k in zip(best, known, strict=True)], score, rate


def fit_samples(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", pieces: int = 64, piece_chars: int = 256) -> dict[str, str]:
    """A bounded sample per language: ``pieces`` stretches of ``piece_chars`` characters.

    Documents are dealt into ``pieces`` slots by a hash; the one with the least other
    hash gives the slot its stretch, begun at a hashed place.  That is one partial
    aggregation: a task hands on at most a row per language and slot, and the driver
    gets languages x pieces x piece_chars characters.  Null languages and texts without
    letters are left out.
    """
    n = F.length(text_col)
    first = F.when(n > piece_chars, F.pmod(F.xxhash64(id_col, F.lit("at")), n - piece_chars)).otherwise(0) + 1
    piece = F.substring(F.col(text_col), first.cast("int"), F.lit(piece_chars))
    rows = (
        labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col, F.lit("slot")), F.lit(pieces)).alias("slot"), F.struct(F.xxhash64(id_col, F.lit("rank")).alias("rank"), piece.alias("piece")).alias("drawn"))
        .groupBy("lang", "slot")
        .agg(F.min("drawn").alias("drawn"))
        .select("lang", "slot", "drawn.piece")
        .collect()
    )
    out: dict[str, str] = {}
    for row in sorted(rows, key=lambda x: (x.lang, x.slot)):
        out[row.lang] = f"{out.get(row.lang, '')} {row.piece}"
    return out


def predictor(docs: DataFrame, samples: dict[str, str]) -> Callable[[Column], Column]:
    """A function from a text column to a struct (lang, score, rate); Arrow batches, no shuffle."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    @F.arrow_udf("lang string, score double, rate double")
    def predict(texts: pa.Array) -> pa.Array:
        own = kept(("languages", sent.value))
        if not own:
            own["parse"] = CrossParser(dict(sent.value))
        parse = own["parse"]
        langs, scores, rates = [], [], []
        for some in text_slices(texts, 2 << 20):
            a, b, c = parse(some)
            langs += a
            scores.append(b)
            rates.append(c)
        empty = [np.empty(0)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores or empty)), pa.array(np.concatenate(rates or empty))], names=["lang", "score", "rate"])

    return predict


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text: id, ``keep`` columns, ``lang_pred``, ``score``, ``rate``.

    ``labelled`` gives the samples (``fit_samples``); labels of ``docs`` are not read.
    ``score`` is the winner's margin, 1 - bits / bits of the second (1 with one
    language); ties go to the language first in alphabet.  ``rate`` is the winner's
    phrases per letter or gap, near 1 where the text is in none of the languages.

    A long text is parsed in stretches of STRETCH letters and gaps, so a phrase also ends
    at each of these.  Letters beyond the OWN_SYMBOLS most frequent ones of all samples share
    HASHED_SYMBOLS symbols, which matters for scripts of thousands of letters.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned.  Null ids and repeated rows are kept; an empty table gives none.
    """
    predict = predictor(docs, fit_samples(labelled, lang_col, text_col, id_col))
    out = docs.select(F.col(id_col), *keep, predict(F.col(text_col)).alias("p"))
    return out.select(id_col, *keep, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rate").alias("rate"))


def in_a_language(docs: DataFrame, labelled: DataFrame, max_rate: float = 0.6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages.

    Rejected are texts without letters, null texts, and texts of which even the best
    language needs over ``max_rate`` phrases per letter or gap: hardly two letters in a
    row of them occur in any sample.  If nothing was learned, every row goes.
    """
    predict = predictor(docs, fit_samples(labelled, lang_col, text_col, id_col))
    row = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), predict(F.col(text_col)).alias("p"))
    kept = row.filter((F.col("p.lang") != UNDETERMINED) & (F.col("p.rate") <= max_rate))
    return kept.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
