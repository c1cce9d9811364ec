"""Packing by vector bin packing with the dot-product heuristic.

Every example is a vector: tokens, segments (1 a piece) and loss-bearing tokens.
A sequence is a bin with a limit for each.  The bin that is open takes, again and
again, the example whose vector has the largest dot product with what is left of
the bin, both scaled by the limits, among those that fit; when none fits, an
example is cut so that its first part fills the bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from .common import byte_slices, in_arrow


@dataclass(frozen=True)
class Limits:
    """Of a sequence.  A power of two for ``tokens`` is assumed for padding only."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Example:
    """The rest of a document that isn't placed yet: ids [start, stop).

    Ids from ``loss_from`` on bear loss (0: all of them; for instruction data the
    prompt lies before it).
    """

    doc: int
    start: int
    stop: int
    loss_from: int = 0

    def loss(self, length: int | None = None) -> int:
        stop = self.stop if length is None else self.start + length
        return max(0, stop - max(self.start, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """Of a first part within so many tokens and loss-bearing tokens."""
        free = max(0, self.loss_from - self.start)
        return min(tokens, self.stop - self.start, free + loss)


@dataclass
class Packer:
    """Packs a stream of examples; gives lists of (doc, start, length), one list per sequence."""

    limits: Limits
    window: int = 512
    waiting: list[Example] = field(default_factory=list)

    def add(self, example: Example) -> Iterator[list[tuple[int, int, int]]]:
        cap = self.limits
        while (n := example.longest(cap.tokens, cap.loss_tokens)) == cap.tokens:
            yield [(example.doc, example.start, n)]
            example.start += n
        if example.start < example.stop:
            self.waiting.append(example)
        if len(self.waiting) >= 2 * self.window:
            yield from self._pack(self.window)

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list[tuple[int, int, int]]]:
        """Fill sequences until at most ``leave`` examples wait.

        A sequence that stays short of the token limit (nothing is left, or another
        limit is met) is cut at powers of two, so that none of it needs padding.
        """
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        items = self.waiting
        size = np.array([[x.stop - x.start, 1, x.loss()] for x in items], float).reshape(len(items), 3)
        here = np.ones(len(items), bool)
        n_here = len(items)
        while n_here > leave:
            left, bin_ = cap.copy(), []
            while left[0] > 0 and left[1] > 0 and n_here:
                fits = here & (size[:, 0] <= left[0]) & (size[:, 2] <= left[2])
                score = np.where(fits, size @ (left / cap**2), -1.0)
                i = int(score.argmax())
                if score[i] < 0:
                    longest = np.where(here, np.minimum(np.minimum(left[0], size[:, 0]), size[:, 0] - size[:, 2] + left[2]), 0)
                    i = int(np.where(longest == longest.max(), size[:, 0], -1).argmax())
                    n = int(longest[i])
                    if not n:
                        break
                else:
                    n = int(size[i, 0])
                x = items[i]
                bin_.append((x.doc, x.start, n))
                left -= (n, 1, x.loss(n))
                x.start += n
                size[i] = (x.stop - x.start, 1, x.loss())
                if x.start == x.stop:
                    here[i] = False
                    n_here -= 1
            if left[0] > 0:
                yield from at_powers_of_two(bin_)
            else:
                yield bin_
        self.waiting = [x for x, keep in zip(items, here, strict=True) if keep]


def at_powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a sequence into sequences whose lengths are powers of two, the largest first."""
    total = sum(x[2] for x in pieces)
    pieces = pieces[::-1]
    while total:
        room = want = 1 << total.bit_length() - 1
        out = []
        while room:
            doc, start, n = pieces.pop()
            out.append((doc, start, min(n, room)))
            if n > room:
                pieces.append((doc, start + room, n - room))
            room -= out[-1][2]
        yield out
        total -= want


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``limits.tokens`` tokens; one row per piece.

    A document is its whole text's ids by ``tokenizer`` and then ``end_id``.
    Documents are cut freely: full sequences are cut off at once, what remains of
    each document is packed with the rest of ``window`` to twice as many others of the
    same task.  Sequences come out full; a task's last ones have a power of two as
    their length, so padding is needed nowhere.  ``loss_from_col`` names a column with
    the number of leading ids that bear no loss.

    Columns: the id, ``start`` (ids of the document before the piece), ``length``,
    ``ids_crc32`` (unsigned, of little-endian unsigned 32-bit ids), ``doc_tokens``
    (with the end id), ``sequence_id`` (unique; high bits are the task) and ``offset``
    (of the piece within its sequence).

    No shuffle; memory is the waiting examples' ids.  The same partition gives the
    same rows again, so a repeated task is harmless.  Null text is the empty text,
    null ids and repeated rows are packed like others (a document without any id and
    with ``end_id`` None has no piece), an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.loaded(encoding.IdEncoder, tokenizer, "<u4")
        base, n_sequences, n_docs = TaskContext.get().partitionId() << 40, 0, 0
        packer, held, rows = Packer(limits), {}, []

        def emit(sequences):
            nonlocal n_sequences
            for pieces in sequences:
                at = 0
                for doc, start, n in pieces:
                    name, ids, left = held[doc]
                    rows.append((name, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base | n_sequences, at))
                    at += n
                    if left == n:
                        del held[doc]
                    else:
                        held[doc] = (name, ids, left - n)
                n_sequences += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 7
        for batch in batches:
            for part in byte_slices(batch, "text", encoding.BATCH):
                flat, offsets = encoder.flat(part.column("text"), end_id)
                at = offsets.tolist()
                for name, a, b, loss_from in zip(part.column("id").to_pylist(), at[:-1], at[1:], part.column("loss_from").to_pylist(), strict=True):
                    if a < b:
                        ids = flat[a:b].astype("<u4").tobytes()
                        held[n_docs] = (name, ids, len(ids) // 4)
                        emit(packer.add(Example(n_docs, 0, len(ids) // 4, loss_from)))
                        n_docs += 1
                if rows:
                    yield flush()
        emit(packer.finish())
        if rows:
            yield flush()

    loss = F.lit(0) if loss_from_col is None else F.coalesce(F.col(loss_from_col), F.lit(0))
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), loss.cast("long").alias("loss_from"))
    return in_arrow(wanted, run, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
