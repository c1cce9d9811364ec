"""Token counts: lengths only, from Arrow functions with batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from .common import byte_slices, in_arrow


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = encoding.BATCH) -> DataFrame:
    """Tokens of every whole text, as the library of ``tokenizer`` counts them.

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model``
    (sentencepiece) file that every executor can read.  Returns the id column,
    ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    One narrow pass without a shuffle: rows are handed on as they come, in batches
    of about ``batch_bytes`` of text.  The library gets single words; texts over 2**18
    bytes, and those whose blanks run together, go to it in segments of 2**18 characters cut
    at safe boundaries, whatever other white space they hold.  So memory follows the
    batch and the longest run without a blank, where sentencepiece has no safe boundary.

    Null text counts as the empty text (0 bytes, 0 tokens); null ids and repeated
    rows are returned as they are; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding.counter(tokenizer).counts
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                n = pa.array(count(part.column("text")), pa.int64())
                size = pc.cast(pc.binary_length(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(wanted, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
