"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A dataset is a folder of parts.  Part k has three flat little-endian files:

* ``part-k.bin``: the token ids, unsigned 16 or 32 bits, nothing between documents;
* ``part-k.idx``: unsigned 64-bit offsets in ids from the part's begin, one more than it has documents;
* ``part-k.ids``: the 64-bit document ids.

``parts`` (the manifest) gives each part's base: the number of ids in all parts
before it, a prefix sum over the parts' totals.  A document's global start is its
part's base plus its local offset.  All files can be mapped into memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import byte_slices, in_arrow, new_path
from .lookup import mapped, opened

#: Bytes of input that a part is made of, about, if there are more parts than shuffle partitions.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Part:
    """One part: ``stem`` is its path without the suffix, ``base`` the ids before it.

    The first ``n_null`` of its documents have a null id (written as 0).
    """

    stem: str
    dtype: str
    n_docs: int
    n_null: int
    n_ids: int
    base: int


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> list[Part]:
    """Encode every whole text and write the ids in ascending order of ``id_col`` under ``path``.

    ``path`` must be shared by driver and executors.  Documents are dealt by ranges
    of their ids (one shuffle of the texts), sorted within a range and streamed to
    the part's files; only a batch is in memory.  Rows of one id, or of none, are dealt on by
    their text and then by where they come from, so that none of them makes a part too large;
    parts are as many as shuffle partitions, more if they would be over PART_BYTES by the
    plan's statistics.  A task writes files of its own attempt, and the manifest names
    those of the attempts that succeeded, so lost executors and repeated tasks do no harm.
    The driver gathers one row a part.

    ``end_id`` is appended to each document (None: nothing).  Null text is the empty
    text; null ids come first; rows with equal ids stay apart, ordered by the text's first
    characters; an empty table gives no part; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.loaded(encoding.IdEncoder, tokenizer, dtype)
        task = TaskContext.get()
        stem = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, name = opened(stem)
        n_docs = n_null = n_ids = 0
        out = None
        for batch in batches:
            for part in byte_slices(batch, "text", encoding.BATCH):
                if out is None:
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = {x: system.open_output_stream(f"{name}.{x}") for x in ("bin", "idx", "ids")}
                    out["idx"].write(np.zeros(1, "<u8").tobytes())
                ids, offsets = encoder.flat(part.column("text"), end_id)
                out["bin"].write(ids.astype(dtype).tobytes())
                out["idx"].write((n_ids + offsets[1:]).astype("<u8").tobytes())
                out["ids"].write(part.column("id").fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs, n_null, n_ids = n_docs + part.num_rows, n_null + part.column("id").null_count, n_ids + len(ids)
        if out is not None:
            for f in out.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "stem": [stem], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]})

    spark = docs.sparkSession
    size = int(str(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Without statistics Spark takes the largest number there is; then the shuffle's partitions must do.
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < 1 << 60 else 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("hash"), F.spark_partition_id().alias("origin"))
    dealt = wanted.repartitionByRange(n_parts, "id", "head", "hash", "origin").sortWithinPartitions("id", "head", "hash")
    rows = in_arrow(dealt.select("id", "text"), run, "part long, stem string, n_docs long, n_null long, n_ids long").collect()
    rows.sort(key=lambda x: x.part)
    bases = accumulate((x.n_ids for x in rows), initial=0)
    return [Part(x.stem, dtype, x.n_docs, x.n_null, x.n_ids, base) for x, base in zip(rows, bases, strict=False)]


def write_manifest(path: str, parts: list[Part]) -> None:
    system, name = opened(path)
    system.create_dir(name, recursive=True)
    with system.open_output_stream(f"{name}/parts.json") as f:
        f.write(json.dumps([asdict(x) for x in parts]).encode())


def read_manifest(path: str) -> list[Part]:
    system, name = opened(path)
    with system.open_input_stream(f"{name}/parts.json") as f:
        return [Part(**x) for x in json.loads(f.read())]


def read_token_files(spark: SparkSession, parts: list[Part], id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, global ``start``, ``n_tokens`` and ``ids_crc32``.

    ``ids_crc32`` is the unsigned crc32 of the document's ids as little-endian
    unsigned 32-bit integers.  A task maps a part (reads it, where the file system isn't
    local: a part has a bounded size) and walks over its offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, names = (mapped(f"{row['stem']}.{x}", kind) for x, kind in (("bin", row["dtype"]), ("idx", "<u8"), ("ids", "<i8")))
                for begin in range(0, row["n_docs"], 4096):
                    local = at[begin : begin + 4097].astype("<i8")
                    doc = np.asarray(names[begin : begin + 4096])
                    null = np.arange(begin, begin + len(doc)) < row["n_null"]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(local[:-1] + row["base"], pa.int64()), pa.array(np.diff(local), pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    rows = [(x.stem, x.dtype, x.n_docs, x.n_null, x.base) for x in parts]
    listed = spark.createDataFrame(rows, "stem string, dtype string, n_docs long, n_null long, base long")
    return in_arrow(listed.repartition(max(1, len(rows))), run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None, dtype: str = "<u2") -> DataFrame:
    """Write the files to a new folder of the shared directory and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    parts = write_token_files(docs, path, tokenizer, end_id, dtype)
    write_manifest(path, parts)
    return read_token_files(spark, read_manifest(path))
