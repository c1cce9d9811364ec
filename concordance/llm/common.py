"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Bytes of an Arrow batch between the JVM and a Python worker, about.
BATCH_BYTES = "4m"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a temporary
    folder is made once and set on the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the session ends or the driver exits."""
    if not _written:
        _before_stop(spark)
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _before_stop(spark: SparkSession) -> None:
    """Clean up when the session is stopped, while its JVM can still delete."""
    stop = spark.stop

    def clean_and_stop() -> None:
        _clean()
        stop()

    spark.stop = clean_and_stop  # type: ignore[method-assign]


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have ended already; the other paths still go
            drop_path(spark, path)
        _written.pop(path, None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is above.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``staged`` gave, once nothing will read it again."""
    path = df.staged_at
    drop_path(_written.pop(path), path)


_kept: dict[object, dict] = {}


def kept(owner: object) -> dict:
    """What a Python worker keeps from task to task for one owner; what others kept is let go.

    A reused worker thus holds the tables of one operator at a time, and gives the memory
    of the others back.
    """
    others = [x for x in _kept if x != owner]
    for other in others:
        del _kept[other]
    if others:
        gc.collect()
        give_back()
    return _kept.setdefault(owner, {})


def give_back() -> None:
    """Return memory that a worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, after whose last batch the worker gives freed memory back.

    An executor may have more workers than cores, which take turns; one that waits for its
    next task then holds its tables only.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def prepare(spark: SparkSession) -> None:
    """Give the workers this package, and batches of bounded bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers have this package."""
    prepare(df.sparkSession)
    return df.mapInArrow(giving_back(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each slice holds about ``limit`` bytes of ``column``.

    A row longer than the limit makes a slice of its own.
    """
    sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """The values of a string array in lists of about ``limit`` bytes."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in byte_slices(batch, "text", limit):
        yield part.column("text").to_pylist()
