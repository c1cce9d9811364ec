"""Lookup tables in the shared folder: for models that grow with the data.

A table maps 64-bit keys to rows of doubles.  It is written by tasks as flat parts, a
key's part being its remainder; within a part keys ascend.  Workers map the parts
into memory, or keep a few at a time where the file system isn't local, and search.
Nothing of it comes to the driver but one row a part, and nothing is broadcast.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, new_path

#: Keys of a part, about.
PART_ROWS = 1 << 19
#: Parts that a worker holds at a time where it can't map them.
HELD_PARTS = 4


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def mapped(path: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped into memory where the file system is local, else read."""
    system, name = opened(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if system.get_file_info(name).size else np.empty(0, dtype)
    with system.open_input_stream(name) as f:
        return np.frombuffer(f.read(), dtype)


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


@dataclass(frozen=True)
class Lookup:
    """``stems``: of each part's files, ``None`` for a part without keys; ``width``: values of a key."""

    stems: tuple[str | None, ...]
    width: int

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Searches a table; remembers the parts that it has opened."""

    def __init__(self, table: Lookup):
        self.table = table
        self.parts: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.parts:
            self.parts.move_to_end(i)
            return self.parts[i]
        stem = self.table.stems[i]
        keys = mapped(f"{stem}.keys", "<i8")
        found = keys, mapped(f"{stem}.values", "<f8").reshape(len(keys), self.table.width)
        self.parts[i] = found
        if not isinstance(keys, np.memmap) and len(self.parts) > HELD_PARTS:
            self.parts.popitem(last=False)
        return found

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its values (zeros where it isn't)."""
        n = len(self.table.stems)
        here, values = np.zeros(len(keys), bool), np.zeros((len(keys), self.table.width))
        part = np.mod(keys, n) if n > 1 else np.zeros(len(keys), np.int64)
        order = np.argsort(part, kind="stable") if n > 1 else np.arange(len(keys))
        cuts = np.searchsorted(part[order], np.arange(n + 1))
        for i in range(n):
            rows = order[cuts[i] : cuts[i + 1]]
            if not len(rows) or self.table.stems[i] is None:
                continue
            own, kept = self._part(i)
            at = np.minimum(np.searchsorted(own, keys[rows]), len(own) - 1)
            hit = own[at] == keys[rows]
            here[rows] = hit
            values[rows[hit]] = kept[at[hit]]
        return here, values


def write_lookup(rows: DataFrame, key: str, values: list[str], n_parts: int, name: str) -> Lookup:
    """Write ``rows`` (distinct keys, not null) as a table of ``n_parts`` parts.

    A task writes files of its own attempt; the table names those of the attempts that
    succeeded, so lost executors and repeated tasks do no harm.
    """
    path = new_path(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        attempt = TaskContext.get().taskAttemptId()
        at, files, done = None, (), []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if part[a] != at:
                    for f in files:
                        f.close()
                    at = int(part[a])
                    done.append(at)
                    system.create_dir(folder, recursive=True)
                    files = tuple(system.open_output_stream(f"{folder}/{at}-{attempt}.{x}") for x in ("keys", "values"))
                some = batch.slice(a, b - a)
                files[0].write(some.column("key").to_numpy().astype("<i8").tobytes())
                files[1].write(np.stack([some.column(f"v{i}").to_numpy() for i in range(len(values))], axis=1).astype("<f8").tobytes())
        for f in files:
            f.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array(done, pa.int64()), "stem": pa.array([f"{path}/{x}-{attempt}" for x in done], pa.string())})

    wanted = rows.select(F.pmod(F.col(key), F.lit(n_parts)).cast("long").alias("part"), F.col(key).alias("key"), *(F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(values)))
    stems: list[str | None] = [None] * n_parts
    for row in in_arrow(wanted.repartition(n_parts, "part").sortWithinPartitions("part", "key"), run, "part long, stem string").collect():
        stems[row.part] = row.stem
    return Lookup(tuple(stems), len(values))
