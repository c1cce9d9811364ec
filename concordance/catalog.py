"""A catalog of runs: an append-only Parquet table in a folder, with history and differences."""

from __future__ import annotations

import hashlib
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evidence
from .analysis import transition
from .policy import require

SCHEMA = "path string, sha256 string, outcome string, mode string, policy_sha256 string, discrepancies long, added long, kind string"


class Catalog:
    """Entries are events (add, remove); the last one of a path holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, *row: object) -> None:
        """Each event is a folder of its own, so writers don't meet."""
        entry = self.spark.createDataFrame([(*row[:-1], time.time_ns(), row[-1])], SCHEMA)
        entry.coalesce(1).write.parquet(f"{self.folder}/event-{uuid.uuid4().hex}")

    def _events(self) -> DataFrame:
        if not any(Path(self.folder).glob("event-*")):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/event-*")

    def add(self, bundle: str) -> None:
        """Add a verified bundle, or renew its entry."""
        r = evidence.verify(bundle)
        digest = hashlib.sha256((Path(bundle) / "manifest.json").read_bytes()).hexdigest()
        self._append(str(Path(bundle).resolve()), digest, r["outcome"], r.get("mode"), r.get("policy", {}).get("policy_sha256"), int(r.get("discrepancies", 0)), "add")

    def remove(self, bundle: str) -> None:
        self._append(str(Path(bundle).resolve()), None, None, None, None, None, "remove")

    def runs(self) -> DataFrame:
        """The entries that hold, with the number of entries that have the same digest."""
        last = F.max_by(F.struct("sha256", "outcome", "mode", "policy_sha256", "discrepancies", "kind"), "added")
        held = self._events().groupBy("path").agg(last.alias("e"), F.min("added").alias("added")).filter("e.kind = 'add'")
        return held.select("path", "e.sha256", "e.outcome", "e.mode", "e.policy_sha256", "e.discrepancies", "added").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("sha256")))

    def states(self) -> list[dict]:
        """Entries with whether their bundle is current, modified or missing."""
        out = []
        for r in self.runs().orderBy("added").collect():
            manifest = Path(r["path"]) / "manifest.json"
            state = "missing" if not manifest.exists() else "current" if hashlib.sha256(manifest.read_bytes()).hexdigest() == r["sha256"] else "modified"
            out.append(r.asDict() | {"state": state})
        return out

    def history(self, policy_sha256: str) -> DataFrame:
        """Runs under one policy in the order they were added, with the change from the one before."""
        return history(self.runs().filter(F.col("policy_sha256") == policy_sha256))

    def diff(self, a: str, b: str) -> dict[str, tuple]:
        """Fields that differ between two entries."""
        found = {r["path"]: r.asDict() for r in self.runs().collect()}
        x, y = (found.get(str(Path(p).resolve())) for p in (a, b))
        require(x is not None and y is not None, "both bundles must be in the catalog")
        return {k: (x[k], y[k]) for k in ("sha256", "outcome", "mode", "policy_sha256", "discrepancies") if x[k] != y[k]}


def history(runs: DataFrame) -> DataFrame:
    before = F.lag("discrepancies").over(Window.partitionBy("policy_sha256").orderBy("added"))
    out = runs.withColumn("before", before)
    change = F.when(F.col("before").isNotNull(), transition(F.col("before"), F.col("discrepancies")))
    return out.withColumn("transition", change).drop("before")
