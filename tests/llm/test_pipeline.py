import re
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from concordance.llm.common import in_arrow, staged

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    added = docs.limit(1).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit("1 2 3").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(added)
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 1").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns or name == "packing"
    assert 10**6 not in kept["language"] and len(kept["language"]) == 200
    assert set(kept["toxicity"]) <= set(kept["language"]) and len(kept["near_dedup"]) == len(set(kept["near_dedup"])) < len(kept["toxicity"])
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and set(kept["packing"]) == set(kept["mixing"])
    assert toxic


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_workers_give_memory_back(spark):
    held = []

    def megabytes():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        parts = [bytearray(4000) for _ in range(40_000)]
        held.append(bytearray(4000))  # above the others, so that they don't go by themselves
        yield from batches
        held.append(megabytes())
        del parts

    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda f, schema: f)
    assert [*in_arrow(frame, run, "id long")(iter([1, 2]))] == [1, 2]
    assert held[1] - megabytes() > 100


def test_a_task_needs_one_worker(spark, monkeypatch):
    plans, frame, writer = [], type(spark.range(0)), type(spark.range(0).write)

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    to_arrow, parquet = frame.toArrow, writer.parquet
    monkeypatch.setattr(frame, "toArrow", lambda self: (plan(self), to_arrow(self))[1])
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **b: (plan(self._df), parquet(self, *a, **b))[1])
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
    in_python = [len(re.findall(r"ArrowEvalPython|MapInArrow", part)) for x in plans for part in x.split("Exchange")]
    assert max(in_python) == 1 and in_python.count(1) > 5
    assert not any("ExistingRDD" in x for x in plans)  # rows that Python workers of their own unpickle


def test_registry():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "mixing", "packing"]
