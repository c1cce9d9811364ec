"""Sources: locators to frames, with strict headers, digests and limits.

``path`` with a known suffix reads delimited text, JSON lines or Parquet (text also with
``.gz``), or a folder of files of one format.  ``sqlite:path#table``,
``json:path#/pointer``, ``xml:path#a/b`` and ``xlsx:path#Sheet!A1:F9`` read through Python
data sources.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .datasources import register
from .policy import SIDES, Recipe, require
from .session import configure

FORMATS = {".csv": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet"}
SCHEMES = ("sqlite", "json", "xml", "xlsx")
MAX_INPUT_BYTES = MAX_DECODED_BYTES = 1_000_000_000
MAX_ROWS = 5_000_000


def format_of(path: Path) -> str:
    """The format of a file, or of all visible files of a folder."""
    if path.is_dir():
        kinds = {format_of(x) for x in members(path)}
        require(len(kinds) == 1, "a folder must hold files of one format")
        return kinds.pop()
    suffixes = path.suffixes[-2:] if path.suffix == ".gz" else path.suffixes[-1:]
    kind = FORMATS.get(suffixes[0] if suffixes else "")
    require(kind is not None and not (path.suffix == ".gz" and kind == "parquet"), f"no known format: {path.name}")
    return kind


def members(path: Path) -> list[Path]:
    """The files of a source, in order of their names."""
    if not path.is_dir():
        return [path]
    found = sorted(x for x in path.iterdir() if not x.name.startswith((".", "_")))
    require(found and all(x.is_file() and not x.is_symlink() for x in found), "a folder must hold plain files only")
    return found


def file_of(locator: str) -> Path:
    scheme, _, rest = locator.partition(":")
    return Path(rest.partition("#")[0] if scheme in SCHEMES else locator)


def digest(locator: str) -> str:
    """SHA-256 of a file; of names and digests for a folder."""
    path = file_of(locator)
    each = []
    for x in members(path):
        h = hashlib.sha256()
        with x.open("rb") as f:
            while part := f.read(1 << 20):
                h.update(part)
        each.append((x.name, h.hexdigest()))
    if not path.is_dir():
        return each[0][1]
    return hashlib.sha256("".join(f"{n}\0{d}\n" for n, d in each).encode()).hexdigest()


def check_sizes(locators: list[str], max_input_bytes: int = MAX_INPUT_BYTES, max_decoded_bytes: int = MAX_DECODED_BYTES) -> None:
    """Limits on all inputs together, before any is read; compressed text is measured decoded."""
    files = [x for loc in locators for x in members(file_of(loc))]
    require(sum(x.stat().st_size for x in files) <= max_input_bytes, "the inputs exceed max_input_bytes")
    left = max_decoded_bytes
    for x in files:
        if x.suffix == ".gz":
            with gzip.open(x) as f:
                while part := f.read(1 << 20):
                    left -= len(part)
                    require(left >= 0, "the inputs exceed max_decoded_bytes")


def header(path: Path, delimiter: str) -> list[str]:
    with (gzip.open if path.suffix == ".gz" else open)(path, "rt", encoding="utf-8", newline="") as f:
        names = next(csv.reader(f, delimiter=delimiter), [])
    require(bool(names), f"{path.name} has no header")
    require(len(names) == len(set(names)), f"{path.name} repeats a column in its header")
    return names


def read_source(spark: SparkSession, locator: str, recipe: Recipe | None = None, side: int = 0) -> DataFrame:
    """The frame of a locator; columns of text formats are strings."""
    configure(spark)
    scheme, _, rest = locator.partition(":")
    if scheme in SCHEMES:
        register(spark)
        path, _, part = rest.partition("#")
        reader = spark.read.format(f"concordance_{scheme}").option("path", path).option("part", part)
        projection = recipe.source.get("field_projection", {}).get(SIDES[side], {}) if recipe else {}
        if projection and projection["kind"] == {"json": "json-pointer-v1", "xml": "xml-field-v1"}.get(scheme):
            reader = reader.option("fields", json.dumps(projection["fields"])).option("namespaces", json.dumps(projection.get("namespaces", {})))
        return reader.load()
    path = Path(locator)
    kind = format_of(path)
    if kind == "parquet":
        return spark.read.parquet(str(path))
    if kind == "jsonl":
        return json_lines(spark, path)
    delimiter = "\t" if kind == "tsv" else recipe.delimiters[side] if recipe else ","
    heads = [header(x, delimiter) for x in members(path)]
    require(all(h == heads[0] for h in heads), "the files' headers differ")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in heads[0]])
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST", "emptyValue": "", "enforceSchema": False}
    rows = spark.read.options(**options).schema(schema).csv(str(path))
    return rows.select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in heads[0]))


def json_lines(spark: SparkSession, path: Path) -> DataFrame:
    """One flat object a line; numbers keep their text; all lines have the same fields."""
    first = next((x for m in members(path) for x in _lines(m)), None)
    require(first is not None, "a JSON lines input needs a line to tell its fields")
    lines = spark.read.text(str(path))
    names = sorted(spark.createDataFrame([(first,)], "value string").select(F.json_object_keys("value")).first()[0] or [])
    require(bool(names), "a line must be an object with fields")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    keys = F.array_sort(F.json_object_keys("value"))
    # A value's kind is its own first character: parsed as a variant, a string keeps its quotes.
    kinds = F.from_json("value", T.MapType(T.StringType(), T.VariantType()), {"mode": "PERMISSIVE"})
    nested = F.exists(F.transform(F.map_values(kinds), F.schema_of_variant), lambda x: x.startswith("OBJECT") | x.startswith("ARRAY"))
    good = keys.isNotNull() & (F.size(keys) == len(names)) & (keys == F.array(*map(F.lit, names))) & ~F.coalesce(nested, F.lit(False))
    row = F.from_json("value", schema, {"primitivesAsString": "true", "mode": "FAILFAST"})
    checked = F.when(good, row).otherwise(F.raise_error(F.lit("a line's fields differ, repeat or are nested")).cast(schema))
    return lines.select(checked.alias("row")).select(*(F.col("row").getField(n).alias(n) for n in names))


def _lines(path: Path):
    with (gzip.open if path.suffix == ".gz" else open)(path, "rt", encoding="utf-8") as f:
        yield from (x for x in f if x.strip())
