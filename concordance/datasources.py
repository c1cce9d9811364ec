"""Python data sources: SQLite tables, JSON documents, XML records and spreadsheet ranges.

Each gives its rows as strings, but SQLite keeps the text of its values too; one
partition a source, since the files are single documents.
"""

from __future__ import annotations

import json
import sqlite3
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from .session import ship


def text(value: object) -> str | None:
    """A scalar as text; true and false as JSON writes them."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, list, dict)):
        raise ValueError("a value is no scalar")
    return str(value)


class _Rows(DataSourceReader):
    def __init__(self, rows, names: list[str]):
        self.rows, self.names = rows, names

    def read(self, partition) -> Iterator[tuple]:
        for row in self.rows():
            if set(row) != set(self.names):
                raise ValueError("records have different fields")
            yield tuple(text(row[n]) for n in self.names)


class _Source(DataSource):
    """A source whose ``records`` gives dicts with the same fields."""

    def records(self) -> Iterator[dict]:
        raise NotImplementedError

    def fields(self) -> list[str]:
        first = next(iter(self.records()), None)
        if first is None:
            raise ValueError("an empty document doesn't tell its fields")
        return list(first)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.fields()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Rows(self.records, schema.names)


class SqliteSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "concordance_sqlite"

    def _open(self) -> tuple[sqlite3.Connection, str]:
        con = sqlite3.connect(f"file:{quote(self.options['path'])}?mode=ro", uri=True)
        table = self.options["part"]
        kind = con.execute("SELECT type FROM sqlite_master WHERE name = ?", (table,)).fetchone()
        if kind != ("table",):
            raise ValueError("the locator must name an ordinary table")
        return con, '"' + table.replace('"', '""') + '"'

    def fields(self) -> list[str]:
        con, table = self._open()
        return [r[1] for r in con.execute(f"PRAGMA table_info({table})")]

    def records(self) -> Iterator[dict]:
        con, table = self._open()
        found = con.execute(f"SELECT * FROM {table}")
        names = [c[0] for c in found.description]
        for row in found:
            yield dict(zip(names, row, strict=True))


def pointed(value: object, pointer: str) -> object:
    """The value that an RFC 6901 pointer names."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        value = value[int(token)] if isinstance(value, list) else value[token]
    return value


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len(pairs) != len({k for k, _ in pairs}):
        raise ValueError("an object repeats a field")
    return dict(pairs)


class JsonSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "concordance_json"

    def records(self) -> Iterator[dict]:
        with open(self.options["path"], encoding="utf-8") as f:
            document = json.load(f, parse_float=str, parse_int=str, object_pairs_hook=_once)
        fields = json.loads(self.options.get("fields", "null"))
        for record in pointed(document, self.options["part"]):
            yield {n: pointed(record, x) for n, x in fields.items()} if fields else record


def selected(record: ET.Element, selector: str, spaces: dict[str, str]) -> str | None:
    """An attribute, or the text of the one element at a path; None if it is absent."""
    if selector.startswith("@"):
        prefix, _, local = selector[1:].rpartition(":")
        return record.get(f"{{{spaces[prefix]}}}{local}" if prefix else local)
    found = record.findall(selector, spaces)
    if len(found) > 1 or any(len(x) for x in found):
        raise ValueError("a selector meets several elements or one with children")
    return (found[0].text or "") if found else None


class XmlSource(_Source):
    """Records at a path of element names below the root; their children without attributes are fields."""

    @classmethod
    def name(cls) -> str:
        return "concordance_xml"

    def records(self) -> Iterator[dict]:
        path, _, spaces = self.options["part"].partition("?")
        names = dict(x.split(",", 1) for x in spaces.split("&")) if spaces else {}
        names = {k.removeprefix("ns="): v for k, v in names.items()}
        with open(self.options["path"], "rb") as f:
            if b"<!DOCTYPE" in f.read(1 << 16):
                raise ValueError("document types are not allowed")
        root = ET.parse(self.options["path"]).getroot()
        first, _, rest = path.partition("/")
        prefix, _, local = first.rpartition(":")
        if root.tag != (f"{{{names[prefix]}}}{local}" if prefix else local):
            raise ValueError("the document's root is another one")
        fields = json.loads(self.options.get("fields", "null"))
        bound = json.loads(self.options.get("namespaces", "{}"))
        for record in root.findall(rest, names):
            if fields:
                yield {n: selected(record, x, bound) for n, x in fields.items()}
                continue
            out: dict[str, str | None] = {}
            for field in record:
                if field.attrib or len(field) or field.tag in out:
                    raise ValueError("a field has attributes or children, or is repeated")
                out[field.tag.rpartition("}")[2]] = field.text or ""
            yield out


class XlsxSource(_Source):
    """A rectangle of a sheet whose first row is the header; needs openpyxl."""

    @classmethod
    def name(cls) -> str:
        return "concordance_xlsx"

    def records(self) -> Iterator[dict]:
        try:
            from openpyxl import load_workbook
        except ImportError:
            raise RuntimeError("reading spreadsheets needs openpyxl") from None
        book = load_workbook(self.options["path"], read_only=True, data_only=False)
        sheet, _, area = self.options["part"].rpartition("!")
        rows = ([c.value for c in r] for r in book[sheet][area])
        names = next(rows)
        for row in rows:
            if any(isinstance(v, str) and v.startswith(("=", "#")) for v in row):
                raise ValueError("formulas and errors are not allowed")
            yield dict(zip(names, row, strict=True))


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (SqliteSource, JsonSource, XmlSource, XlsxSource):
        spark.dataSource.register(source)
