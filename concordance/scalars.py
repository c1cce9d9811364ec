"""Typed scalars: parsing, guards and normalisation of columns, as Column expressions.

Text is admitted by its form before it is cast, because casts are more lenient than the
type rules.  A value that isn't admitted gives null and a false ``ok`` (None where every
value is admitted); casts that could raise, and so print the value, are never used.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .policy import Field, PolicyError, Recipe, require

#: White space that Python's strip() removes: what Java calls space, separators and controls.
SPACE = r"[\s\p{Z}\x1c-\x1f\x0b\x85]"
#: Forms of admitted text.
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"
#: Native types that each type admits, besides text.
NATIVE = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "decimal": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType),
    "float": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType,),
}


@F.arrow_udf(T.StringType())
def casefold(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.casefold() for x in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfc(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in values.to_pylist()], pa.string())


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def normalized(c: Column, rules: tuple[str, ...]) -> Column:
    """Apply the rules in order; ASCII text is folded in the JVM and is in NFC as it is, so Python gets nulls for it."""
    for rule in rules:
        if rule == "trim":
            c = trim(c)
            continue
        ascii_ = c.rlike(r"^\p{ASCII}*$")
        other = {"casefold": casefold, "unicode_nfc": nfc}[rule](F.when(~ascii_, c))
        c = F.when(ascii_, F.lower(c) if rule == "casefold" else c).otherwise(other)
    return c


def spark_type(f: Field) -> str:
    return {"string": "string", "integer": "decimal(38,0)", "decimal": f"decimal(38,{f.scale})", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}[f.type]


def from_text(c: Column, f: Field) -> tuple[Column, Column | None]:
    """Value and admission of a text column; empty text is null for all types but string."""
    absent = c.isNull() if f.type == "string" else c.isNull() | (c == "")
    if f.type == "string":
        return normalized(c, f.normalize), None
    if f.type == "boolean":
        value = F.when(c == "true", True).when(c == "false", False)
    elif f.type == "integer":
        value = F.when(c.rlike(INTEGER), c.try_cast("decimal(38,0)"))
    elif f.type == "decimal":
        exact_kind = f"decimal(38,{max(18, f.scale)})"
        exact = c.try_cast(exact_kind)
        fits = F.length(F.regexp_extract(F.regexp_replace(c, r"0+$", ""), r"\.([0-9]*)$", 1)) <= f.scale
        plain = c.try_cast(f"decimal(38,{f.scale})")
        value = F.when(c.rlike(DECIMAL) & F.when(c.rlike("[eE]"), exact == plain.cast(exact_kind)).otherwise(~c.contains(".") | fits | (F.length(F.regexp_extract(c, r"\.([0-9]*)$", 1)) <= f.scale)), plain)
    elif f.type == "float":
        number = c.try_cast("double")
        value = F.when(c.rlike(DECIMAL) & ~F.isnan(number) & (F.abs(number) < float("inf")), number)
    elif f.type == "date":
        value = F.when(c.rlike(DATE), c.try_cast("date"))
    else:
        value = F.when(c.rlike(TIMESTAMP), c.try_cast("timestamp"))
    value = F.when(~absent, value)
    return value, absent | value.isNotNull()


def from_native(c: Column, f: Field, kind: T.DataType) -> tuple[Column, Column | None]:
    """Value and admission of a column of a native type, left as it is where it fits."""
    if f.type == "string":
        return normalized(c, f.normalize), None
    if f.type == "integer":
        return c.cast("long"), None
    if f.type == "decimal" and isinstance(kind, T.DecimalType) and kind.scale == f.scale:
        return c, None
    value = c.try_cast(spark_type(f))
    if f.type == "float":
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    elif f.type == "decimal":
        value = F.when(value == c, value)
    return value, c.isNull() | value.isNotNull()


def parsed(df: DataFrame, recipe: Recipe, side: int, keep_ok: bool = False) -> DataFrame:
    """The canonical columns of one side, typed and normalised.

    The header must be the mapped columns and the declared exclusions.  ``keep_ok`` adds
    ``__ok_<column>`` flags; without it a value that isn't admitted raises, with the
    column's name and not the value.
    """
    wanted = [f.sources[side] for f in recipe.columns.values()]
    missing, extra = set(wanted) - set(df.columns), set(df.columns) - set(wanted) - set(recipe.excluded)
    require(len(df.columns) == len(set(df.columns)), "the header repeats a column")
    require(not missing and not extra, f"the header differs: missing {sorted(missing)}, unexpected {sorted(extra)}")
    out = []
    for f in recipe.columns.values():
        kind = df.schema[f.sources[side]].dataType
        c = F.col(f"`{f.sources[side]}`")
        if isinstance(kind, T.StringType):
            value, ok = from_text(F.when(~c.isin(*recipe.null_tokens[side]), c) if recipe.null_tokens[side] else c, f)
        elif isinstance(kind, NATIVE[f.type]):
            value, ok = from_native(c, f, kind)
        else:
            raise PolicyError(f"column {f.name} can't be read as {f.type} from {kind.simpleString()}")
        if keep_ok:
            out += [value.alias(f.name), (F.lit(True) if ok is None else ok).alias(f"__ok_{f.name}")]
        elif ok is None:
            out.append(value.alias(f.name))
        else:
            fail = F.raise_error(F.lit(f"column {f.name} holds a value that is no {f.type}")).cast(spark_type(f))
            out.append(F.when(ok, value).otherwise(fail).alias(f.name))
    return df.select(*out)


def exact_number(c: Column, kind: str) -> Column:
    """A number as a decimal for tolerances; a double by its shortest text, null where that doesn't fit."""
    if kind != "float":
        return c
    exact = c.cast("string").try_cast("decimal(38,18)")
    return F.when((F.abs(c) < 1e12) & (exact.cast("double") == c), exact)
