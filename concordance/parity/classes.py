"""Classification of a pair of values: exact, within tolerance, different."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import Tolerance
from ..scalars import exact_number

EXACT, WITHIN, DIFFERENT = 0, 1, 2
NAMES = ("exact", "within_tolerance", "different")


#: Digits that hold the sum of the largest and the least double.
EXACT_CONTEXT = Context(prec=1200)


def delta(left: Column, right: Column, kind: str) -> Column:
    return F.abs(F.try_subtract(exact_number(right, kind), exact_number(left, kind)))


def allowance(left: Column, right: Column, kind: str, tolerance: Tolerance) -> Column:
    """The allowed difference; null where it can't be said in a decimal."""
    larger = F.greatest(F.abs(exact_number(left, kind)), F.abs(exact_number(right, kind)))
    scaled = F.try_multiply(F.lit(tolerance.relative), larger) if tolerance.relative else F.lit(Decimal(0))
    return F.when(larger.isNotNull(), F.try_add(F.lit(tolerance.absolute), scaled))


def by_text(tolerance: Tolerance) -> Callable[[Column, Column], Column]:
    """Whether two numbers are within the tolerance, by the decimals that their shortest text says."""

    @F.arrow_udf("boolean")
    def within(left: pa.Array, right: pa.Array) -> pa.Array:
        def holds(a: object, b: object) -> bool | None:
            if a is None or b is None:
                return None
            x, y, c = Decimal(str(a)), Decimal(str(b)), EXACT_CONTEXT
            return c.abs(c.subtract(y, x)) <= c.add(tolerance.absolute, c.multiply(tolerance.relative, max(c.abs(x), c.abs(y))))

        return pa.array(map(holds, left.to_pylist(), right.to_pylist()), pa.bool_())

    return within


def code(left: Column, right: Column, kind: str, tolerance: Tolerance | None, nulls_equal: bool) -> Column:
    """The class of a pair as a number; a worse class is a larger number.

    Two nulls are equal or different as the policy says, one null is different; equal
    values are exact; else a tolerance, bounds included, decides.  Where decimals of 38
    digits can't say a double, or its allowance, Python's do; other types raise an error
    without the value there.
    """
    out = F.when(left.isNull() & right.isNull(), EXACT if nulls_equal else DIFFERENT).when(left.isNull() | right.isNull(), DIFFERENT).when(left == right, EXACT)
    if tolerance is not None:
        plain = delta(left, right, kind) <= allowance(left, right, kind, tolerance)
        if kind == "float":
            beyond = plain.isNull()
            within = F.coalesce(plain, by_text(tolerance)(F.when(beyond, left), F.when(beyond, right)))
        else:
            within = F.coalesce(plain, F.raise_error(F.lit("a number is too large for its tolerance")).cast("boolean"))
        out = out.when(within, WITHIN)
    return out.otherwise(DIFFERENT)


def name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), c + 1)
