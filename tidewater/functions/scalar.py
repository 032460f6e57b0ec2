"""Scalar and array functions whose results differ from Spark's own, as Columns.

Integers are computed as BIGINT and anything with a DOUBLE as DOUBLE, comparisons that are projected are 0 or 1,
the remainder truncates both operands first, and substr has defined results at every edge. What Spark has
with the same meaning (upper, concat, transform, filter on arrays) is used as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "gt": lambda a, b: a > b,
    "lte": lambda a, b: a <= b,
    "gte": lambda a, b: a >= b,
}


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def big(value) -> Column:
    """An integer operand as BIGINT; fractions are cut off."""
    return _column(value).cast("bigint")


def wide(value) -> Column:
    """An operand whose sums and products are BIGINT if it is an integer of any width; a DOUBLE stays one."""
    return _column(value) + F.lit(0).cast("bigint")


def plus(a, b) -> Column:
    return wide(a) + _column(b)


def minus(a, b) -> Column:
    return wide(a) - _column(b)


def multiply(a, b) -> Column:
    return wide(a) * _column(b)


def divide(a, b) -> Column:
    """Always a DOUBLE; a zero divisor raises under ANSI."""
    return _column(a).cast("double") / _column(b).cast("double")


def mod(a, b) -> Column:
    """The remainder of both operands cut to BIGINT, with the dividend's sign; a zero divisor raises under ANSI."""
    return big(a) % big(b)


def holds(kind: str, a, b) -> Column:
    """A comparison (eq, neq, lt, gt, lte, gte) as a condition."""
    return _OPERATORS[kind](_column(a), _column(b))


def compare(kind: str, a, b) -> Column:
    """A comparison as INTEGER 0 or 1."""
    return holds(kind, a, b).cast("int")


def substr(s, start, length) -> Column:
    """Characters from a place that counts from 1: none outside the string, the rest for a negative length."""
    s, start, length = _column(s), _column(start).cast("int"), _column(length).cast("int")
    rest = F.substring(s, start, F.length(s))
    return F.when((start <= 0) | (start > F.length(s)), F.lit("")).when(length < 0, rest).otherwise(F.substring(s, start, length))


def upper_ascii(s) -> Column:
    """Upper case of a-z only; upper() follows Unicode."""
    return F.translate(_column(s), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def capitalise(s) -> Column:
    return F.concat(F.upper(substr(s, 1, 1)), substr(s, 2, -1))


def date_key(moment) -> Column:
    """A date or timestamp as BIGINT yyyymmdd."""
    return F.date_format(_column(moment), "yyyyMMdd").cast("bigint")
