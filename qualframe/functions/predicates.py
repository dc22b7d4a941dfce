"""Constraint names to native predicates.

A predicate is ``true`` (passes), ``false`` (fails) or ``null`` (not evaluated, because the value is null).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from typing import Any, Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import DocumentError
from qualframe.types import is_fraction, is_time

# Constraint names and the type or flag names each one applies to.
ORDERED_TYPES = (
    "int64", "int32", "is_numeric", "float64", "float32", "double", "string", "byte_array", "timestamp",
)
TEXT_TYPES = ("string", "byte_array")
CATEGORY_TYPES = ("is_categorical", "string", "byte_array")
APPLICABLE: dict[str, tuple[str, ...]] = {
    "greater": ORDERED_TYPES,
    "greater_equal": ORDERED_TYPES,
    "less": ORDERED_TYPES,
    "less_equal": ORDERED_TYPES,
    "not_equal": ORDERED_TYPES,
    "multiple_of": ORDERED_TYPES,
    "unique": ORDERED_TYPES,
    "min_length": TEXT_TYPES,
    "max_length": TEXT_TYPES,
    "format": TEXT_TYPES,
    "regex": TEXT_TYPES,
    "allowed_values": CATEGORY_TYPES,
}

# Text formats, as patterns both Java and RE2 read alike.
FORMAT_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "hostname": r"^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$",
    "date-time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
}

_INTEGRAL_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def applies_to(constraint: str, names: set[str]) -> bool:
    """Whether a constraint fits any of a field's type names and set flags."""
    return bool(names & set(APPLICABLE.get(constraint, ())))


def literal(value: Any, dtype: T.DataType) -> Column:
    """A constraint value as a literal of the column's type; raises ``DocumentError`` if it does not fit."""
    return F.lit(parsed_value(value, dtype)).cast(dtype)


def parsed_value(value: Any, dtype: T.DataType) -> Any:
    """The value itself: a number, truth value or text (ISO text for time)."""
    try:
        return _parse(value, dtype)
    except (ValueError, TypeError, decimal.InvalidOperation) as error:
        raise DocumentError(f"value {value!r} is no {dtype.simpleString()}") from error


def _parse(value: Any, dtype: T.DataType) -> Any:
    bits = _INTEGRAL_BITS.get(type(dtype))
    if bits:
        if isinstance(value, float) and not value.is_integer():
            raise ValueError(value)
        if isinstance(value, str) and not re.fullmatch(r"[+-]?[0-9]+", value):
            raise ValueError(value)
        number = int(value)
        if not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
            raise ValueError(value)
        return number
    if is_fraction(dtype):
        return float(value)
    if isinstance(dtype, T.StringType):
        return str(value)
    if is_time(dtype):
        if isinstance(value, dt.datetime):
            return value.isoformat()
        return dt.datetime.strptime(value, "%Y-%m-%dT%H:%M:%S").isoformat()
    if isinstance(dtype, T.DateType):
        return value.isoformat() if isinstance(value, dt.date) else dt.date.fromisoformat(value).isoformat()
    if isinstance(dtype, T.BooleanType):
        if isinstance(value, bool):
            return value
        return {"true": True, "false": False}[str(value).lower()] if str(value).lower() in ("true", "false") else _bad(value)
    if isinstance(dtype, T.DecimalType):
        number = decimal.Decimal(str(value))
        if number != round(number, dtype.scale) or abs(number) >= decimal.Decimal(10) ** (dtype.precision - dtype.scale):
            raise ValueError(value)
        return str(number)
    raise TypeError(dtype.simpleString())


def _bad(value: Any):
    raise ValueError(value)


def _count(value: Any) -> int:
    try:
        return _parse(value, T.IntegerType())
    except (ValueError, TypeError) as error:
        raise DocumentError(f"value {value!r} is no length") from error


def _compare(operator: Callable[[Column, Column], Column], nan_passes: bool):
    """Spark sorts NaN above every number; a comparison with NaN must be false instead."""

    def build(c: Column, dtype: T.DataType, value: Any) -> Column:
        test = operator(c, literal(value, dtype))
        return test & ~F.isnan(c) if nan_passes and is_fraction(dtype) else test

    return build


def _multiple_of(c: Column, dtype: T.DataType, value: Any) -> Column:
    step = _parse_step(value, dtype)
    if is_fraction(dtype):
        c, v = c.cast("double"), F.lit(step)
        near = F.abs(c - F.rint(c / v) * v) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(c))
        return near & ~F.isnan(c)
    return (c % literal(value, dtype)) == F.lit(0)


def _parse_step(value: Any, dtype: T.DataType) -> Any:
    if not (is_fraction(dtype) or type(dtype) in _INTEGRAL_BITS or isinstance(dtype, T.DecimalType)):
        raise DocumentError(f"multiple_of needs a number, not {dtype.simpleString()}")
    step = parsed_value(value, dtype)
    if float(step) == 0.0 or not math.isfinite(float(step)):
        raise DocumentError("multiple_of needs a step other than zero")
    return step


def _text_only(name: str, dtype: T.DataType) -> None:
    if not isinstance(dtype, T.StringType):
        raise DocumentError(f"{name} needs text, not {dtype.simpleString()}")


def _min_length(c: Column, dtype: T.DataType, value: Any) -> Column:
    _text_only("min_length", dtype)
    return F.char_length(c) >= F.lit(_count(value))


def _max_length(c: Column, dtype: T.DataType, value: Any) -> Column:
    _text_only("max_length", dtype)
    return F.char_length(c) <= F.lit(_count(value))


def _regex(c: Column, dtype: T.DataType, value: Any) -> Column:
    _text_only("regex", dtype)
    return c.rlike(str(value))


def _format(c: Column, dtype: T.DataType, value: Any) -> Column:
    _text_only("format", dtype)
    if value not in FORMAT_PATTERNS:
        raise DocumentError(f"unknown format {value!r}")
    shape = c.rlike(FORMAT_PATTERNS[value])
    if value == "date":
        return shape & F.try_to_date(c, "yyyy-MM-dd").isNotNull() | (c.isNull() & F.lit(None).cast("boolean"))
    if value == "date-time":
        day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull()
        clock = F.substring(c, 12, 8).rlike(FORMAT_PATTERNS["time"])
        return shape & day & clock | (c.isNull() & F.lit(None).cast("boolean"))
    return shape


def _allowed_values(c: Column, dtype: T.DataType, value: Any) -> Column:
    """Null is no allowed value, so it fails; the list is split at commas without trimming."""
    items = value.split(",") if isinstance(value, str) else list(value)
    return F.coalesce(c.isin([literal(item, dtype) for item in items]), F.lit(False))


_BUILDERS: dict[str, Callable[[Column, T.DataType, Any], Column]] = {
    "greater": _compare(lambda c, v: c > v, nan_passes=True),
    "greater_equal": _compare(lambda c, v: c >= v, nan_passes=True),
    "less": _compare(lambda c, v: c < v, nan_passes=False),
    "less_equal": _compare(lambda c, v: c <= v, nan_passes=False),
    "not_equal": _compare(lambda c, v: c != v, nan_passes=False),
    "multiple_of": _multiple_of,
    "min_length": _min_length,
    "max_length": _max_length,
    "format": _format,
    "regex": _regex,
    "allowed_values": _allowed_values,
}


def predicate(constraint: str, c: Column, dtype: T.DataType, value: Any, nulls_allowed: bool = False) -> Column:
    """The row-level test of one constraint (``unique`` needs a shuffle: see operators/uniqueness.py)."""
    if constraint not in _BUILDERS:
        raise DocumentError(f"unknown constraint {constraint!r}")
    if isinstance(dtype, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise DocumentError(f"{constraint} cannot test {dtype.simpleString()}")
    test = _BUILDERS[constraint](c, dtype, value)
    if constraint == "allowed_values" and nulls_allowed:
        return F.when(c.isNotNull(), test)
    return test


def every(c: Column, test: Callable[[Column], Column]) -> Column:
    """Whether all values of a list pass; a null list is not evaluated, a null in it only if the test judges nulls."""
    return F.when(c.isNotNull(), F.forall(c, lambda x: F.coalesce(test(x), F.lit(True))))


def leaf_predicate(constraint: str, c: Column, dtype: T.DataType, is_list: bool, value: Any,
                   nulls_allowed: bool = False) -> Column:
    """The test of a column, or of every value of a list column."""
    if is_list:
        return every(c, lambda x: predicate(constraint, x, dtype, value, nulls_allowed))
    return predicate(constraint, c, dtype, value, nulls_allowed)
