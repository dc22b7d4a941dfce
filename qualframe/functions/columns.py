"""Small column helpers shared by every module: references, clocks, text."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.document import DocumentError
from qualframe.types import is_fraction, is_time


# Fixed value: how the Parquet format names the values of a list.
LIST_STEP = ".list.element"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Reference one top-level column, whatever characters its name holds."""
    return F.col(quoted(name))


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Column and type behind a top-level name or a dotted path into structs."""
    if path in schema.names:
        return ref(path), schema[path].dataType
    dtype: T.DataType = schema
    parts = path.split(".")
    for part in parts:
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise DocumentError(f"no column {path!r}")
        dtype = dtype[part].dataType
    return F.col(".".join(quoted(part) for part in parts)), dtype


def leaf(schema: T.StructType, path: str) -> tuple[Column, T.DataType, bool]:
    """Like ``resolve``, and for the leaf path of a list (``a.list.element``) the list, its element type and ``True``."""
    if path not in schema.names and path.endswith(LIST_STEP):
        c, dtype = resolve(schema, path.removesuffix(LIST_STEP))
        if isinstance(dtype, T.ArrayType):
            return c, dtype.elementType, True
    return *resolve(schema, path), False


def has_column(schema: T.StructType, path: str) -> bool:
    try:
        leaf(schema, path)
    except DocumentError:
        return False
    return True


def roots(paths: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The top-level columns that leaf paths belong to, each once, in order; a path that leads nowhere stays as it is."""
    found = []
    for path in paths:
        first = path.split(".")[0]
        root = path if path in columns or first not in columns else first
        if root not in found:
            found.append(root)
    return found


def micros(c: Column) -> Column:
    """Microseconds since 1970 of either timestamp type (session zone is UTC, see session.py)."""
    return F.unix_micros(c.cast("timestamp"))


def dates_as_times(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns, where they are dates, as their midnights."""
    dates = [name for name in names if isinstance(resolve(df.schema, name)[1], T.DateType)]
    return df.withColumns({name: ref(name).cast("timestamp") for name in dates}) if dates else df


def epoch_seconds(c: Column) -> Column:
    return micros(c) / F.lit(1e6)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """A double for any column (null for text that is no number); time counts microseconds, dates days."""
    if is_time(dtype):
        return micros(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.StringType):
        return c.try_cast("double")
    return c.cast("double")


def usable(c: Column, dtype: T.DataType) -> Column:
    """Null instead of NaN, so that aggregates skip both."""
    return F.when(~F.isnan(c), c) if is_fraction(dtype) else c


def micros_text(c: Column) -> Column:
    """ISO text of a microsecond count, without a zone."""
    return F.date_format(F.timestamp_micros(c.cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def floor_day(c: Column) -> Column:
    return F.date_trunc("DAY", c)


def ceil_day(c: Column) -> Column:
    day = F.date_trunc("DAY", c)
    return F.when(day == c, day).otherwise(day + F.expr("INTERVAL 1 DAY"))


def clock_today(text: Column) -> Column:
    """``H:M:S`` text as that time today."""
    return F.try_to_timestamp(F.concat_ws(" ", F.current_date().cast("string"), text), F.lit("yyyy-MM-dd H:m:s"))


def fill_template(template: str, value: str | Column) -> Column:
    """Put a value wherever a template such as ``data/{x}/raw/`` says ``{x}``."""
    filler = F.lit(value) if isinstance(value, str) else value
    return F.replace(F.lit(template), F.lit("{x}"), filler)


def part_number(n: Column) -> Column:
    """At least four digits, padded with zeros; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))
