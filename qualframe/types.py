"""Parquet type names of Spark types, as they appear in a file footer."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: (physical, logical) names in the Parquet format.
_SIMPLE = {
    "bigint": ("int64", "none"),
    "int": ("int32", "none"),
    "smallint": ("int32", "int"),
    "tinyint": ("int32", "int"),
    "double": ("double", "none"),
    "float": ("float", "none"),
    "string": ("byte_array", "string"),
    "binary": ("byte_array", "none"),
    "timestamp": ("int64", "timestamp"),
    "timestamp_ntz": ("int64", "timestamp"),
    "date": ("int32", "date"),
    "boolean": ("boolean", "none"),
}
NUMERIC_PHYSICAL = ("int64", "double")


def parquet_type(dtype: T.DataType) -> tuple[str, str]:
    """Physical and logical Parquet type of one Spark type."""
    if isinstance(dtype, T.DecimalType):
        physical = "int32" if dtype.precision <= 9 else "int64" if dtype.precision <= 18 else "fixed_len_byte_array"
        return physical, "decimal"
    name = "string" if isinstance(dtype, T.StringType) else dtype.simpleString()
    return _SIMPLE.get(name, (name, "none"))


def leaf_types(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Every leaf of a schema by its dotted path, in file order."""
    leaves: dict[str, T.DataType] = {}

    def walk(path: str, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for child in dtype.fields:
                walk(f"{path}.{child.name}" if path else child.name, child.dataType)
        elif isinstance(dtype, T.ArrayType):
            walk(f"{path}.list.element", dtype.elementType)
        elif isinstance(dtype, T.MapType):
            walk(f"{path}.key_value.key", dtype.keyType)
            walk(f"{path}.key_value.value", dtype.valueType)
        else:
            leaves[path] = dtype

    walk(prefix, schema)
    return leaves


def is_fraction(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def ddl_type(physical: str, logical: str) -> str:
    """Name of a Spark type that is written as this pair; for empty frames of a documented shape."""
    if logical == "decimal":
        return f"decimal({ {'int32': 9, 'int64': 18}.get(physical, 38)},0)"
    if logical == "timestamp":
        return "timestamp_ntz"
    return next((name for name, pair in _SIMPLE.items() if pair == (physical, logical)), "string")
