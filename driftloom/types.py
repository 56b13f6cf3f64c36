"""Logical types and schemas: Spark types plus metadata for what Spark has no type for.

Enums are strings with their ordered values in the field's metadata, fixed-size arrays are arrays with a size, json and
uuid are strings with a tag, unsigned integers are widened. Fields are always nullable, names always unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSIGNED = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}
SIMPLE: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), **UNSIGNED,
    "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(), "json": T.StringType(), "uuid": T.StringType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(),
}
_TAGGED = {"json", "uuid", *UNSIGNED}
_UNSUPPORTED = (T.BinaryType, T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.NullType)


def field(name: str, kind: str | T.DataType, **metadata: Any) -> T.StructField:
    """A nullable field of a named logical type (``SIMPLE``) or a Spark type."""
    if isinstance(kind, str):
        return T.StructField(name, SIMPLE[kind], True, {"logical": kind, **metadata} if kind in _TAGGED else metadata)
    return T.StructField(name, kind, True, metadata)


def enum_field(name: str, values: Sequence[str]) -> T.StructField:
    if len(set(values)) != len(values):
        raise ValueError(f"repeated values in enum {name}")
    return T.StructField(name, T.StringType(), True, {"enum": list(values)})


def array_field(name: str, element: T.DataType, size: int) -> T.StructField:
    return T.StructField(name, T.ArrayType(element), True, {"size": size})


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.IntegralType) or f.metadata.get("logical") == "uint64"


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def is_enum(f: T.StructField) -> bool:
    return "enum" in f.metadata


def check_schema(schema: T.StructType) -> T.StructType:
    """The schema itself if its names are unique and its types supported."""
    names = [f.name.lower() for f in schema.fields]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"repeated columns: {sorted(repeated)}")
    for f in schema.fields:
        wide = isinstance(f.dataType, T.DecimalType) and f.metadata.get("logical") != "uint64"
        if wide or isinstance(f.dataType, _UNSUPPORTED):
            raise ValueError(f"unsupported type of column {f.name}: {f.dataType.simpleString()}")
    return schema


def select_fields(schema: T.StructType, names: Iterable[str]) -> T.StructType:
    """The named fields, in the order of the schema."""
    wanted = set(names)
    if missing := wanted - set(schema.names):
        raise KeyError(f"no such columns: {sorted(missing)}")
    return T.StructType([f for f in schema.fields if f.name in wanted])


def drop_fields(schema: T.StructType, names: Iterable[str]) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in set(names)])


def join_schemas(*schemas: T.StructType) -> T.StructType:
    return check_schema(T.StructType([f for s in schemas for f in s.fields]))


def to_text(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), sort_keys=True)


def from_text(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to a schema, with the metadata that engines lose on the way; fails on values that don't fit."""
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields))


def strip_time_zones(df: DataFrame) -> DataFrame:
    """Zoned timestamps become wall-clock timestamps."""
    zoned = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(zoned) if zoned else df


def cast(df: DataFrame, kinds: dict[str, str], strict: bool = True) -> DataFrame:
    """Columns cast to SQL types: strict fails on values that don't fit, else they become null."""
    return df.withColumns({c: F.col(c).cast(k) if strict else F.col(c).try_cast(k) for c, k in kinds.items()})
