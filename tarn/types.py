"""Declared types, table schemas and their JSON form."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tarn.errors import SchemaError

#: Type names a table may declare. timestamp_ntz is what Parquet timestamps without a zone load as.
TYPES: dict[str, T.DataType] = {
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}
_NAMES = {v.simpleString(): k for k, v in TYPES.items()}
#: Types that a column may be widened to without loss.
WIDENS = {("int32", "int64"), ("int32", "float64"), ("float32", "float64")}
#: Types of columns that a table may be partitioned by.
PARTITION_TYPES = {"int32", "int64", "string", "boolean", "date"}
NUMERIC = {"int32", "int64", "float32", "float64"}


def type_name(kind: T.DataType) -> str:
    """The declared name of a Spark type."""
    name = _NAMES.get(kind.simpleString())
    if name is None:
        raise SchemaError(f"type {kind.simpleString()} cannot be stored; use one of {', '.join(TYPES)}")
    return name


def check_table_name(name: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_]{1,64}", name or ""):
        raise SchemaError(f"table name {name!r} is not 1 to 64 letters, digits or underscores")


def as_schema(fields) -> T.StructType:
    """A checked schema from a StructType or from [{"name", "type", "nullable" (default true)}]."""
    if isinstance(fields, T.StructType):
        fields = [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable} for f in fields]
    if not fields:
        raise SchemaError("a table needs a field")
    seen, out = set(), []
    for field in fields:
        name, kind = field.get("name"), field.get("type")
        if not name:
            raise SchemaError("a field needs a name")
        if name.lower() in seen:
            raise SchemaError(f"field {name!r} is there twice (names that differ in case only count as equal)")
        if kind not in TYPES:
            raise SchemaError(f"field {name!r} has the unknown type {kind!r}")
        seen.add(name.lower())
        out.append(T.StructField(name, TYPES[kind], bool(field.get("nullable", True))))
    return T.StructType(out)


def schema_json(schema: T.StructType) -> list[dict]:
    return [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable} for f in schema]
