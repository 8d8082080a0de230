"""Reading files as tables and writing DataFrames as files."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.errors import QueryError, SchemaError
from tarn.sources.store import Store
from tarn.types import WIDENS, type_name

FORMATS = ("parquet", "csv", "json")
COMPRESSIONS = ("none", "snappy", "gzip", "lz4", "zstd")


@dataclass(frozen=True)
class WriterOptions:
    """How Parquet files are laid out."""

    compression: str = "snappy"
    row_group_bytes: int = 128 << 20
    page_bytes: int = 1 << 20
    dictionary: bool = True
    statistics: bool = True

    def of(self, writer):
        if self.compression not in COMPRESSIONS:
            raise QueryError(f"unknown compression {self.compression!r}; there are {', '.join(COMPRESSIONS)}")
        return (
            writer.option("compression", {"lz4": "lz4_raw"}.get(self.compression, self.compression))
            .option("parquet.block.size", self.row_group_bytes)
            .option("parquet.page.size", self.page_bytes)
            .option("parquet.enable.dictionary", str(self.dictionary).lower())
            .option("parquet.column.statistics.enabled", str(self.statistics).lower())
        )


def scan(spark: SparkSession, files: list[str], schema: StructType) -> DataFrame:
    """Parquet files by name; a column that a file lacks is null there. No file: no rows."""
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """A file or folder to insert from; a record that does not fit the schema is an error."""
    if kind not in FORMATS:
        raise QueryError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    if kind == "parquet":
        # As it is, so that types are compared and not silently changed.
        return spark.read.parquet(path)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def fitted(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: widened without loss, missing nullable ones null, nulls elsewhere an error when run."""
    own = {}
    for x in df.schema:
        if x.name.lower() in own:
            raise SchemaError(f"column {x.name!r} is there twice")
        own[x.name.lower()] = x
    extra = set(own) - {f.name.lower() for f in schema}
    if extra:
        raise SchemaError(f"the table has no column {', '.join(sorted(extra))}")
    out = []
    for field in schema:
        found = own.get(field.name.lower())
        if found is None:
            if not field.nullable:
                raise SchemaError(f"column {field.name!r} is missing and cannot be null")
            column = F.lit(None).cast(field.dataType)
        else:
            column = F.col(f"`{found.name}`")
            if found.dataType.simpleString() == "void":
                column = column.cast(field.dataType)
            elif found.dataType != field.dataType:
                pair = (type_name(found.dataType), type_name(field.dataType))
                if pair not in WIDENS:
                    raise SchemaError(f"column {field.name!r} is {pair[0]}, the table wants {pair[1]}")
                column = column.cast(field.dataType)
        if not field.nullable:
            column = F.coalesce(column, F.raise_error(F.lit(f"{NOT_NULL} {field.name}")).cast(field.dataType))
        out.append(column.alias(field.name))
    return df.select(*out)


#: What the error says when a column that cannot be null is.
NOT_NULL = "null in NOT NULL column"


def write_partitioned(df: DataFrame, path: str, partitions: int, columns: list[str] | None = None, options: WriterOptions | None = None) -> None:
    """Parquet files of ``df`` dealt out by ``columns``, at most one per partition and none for empty ones."""
    from tarn.operators.query import shuffled

    (options or WriterOptions()).of(shuffled(df, partitions, columns).write).parquet(path)


#: Writers at work by session, and the setting that the session had before.
_MICROS: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


@contextmanager
def _micros(spark: SparkSession) -> Iterator[None]:
    """Times are written as micros since the epoch while any writer is at work; the session's own setting comes back after the last."""
    name, key = "spark.sql.parquet.outputTimestampType", id(spark._jsparkSession)
    with _LOCK:
        n, before = _MICROS.get(key) or (0, spark.conf.get(name))
        _MICROS[key] = (n + 1, before)
        spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _MICROS[key]
            if n == 1:
                del _MICROS[key]
                spark.conf.set(name, before)
            else:
                _MICROS[key] = (n - 1, before)


def write_dealt(df: DataFrame, path: str, keys: tuple[str, ...], options: WriterOptions | None = None) -> None:
    """Parquet files of ``df``, each with one value of every key.

    Rows are dealt out by the keys beforehand, so that a value's rows are in few files; values with many rows are
    split again. Times are written as micros since the epoch, whose bounds footers hold.
    """
    marks = [f"_by{i}" for i in range(len(keys))]
    if keys:
        # Null and the empty string are values of their own.
        tags = {m: F.when(F.col(f"`{k}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(f"`{k}`").cast("string"))) for m, k in zip(marks, keys, strict=True)}
        df = df.withColumns(tags).hint("rebalance", *marks)
    writer = (options or WriterOptions()).of(df.write)
    with _micros(df.sparkSession):
        (writer.partitionBy(*marks) if keys else writer).parquet(path)


def written(store: Store, folder: str) -> list[tuple[str, int]]:
    """The data files that a writer left in a folder, in order, with their sizes."""
    found = [(f"{folder}/{x}", size) for x, size in sorted(store.sizes(folder).items()) if x.startswith("part-")]
    for name in store.names(folder):
        if name.startswith("_by"):
            found += written(store, f"{folder}/{name}")
    return found


def unique_name(prefix: str, extension: str) -> str:
    return f"{prefix}-{uuid.uuid4()}.{extension}"
