"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

_LIVE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh temporary folder only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tarn-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python finds it wherever the driver did."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="tarn-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder) / "files" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copy.parent))
    _SHIPPED.add(context.applicationId)


#: Rows of a file, about, where the writer knows how many there will be.
FILE_ROWS = 50_000
#: On a local disk, no checksum files beside those written: each costs a process that sets its permissions.
_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Writes intermediate results as Parquet in the shared folder, so that a lost executor costs no recomputation.

    Tables stay until ``drop``, the end of ``passing`` or that of the process, because a lazy result may still read
    them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tarn-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df``, computed once: written and read back with its schema.

        ``rows``, about how many it has, bounds the number of files, from four for each core upwards.
        """
        path = f"{self.base}/{len(self.paths)}"
        self.paths.append(path)
        _LIVE[path] = self.spark
        if rows is not None:
            df = df.coalesce(max(4 * self.spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
        (df.write.options(**_LOCAL) if path.startswith("file:") else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarn_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            _delete(frame._tarn_path)  # noqa: SLF001


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the intermediate tables that were made in it, but for those put in the list it gives."""
    before, kept = set(_LIVE), []
    yield kept
    for path in set(_LIVE) - before - {frame._tarn_path for frame in kept}:  # noqa: SLF001
        _delete(path)


def _delete(path: str) -> None:
    spark = _LIVE.pop(path, None)
    if spark is None:
        return
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


@atexit.register
def release_all() -> None:
    """Delete every intermediate table of this process; the results that read them are void afterwards."""
    for path in list(_LIVE):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted through it
            _LIVE.clear()


def widened(schema: StructType, **more: str) -> StructType:
    """``schema`` with further fields, by name and DDL type."""
    return StructType([*schema.fields, *[StructField(k, DataType.fromDDL(v)) for k, v in more.items()]])
