"""Versioned tables: create, insert, read at a version, describe, drop."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import SchemaError, TableExists, TableNotFound, VersionConflict
from tarn.jobs import Job, Jobs
from tarn.metrics import Metrics
from tarn.operators.predicate import as_comparisons
from tarn.operators.query import Query, finish, run
from tarn.sources import files as sources
from tarn.sources import paths
from tarn.sources.log import DataFile, Log, Snapshot
from tarn.sources.stats import footers, may_hold
from tarn.sources.store import open_store
from tarn.types import PARTITION_TYPES, as_schema, check_table_name, schema_json, type_name

#: Tries of an append whose base version was taken meanwhile.
APPEND_TRIES = 10
#: Snapshots kept per lake; they never change.
SNAPSHOTS = 256


class Table:
    """A handle on a table; it holds no state that a commit could outdate."""

    def __init__(self, lake: Lake, name: str, log: Log, partition_by: tuple[str, ...] = ()):
        self.lake, self.name, self.log, self.spark, self.partition_by = lake, name, log, lake.spark, partition_by
        self.store, self.folder = lake.store, paths.table_dir(name)

    def latest_version(self) -> int:
        return self.log.latest()

    def versions(self) -> list[int]:
        """1 to the latest."""
        return self.log.versions()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """What a version holds; None is the latest, looked up each time."""
        version = self.log.latest() if version is None else version
        kept, key = self.lake._snapshots, (self.name, self.lake._created[self.name], version)
        if key in kept:
            kept.move_to_end(key)
        else:
            kept[key] = self.log.snapshot(version)
            while len(kept) > SNAPSHOTS:
                kept.popitem(last=False)
        return kept[key]

    @property
    def schema(self):
        return self.snapshot().schema

    def _url(self, path: str) -> str:
        return self.store.url(f"{self.folder}/{path}")

    def read(self, version: int | None = None, filters=None) -> DataFrame:
        """A version as a DataFrame over its files, which later commits do not change.

        ``filters`` leave out files whose bounds show that no row can pass; rows are not filtered here.
        """
        now = self.snapshot(version)
        wanted = as_comparisons(filters)
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        held = [x for x in now.files if all(may_hold(x, c, now.schema, zone) for c in wanted)]
        return sources.scan(self.spark, [self._url(x.path) for x in held], now.schema)

    def files(self, version: int | None = None) -> DataFrame:
        """The data files of a version: path, rows, size, and bounds as JSON."""
        rows = [(x.path, x.rows, x.size, json.dumps(x.partition), json.dumps(x.low), json.dumps(x.high)) for x in self.snapshot(version).files]
        return self.spark.createDataFrame(rows, "path string, rows long, size long, partition string, low string, high string")

    def validate(self, version: int | None = None) -> None:
        """Raises if a version's files are missing or differ in size from what the log says."""
        now = self.snapshot(version)
        if now.files != self.log.snapshot(now.version).files:
            raise VersionConflict(f"version {now.version} replays differently")
        folders: dict[str, dict[str, int]] = {}
        for x in now.files:
            folder, _, name = x.path.rpartition("/")
            if folder not in folders:
                folders[folder] = self.store.sizes(f"{self.folder}/{folder}")
            if folders[folder].get(name) != x.size:
                raise TableNotFound(f"{x.path} of version {now.version} is missing or has another size")

    def commit(self, base: int, txn_id: str, adds=(), removes=()) -> tuple[int, bool]:
        """One new version on ``base``, or VersionConflict; see ``Log.commit``."""
        with self.lake.metrics.timed("commit", self.name):
            return self.log.commit(base, txn_id, adds, removes)

    def write_files(self, df: DataFrame, txn_id: str, options: sources.WriterOptions | None = None) -> list[DataFile]:
        """Writes ``df`` as data files that no version holds yet: staged first, then moved.

        Each call has a staging folder of its own, so tries of one transaction do not get in each other's way. The
        files of a partitioned table hold one value of each partition column.
        """
        schema = self.schema
        staging = f"{self.folder}/_tmp/{txn_id}-{uuid.uuid4().hex}"
        try:
            try:
                sources.write_dealt(sources.fitted(df, schema), self.store.url(staging), self.partition_by, options)
            except PySparkException as e:
                if sources.NOT_NULL in str(e):
                    raise SchemaError(str(e).split("\n")[0]) from e
                raise
            staged = sources.written(self.store, staging)
            found, moves = [], []
            for (name, size), (rows, low, high) in zip(staged, footers(self.spark, [self.store.url(x) for x, _ in staged], schema), strict=True):
                if rows:
                    path = paths.data_file(len(found))
                    moves.append((name, f"{self.folder}/{path}"))
                    # One value, or none where the bounds show that all are null.
                    found.append(DataFile(path, rows, size, {x: low.get(x) for x in self.partition_by}, low, high))
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda x: self.store.move(*x), moves))
            return found
        finally:
            self.store.delete(staging)

    def insert(self, data: DataFrame | str, txn_id: str | None = None, format: str = "parquet", options: sources.WriterOptions | None = None) -> int:
        """Appends a DataFrame, or a file or folder of a format, and returns the version.

        A transaction id that has committed before gives its version again and writes nothing. An append that loses
        its version to another commit is committed again on the new one.
        """
        with self.lake.metrics.timed("insert", self.name):
            return self._insert(data, txn_id or uuid.uuid4().hex, format, options)

    def _insert(self, data: DataFrame | str, txn_id: str, format: str, options: sources.WriterOptions | None) -> int:
        before = self.log.version_of(txn_id)
        if before is not None:
            return before
        df = sources.load(self.spark, data, format, self.schema) if isinstance(data, str) else data
        adds = self.write_files(df, txn_id, options)
        for attempt in range(APPEND_TRIES):
            try:
                version, duplicate = self.commit(self.log.latest(), txn_id, adds)
            except VersionConflict:
                if attempt == APPEND_TRIES - 1:
                    raise
                continue
            if duplicate:
                for x in adds:
                    self.store.delete(f"{self.folder}/{x.path}")
            return version

    def insert_rows(self, rows: list[dict], txn_id: str | None = None) -> int:
        """Appends rows given as dicts; a missing key is null."""
        schema = self.schema
        unknown = {k for r in rows for k in r} - set(schema.names)
        if unknown:
            raise SchemaError(f"the table has no column {', '.join(sorted(unknown))}")
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        try:
            df = self.spark.createDataFrame([tuple(r.get(x) for x in schema.names) for r in rows], loose)
        except PySparkException as e:
            raise SchemaError(str(e)) from e
        return self.insert(df, txn_id)

    def query(self, **arguments) -> DataFrame:
        """A structured query of this table; see ``Query.of``. Counting all rows reads the log only."""
        asked = Query.of(**arguments)
        if asked.counts_only:
            n = self.snapshot(asked.version).rows
            row = self.spark.range(1).select(*[F.lit(n).cast("long").alias(x.name) for x in asked.aggregates])
            return finish(row, asked)
        return run(self.read(asked.version, asked.filters), asked)

    def describe(self) -> dict:
        now = self.snapshot()
        return {"name": self.name, "latest_version": now.version, "schema": schema_json(now.schema), "files": len(now.files), "rows": now.rows, "size": now.size}


class Lake:
    """The tables under a root folder, local or of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, open_store(spark, root)
        self._snapshots: OrderedDict[tuple, Snapshot] = OrderedDict()
        self._created: dict[str, str] = {}
        self._logs: dict[str, Log] = {}
        self.metrics = Metrics()
        self.jobs = Jobs(spark, self.metrics)

    def create_table(self, name: str, schema, partition_by=()) -> Table:
        """A new table at version 0; its schema is a StructType or a list of {"name", "type", "nullable"}.

        Each data file of a table with ``partition_by`` holds one value of each of these columns, which it notes.
        """
        check_table_name(name)
        checked = as_schema(schema)
        keys = (partition_by,) if isinstance(partition_by, str) else tuple(partition_by)
        for key in keys:
            if key not in checked.names or type_name(checked[key].dataType) not in PARTITION_TYPES:
                raise SchemaError(f"{key!r} is no column of a type to partition by ({', '.join(sorted(PARTITION_TYPES))})")
        body = {"name": name, "id": uuid.uuid4().hex, "schema": schema_json(checked), "partition_by": list(keys)}
        if not self.store.put_if_absent(f"{paths.table_dir(name)}/_table.json", json.dumps(body).encode()):
            raise TableExists(f"there is a table {name}")
        return self.table(name)

    def table(self, name: str) -> Table:
        check_table_name(name)
        try:
            found = json.loads(self.store.read(f"{paths.table_dir(name)}/_table.json"))
        except Exception as e:
            raise TableNotFound(f"there is no table {name}") from e
        self._created[name] = found["id"]
        # Entries never change, so handles of one table share what has been read of its log.
        log = self._logs.get(found["id"])
        if log is None or log.store is not self.store:
            log = self._logs[found["id"]] = Log(self.store, f"{paths.table_dir(name)}/_log", as_schema(found["schema"]))
        return Table(self, name, log, tuple(found.get("partition_by", ())))

    def list_tables(self) -> list[str]:
        return [x for x in self.store.names("tables") if self.store.exists(f"tables/{x}/_table.json")]

    def drop_table(self, name: str) -> None:
        """Deletes a table with all its versions."""
        self.table(name)
        self.store.delete(f"{paths.table_dir(name)}/_table.json")
        self.store.delete(paths.table_dir(name))

    def describe(self, name: str) -> dict:
        return self.table(name).describe()

    def submit(self, text: str, versions: dict[str, int] | None = None) -> Job:
        """Runs SQL beside the caller; see ``tarn.jobs``."""
        return self.jobs.submit(lambda: self.sql(text, versions))

    def query(self, table: str, **arguments) -> DataFrame:
        return self.table(table).query(**arguments)

    def save_result(self, df: DataFrame, name: str, options: sources.WriterOptions | None = None) -> str:
        """Writes a query's result under the lake's root, for others to read; returns where. A name is used once."""
        check_table_name(name)
        where = self.store.url(paths.result_dir(name))
        (options or sources.WriterOptions()).of(df.write.mode("error")).parquet(where)
        return where

    def cached_snapshots(self) -> list[tuple[str, int]]:
        """Which (table, version) are kept, the last used last."""
        return [(name, version) for name, _, version in self._snapshots]

    def forget(self, name: str) -> None:
        """Drops the kept snapshots of a table; they are read again from its log when next asked for."""
        for key in [x for x in self._snapshots if x[0] == name]:
            del self._snapshots[key]

    def sql(self, text: str, versions: dict[str, int] | None = None) -> DataFrame:
        """Spark SQL over the lake's tables, each pinned to a version; see ``tarn.plans.sql``."""
        from tarn.plans.sql import sql

        return sql(self, text, versions)
