"""The queries of the driver's contract: each operator over the driver's tables, with the SQL that gives the same.

Doubles with two decimals are added up as decimals, so that results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import VersionConflict
from tarn.operators.query import Query, run, shuffled
from tarn.sources.files import WriterOptions, write_partitioned
from tarn.sources.workdir import fresh_root
from tarn.streaming.sink import into_table
from tarn.table import Lake, Table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Run], Run]:
    """Registers a query under its name, with its SQL."""

    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str, table: str, **arguments) -> DataFrame:
    """A structured query of one of the driver's tables."""
    return run(source(spark, sf_dir, table), Query.of(**arguments))


def exact_sum(column: str) -> str:
    """A sum of money that is the same in any order, as a double."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def exact_avg(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({column})"


def loaded(spark: SparkSession, sf_dir: str, name: str, parts: int = 1, by: str | None = None, one_file: bool = False, lake: Lake | None = None, df: DataFrame | None = None) -> Table:
    """One of the driver's tables (or ``df`` of its rows) in a lake of its own (or in ``lake``), inserted in ``parts`` by remainders of a column."""
    df = source(spark, sf_dir, name) if df is None else df
    table = (lake or Lake(spark, fresh_root(spark))).create_table(name, df.schema)
    for part in range(parts):
        rows = df.where(F.col(by) % parts == part) if by else df
        table.insert(rows.coalesce(1) if one_file else rows, f"load-{part}")
    return table


FLAGSHIP = f"""SELECT l_returnflag, COUNT(*) AS n, {exact_sum("l_extendedprice")} AS total, {exact_avg("l_extendedprice")} AS mean,
    MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high
  FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag"""


@query(FLAGSHIP)
def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filter before a grouping, all five functions."""
    rows = asked(spark, sf_dir, "lineitem", filters="l_quantity > 10").withColumn("cents", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = run(rows, Query.of(group_by="l_returnflag", aggregates=[("count", "*", "n"), ("sum", "cents", "total"), ("min", "l_extendedprice", "low"), ("max", "l_extendedprice", "high")]))
    total = F.col("total").cast("double")
    return out.select("l_returnflag", "n", total.alias("total"), (total / F.col("n")).alias("mean"), "low", "high")


@query("SELECT * FROM nation")
def scan_nation(spark, sf_dir):
    return asked(spark, sf_dir, "nation")


@query("SELECT o_totalprice, o_orderkey FROM orders")
def project_orders(spark, sf_dir):
    return asked(spark, sf_dir, "orders", projection=["o_totalprice", "o_orderkey"])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq_str(spark, sf_dir):
    return asked(spark, sf_dir, "orders", filters="o_orderstatus = 'F'")


@query("SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'")
def filter_ne_str(spark, sf_dir):
    return asked(spark, sf_dir, "orders", filters="o_orderpriority <> '1-URGENT'")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def filter_gt_f64(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", filters="l_extendedprice > 50000", projection=["l_orderkey", "l_extendedprice"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 500")
def filter_lt_i64(spark, sf_dir):
    return asked(spark, sf_dir, "customer", filters="c_custkey < 500", projection=["c_custkey", "c_name"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey >= 1000")
def filter_ge_i64(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", filters="l_partkey >= 1000", projection=["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0.5")
def filter_le_f64(spark, sf_dir):
    return asked(spark, sf_dir, "customer", filters="c_acctbal <= 0.5", projection=["c_custkey", "c_acctbal"])


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 10 AND user_id != 7")
def filter_and(spark, sf_dir):
    return asked(spark, sf_dir, "events", filters=["event_type = 'click'", "value >= 10", ("user_id", "!=", 7)], projection=["event_id", "value"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-25 00:00:00'")
def filter_timestamp(spark, sf_dir):
    return asked(spark, sf_dir, "orders", filters="o_orderdate < '1998-04-25 00:00:00'", projection=["o_orderkey", "o_orderdate"])


@query("SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_unprojected(spark, sf_dir):
    return asked(spark, sf_dir, "customer", filters="c_mktsegment = 'BUILDING'", projection=["c_name"])


@query("SELECT event_type, COUNT(*) AS \"count_*\" FROM events GROUP BY event_type")
def agg_count_star(spark, sf_dir):
    return asked(spark, sf_dir, "events", group_by="event_type", aggregates=[("count", "*")])


@query("SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", group_by="l_returnflag", aggregates=[("SUM", "l_linenumber")])


@query("SELECT l_returnflag, AVG(l_linenumber) AS avg_l_linenumber FROM lineitem GROUP BY l_returnflag")
def agg_avg(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", group_by="l_returnflag", aggregates=[("avg", "l_linenumber")])


@query("SELECT event_type, MIN(ts) AS first_ts, MIN(props) AS least_props FROM events GROUP BY event_type")
def agg_min(spark, sf_dir):
    return asked(spark, sf_dir, "events", group_by="event_type", aggregates=[("min", "ts", "first_ts"), ("min", "props", "least_props")])


@query("SELECT o_orderpriority, MAX(o_totalprice) AS max_o_totalprice FROM orders GROUP BY o_orderpriority")
def agg_max(spark, sf_dir):
    return asked(spark, sf_dir, "orders", group_by="o_orderpriority", aggregates=[("max", "o_totalprice")])


@query("SELECT c_mktsegment, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def agg_min_negative(spark, sf_dir):
    return asked(spark, sf_dir, "customer", filters="c_acctbal < 0", group_by="c_mktsegment", aggregates=[("min", "c_acctbal", "low"), ("max", "c_acctbal", "high")])


@query("SELECT COUNT(*) AS n, MIN(l_shipdate) AS first_ship, MAX(l_quantity) AS most FROM lineitem")
def agg_global(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", aggregates=[("count", "*", "n"), ("min", "l_shipdate", "first_ship"), ("max", "l_quantity", "most")])


@query("SELECT COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", filters="l_quantity < 0", aggregates=[("count", "*", "n"), ("max", "l_quantity", "most")])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n, MAX(l_partkey) AS high FROM lineitem GROUP BY ALL")
def agg_multi_key(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", group_by=["l_returnflag", "l_linestatus", "l_linenumber"], aggregates=[("count", "*", "n"), ("max", "l_partkey", "high")])


@query("SELECT l_returnflag, SUM(l_partkey * l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_returnflag")
def agg_expr(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", group_by="l_returnflag", aggregates=[("sum", "l_partkey * l_linenumber", "total")])


@query("SELECT l_discount, COUNT(*) AS n FROM lineitem GROUP BY l_discount")
def agg_f64_key(spark, sf_dir):
    return asked(spark, sf_dir, "lineitem", group_by="l_discount", aggregates=[("count", "*", "n")])


@query("SELECT n, l_linestatus FROM (SELECT l_linestatus, COUNT(*) AS n, MIN(l_tax) AS low FROM lineitem GROUP BY l_linestatus)")
def agg_projected(spark, sf_dir):
    """A projection of an aggregate names its output columns."""
    return asked(spark, sf_dir, "lineitem", group_by="l_linestatus", aggregates=[("count", "*", "n"), ("min", "l_tax", "low")], projection=["n", "l_linestatus"])


CHAOS = f"""SELECT o_orderpriority, COUNT(*) AS n, {exact_sum("o_totalprice")} AS total, {exact_avg("o_totalprice")} AS mean,
    MIN(o_totalprice) AS low, MAX(o_totalprice) AS high
  FROM orders WHERE o_totalprice > 50000.0 GROUP BY o_orderpriority ORDER BY total DESC"""


@query(CHAOS)
def chaos_shape(spark, sf_dir):
    """SQL over a table of several inserts."""
    return loaded(spark, sf_dir, "orders", 3, "o_orderkey").lake.sql(CHAOS)


GOLDEN = "SELECT p_brand, COUNT(*) AS n, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2)) * p_size) AS DOUBLE) AS worth FROM part GROUP BY p_brand ORDER BY p_brand"


@query(GOLDEN)
def golden_shape(spark, sf_dir):
    return loaded(spark, sf_dir, "part").lake.sql(GOLDEN)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def shuffle_rows(spark, sf_dir):
    """A shuffle keeps all rows."""
    return shuffled(source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), 8, ["l_orderkey"])


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def write_hash_partitioned(spark, sf_dir):
    """Files dealt out by a key hold every row of a key in one file."""
    path = f"{fresh_root(spark)}/orders"
    write_partitioned(source(spark, sf_dir, "orders"), path, 4, ["o_custkey"], WriterOptions(compression="zstd"))
    rows = spark.read.parquet(path).groupBy("o_custkey", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("o_custkey").agg((F.sum("n") / F.count(F.lit(1))).cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topn(spark, sf_dir):
    return asked(spark, sf_dir, "orders", order_by=["o_totalprice desc", "o_orderkey"], projection=["o_orderkey", "o_totalprice"], limit=20)


@query("SELECT * FROM orders")
def insert_then_read(spark, sf_dir):
    return loaded(spark, sf_dir, "orders", 2, "o_orderkey").read()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_v1(spark, sf_dir):
    return loaded(spark, sf_dir, "orders", 2, "o_orderkey").read(version=1)


@query("SELECT COUNT(*) AS now, (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0) AS before, 0::BIGINT AS at_first FROM orders")
def time_travel_sql(spark, sf_dir):
    """Counts at three versions; a count of all rows reads the log alone."""
    table = loaded(spark, sf_dir, "orders", 2, "o_orderkey")
    now = table.query(aggregates=[("count", "*", "now")])
    before = table.lake.sql("SELECT COUNT(*) AS before FROM orders", {"orders": 1}).first()["before"]
    at_first = table.lake.sql("SELECT COUNT(*) AS n FROM orders", {"orders": 0}).first()["n"]
    return now.select("now", F.lit(before).cast("long").alias("before"), F.lit(at_first).cast("long").alias("at_first"))


@query("SELECT * FROM supplier")
def retry_same_txn(spark, sf_dir):
    """Inserting twice under one transaction id leaves the rows once."""
    table = loaded(spark, sf_dir, "supplier")
    table.insert(source(spark, sf_dir, "supplier"), "load-0")
    return table.read()


@query("SELECT 1::BIGINT AS won, 1::BIGINT AS lost, 2::BIGINT AS latest")
def commit_conflict(spark, sf_dir):
    """Of two commits on one base one wins."""
    table = loaded(spark, sf_dir, "region")
    outcome = {"won": 0, "lost": 0}
    for name in ("a", "b"):
        adds = table.write_files(source(spark, sf_dir, "region"), name)
        try:
            table.commit(1, name, adds)
            outcome["won"] += 1
        except VersionConflict:
            outcome["lost"] += 1
    return spark.createDataFrame([(outcome["won"], outcome["lost"], table.latest_version())], "won long, lost long, latest long")


@query("SELECT * FROM nation")
def orphan_invisible(spark, sf_dir):
    """Data files that no commit names are not read."""
    table = loaded(spark, sf_dir, "nation")
    table.write_files(source(spark, sf_dir, "nation"), "never-committed")
    return table.read()


@query("SELECT * FROM (VALUES (1::BIGINT), (2), (3)) AS t(version)")
def versions(spark, sf_dir):
    table = loaded(spark, sf_dir, "nation", 3, "n_nationkey")
    return spark.createDataFrame([(x,) for x in table.versions()], "version long")


@query("SELECT COUNT(*) AS rows FROM customer")
def snapshot_files(spark, sf_dir):
    """The rows that the log counts for a version's files."""
    return loaded(spark, sf_dir, "customer").files().agg(F.sum("rows").alias("rows"))


@query("SELECT c_custkey, c_name FROM customer")
def insert_csv(spark, sf_dir):
    """A table filled from CSV files."""
    root, df = fresh_root(spark), source(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df.write.option("header", True).csv(f"{root}/csv")
    table = Lake(spark, root).create_table("customer", df.schema)
    table.insert(f"{root}/csv", format="csv")
    return table.read()


@query("SELECT n_nationkey, n_name FROM nation")
def insert_json(spark, sf_dir):
    root, df = fresh_root(spark), source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df.write.json(f"{root}/json")
    table = Lake(spark, root).create_table("nation", df.schema)
    table.insert(f"{root}/json", format="json")
    return table.read()


@query("SELECT * FROM (VALUES (1::BIGINT, 'a b', 1.5::DOUBLE), (2, 'O''Brien', NULL)) AS t(id, name, value)")
def insert_rows(spark, sf_dir):
    table = Lake(spark, fresh_root(spark)).create_table("t", [{"name": "id", "type": "int64", "nullable": False}, {"name": "name", "type": "string"}, {"name": "value", "type": "float64"}])
    table.insert_rows([{"id": 1, "name": "a b", "value": 1.5}, {"id": 2, "name": "O'Brien"}])
    return table.read()


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def result_sink(spark, sf_dir):
    """A result written under the lake's root and read again."""
    table = loaded(spark, sf_dir, "nation")
    return spark.read.parquet(table.lake.save_result(table.query(group_by="n_regionkey", aggregates=[("count", "*", "n")]), "by_region"))


@query("SELECT event_id, event_type, value FROM events")
def streaming_sink(spark, sf_dir):
    """An extra: a stream of Parquet files appended exactly once."""
    root, df = fresh_root(spark), source(spark, sf_dir, "events").select("event_id", "event_type", "value")
    df.repartition(3).write.parquet(f"{root}/in")
    table = Lake(spark, root).create_table("events", df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for _ in range(2):
        into_table(stream, table, "events", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()
