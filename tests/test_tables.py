"""The table layer: commits, idempotency, snapshots, visibility, compaction."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarn.compaction import Compactor, Policy, candidates, groups, worthwhile
from tarn.errors import FileValidation, QueryError, SchemaError, TableExists, TableNotFound, TransactionError, VersionConflict, VersionNotFound
from tarn.sources import paths
from tarn.sources.log import DataFile, Entry, Log, Snapshot, replay
from tarn.sources.store import HadoopStore, LocalStore
from tarn.table import Lake
from tarn.transactions import Transactions
from tarn.types import TYPES, as_schema

FIELDS = [{"name": "id", "type": "int64", "nullable": False}, {"name": "name", "type": "string"}, {"name": "value", "type": "float64"}]
SCHEMA = as_schema(FIELDS)
GOLDEN = [
    (1, "Electronics", "Laptop", 1000.0, 2),
    (2, "Electronics", "Mouse", 25.0, 5),
    (3, "Electronics", "Keyboard", 75.0, 3),
    (4, "Electronics", "Monitor", 300.0, 1),
    (5, "Furniture", "Chair", 150.0, 4),
    (6, "Furniture", "Desk", 400.0, 2),
    (7, "Furniture", "Lamp", 50.0, 6),
    (8, "Books", "Novel", 15.0, 10),
    (9, "Books", "Textbook", 80.0, 3),
]


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


@pytest.fixture
def table(lake):
    return lake.create_table("t", FIELDS)


def file(name, rows=10, size=100):
    return DataFile(f"data/{name}.parquet", rows, size)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_golden(spark, lake):
    df = spark.createDataFrame(GOLDEN, "id long, category string, product string, price double, quantity long")
    table = lake.create_table("sales", df.schema)
    table.insert(df)
    text = "SELECT category, COUNT(*) AS n, SUM(price * quantity) AS total, AVG(price) AS mean FROM sales GROUP BY category ORDER BY category"
    for _ in range(3):
        assert [tuple(r) for r in lake.sql(text).collect()] == [("Books", 2, 390.0, 47.5), ("Electronics", 4, 2650.0, 350.0), ("Furniture", 3, 1700.0, 200.0)]
    assert lake.query("sales", aggregates=[("count", "*")]).first()["count_*"] == 9
    again = lake.query("sales", group_by="category", aggregates=[("sum", "price * quantity", "total"), ("avg", "price")], order_by="category")
    assert [tuple(r) for r in again.collect()] == [("Books", 390.0, 47.5), ("Electronics", 2650.0, 350.0), ("Furniture", 1700.0, 200.0)]


def test_names_and_schemas(lake):
    for name in ("", "a b", "x" * 65, "a-b", "../x"):
        with pytest.raises(SchemaError):
            lake.create_table(name, FIELDS)
    for fields in ([], [{"name": "", "type": "int64"}], [{"name": "a", "type": "decimal"}], [{"name": "Id", "type": "int64"}, {"name": "id", "type": "int64"}]):
        with pytest.raises(SchemaError):
            lake.create_table("t", fields)
    lake.create_table("t", [{"name": f"c_{k}", "type": k} for k in TYPES])
    with pytest.raises(TableExists):
        lake.create_table("t", FIELDS)
    assert lake.list_tables() == ["t"]
    assert lake.describe("t")["latest_version"] == 0 and lake.table("t").read().count() == 0
    lake.drop_table("t")
    assert lake.list_tables() == []
    for f in (lambda: lake.table("t"), lambda: lake.drop_table("t"), lambda: lake.query("t")):
        with pytest.raises(TableNotFound):
            f()


def test_a_table_made_again_is_another_one(spark, lake):
    lake.create_table("t", FIELDS).insert_rows([{"id": 1}])
    assert ids(lake.table("t").read()) == [1]
    lake.drop_table("t")
    lake.create_table("t", FIELDS).insert_rows([{"id": 2}])
    assert ids(lake.table("t").read()) == [2]


def test_insert_and_time_travel(spark, table):
    assert table.insert_rows([{"id": 1, "name": "a", "value": 1.0}]) == 1
    pinned = table.read()
    assert table.insert_rows([{"id": 2}, {"id": 3, "name": None}]) == 2
    assert ids(table.read()) == [1, 2, 3] and ids(table.read(1)) == [1] and ids(table.read(0)) == [] and ids(pinned) == [1]
    assert table.versions() == [1, 2]
    with pytest.raises(VersionNotFound):
        table.read(3)
    assert table.lake.sql("SELECT COUNT(*) AS n FROM t", {"t": 1}).first().n == 1
    with pytest.raises(TableNotFound):
        table.lake.sql("SELECT 1", {"t": 1})
    assert table.query(aggregates=[("count", "*", "n")], version=1).first().n == 1
    table.validate()


def test_inserts_that_do_not_fit(spark, table):
    bad = [
        spark.createDataFrame([("x",)], "id string"),
        spark.createDataFrame([(1, 2)], "id long, other long"),
        spark.createDataFrame([("a",)], "name string"),
        spark.createDataFrame([(None,)], "id long"),
        spark.createDataFrame([(1, "a")], "id long, value string"),
    ]
    for df in bad:
        with pytest.raises(SchemaError):
            table.insert(df)
    with pytest.raises(SchemaError):
        table.insert_rows([{"id": 1, "other": 2}])
    with pytest.raises(SchemaError):
        table.insert_rows([{"id": "x"}])
    assert table.latest_version() == 0 and table.store.names(f"{table.folder}/_tmp") == []
    assert table.insert(spark.createDataFrame([(1, 2.5)], "ID int, value float")) == 1
    assert [tuple(r) for r in table.read().collect()] == [(1, None, 2.5)]


def test_empty_insert_is_a_version_without_files(spark, table):
    assert table.insert(spark.createDataFrame([], table.schema)) == 1
    assert table.snapshot().files == () and table.read().count() == 0


def test_all_types_come_back(spark, lake, tmp_path):
    import datetime as dt

    table = lake.create_table("t", [{"name": f"c_{k}", "type": k} for k in TYPES])
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    row = (1, 2, 0.5, 1.5, "é", True, dt.date(2024, 1, 2), now, now)
    schema = table.schema
    table.insert(spark.createDataFrame([row, (None,) * len(row)], schema))
    got = table.read()
    assert [f.dataType for f in got.schema] == [f.dataType for f in schema]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([row, (None,) * len(row)], key=repr)


def test_csv_and_json(spark, table, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,value\n1,a b,1.5\n2,,\n")
    (tmp_path / "x.json").write_text('{"id": 3, "name": "c"}\n{"id": 4, "value": 2}\n')
    table.insert(str(tmp_path / "x.csv"), format="csv")
    table.insert(str(tmp_path / "x.json"), format="json")
    assert ids(table.read()) == [1, 2, 3, 4]
    with pytest.raises(QueryError):
        table.insert(str(tmp_path / "x.csv"), format="avro")


def test_exactly_once(table):
    assert table.insert_rows([{"id": 100}], txn_id="x") == 1
    assert table.insert_rows([{"id": 101}], txn_id="y") == 2
    assert table.insert_rows([{"id": 100}], txn_id="x") == 1
    assert ids(table.read()) == [100, 101]


def test_orphans_and_staged_files_are_invisible(spark, table):
    table.insert_rows([{"id": 1}])
    table.write_files(spark.createDataFrame([(2,)], "id long"), "orphan")
    spark.createDataFrame([(3,)], "id long").write.parquet(table._url("_tmp/x/1"))
    assert ids(table.read()) == [1]
    kept = table.snapshot().files[0]
    table.commit(1, "remove", removes=[kept.path])
    assert ids(table.read()) == [] and ids(table.read(1)) == [1]


def test_commit_rules(table):
    assert table.commit(0, "a", [file("a"), file("b")]) == (1, False)
    assert table.commit(0, "a", [file("a"), file("b")]) == (1, True)
    assert table.commit(77, "a") == (1, True)
    with pytest.raises(VersionConflict):
        table.commit(0, "b", [file("c")])
    for adds, removes in (([file("a")], []), ([], ["data/x.parquet"]), ([file("c"), file("c")], []), ([file("c")], ["data/c.parquet"]), ([file("c", 0, 5)], []), ([DataFile("../x", 1, 1)], []), ([DataFile("", 1, 1)], [])):
        with pytest.raises(FileValidation):
            table.commit(1, "bad", adds, removes)
    with pytest.raises(TransactionError):
        table.commit(1, "")
    assert table.commit(1, "c", [file("c")], ["data/a.parquet"]) == (2, False)
    assert [x.path for x in table.snapshot().files] == ["data/b.parquet", "data/c.parquet"]
    assert table.commit(2, "free", [DataFile("setup/x.parquet", 1, 1)]) == (3, False)


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 10))
def test_one_winner_per_base(tmp_path_factory, n):
    store = LocalStore(str(tmp_path_factory.mktemp("race")))
    start = threading.Barrier(n)

    def commit(i):
        log = Log(store, "_log", SCHEMA)
        start.wait()
        try:
            return log.commit(0, f"txn-{i}", [file(str(i))])
        except VersionConflict:
            return None

    with ThreadPoolExecutor(n) as pool:
        outcome = list(pool.map(commit, range(n)))
    assert [x for x in outcome if x] == [(1, False)]
    assert len(Log(store, "_log", SCHEMA).snapshot().files) == 1


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 10), st.integers(1, 4))
def test_retries_are_idempotent(tmp_path_factory, retries, n):
    log = Log(LocalStore(str(tmp_path_factory.mktemp("retry"))), "_log", SCHEMA)
    adds = [file(str(i)) for i in range(n)]
    got = [log.commit(0, "txn", adds) for _ in range(retries)]
    assert got == [(1, False)] + [(1, True)] * (retries - 1)
    assert log.latest() == 1 and len(log.snapshot().files) == n


def entries_of(seeds):
    there, out, wide = [], [], as_schema([*FIELDS, {"name": "more", "type": "string"}])
    for i, seed in enumerate(seeds):
        adds = [file(f"{i}-{j}") for j in range(seed % 4)]
        removes = there[: seed % 3]
        there = there[len(removes) :] + [x.path for x in adds]
        out.append(Entry(i + 1, 1000 + i, f"txn-{i}", wide if i >= 3 else SCHEMA, tuple(adds), tuple(removes)))
    return out, sorted(there), wide


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=10), st.randoms())
def test_replay_is_deterministic(seeds, random):
    entries, there, wide = entries_of(seeds)
    mixed = [Entry.from_json(x.to_json()) for x in entries]
    random.shuffle(mixed)
    one, two = replay(SCHEMA, entries, len(entries)), replay(SCHEMA, mixed, len(entries))
    assert one == two and [x.path for x in one.files] == there
    assert one.schema == (wide if len(entries) > 3 else SCHEMA)
    assert replay(SCHEMA, entries, 0) == Snapshot(0, SCHEMA, ())


def test_checkpoints(tmp_path):
    log = Log(LocalStore(str(tmp_path)), "_log", SCHEMA)
    for i in range(4):
        log.commit(i, f"txn-{i}", [file(str(i))])
    full = log.snapshot()
    assert log.checkpoint(2) == 2
    (tmp_path / "_log" / "junk.txt").write_text("x")
    fresh = Log(LocalStore(str(tmp_path)), "_log", SCHEMA)
    assert fresh.snapshot() == full and 1 not in fresh._entries
    assert fresh.versions() == [1, 2, 3, 4] and len(fresh.snapshot(1).files) == 1


def test_a_missing_newer_column_is_null(spark, lake):
    from tarn.sources.files import scan

    table = lake.create_table("t", FIELDS)
    table.insert_rows([{"id": 1}])
    wide = as_schema([*FIELDS, {"name": "more", "type": "string"}])
    table.log.commit(1, "evolve", schema=wide)
    assert table.schema == wide and table.snapshot(1).schema == SCHEMA
    assert [tuple(r) for r in table.read().collect()] == [(1, None, None, None)]
    assert scan(spark, [], wide).columns == wide.names


def test_readers_of_a_version_agree_while_others_write(table):
    table.insert_rows([{"id": 1}, {"id": 2}])
    with ThreadPoolExecutor(6) as pool:
        reads = [pool.submit(lambda: [x.path for x in table.snapshot(1).files]) for _ in range(10)]
        writes = [pool.submit(table.log.commit, 1, f"w{i}", [file(f"w{i}")]) for i in range(3)]
    assert len({tuple(x.result()) for x in reads}) == 1
    assert sum(x.exception() is None for x in writes) == 1


def test_concurrent_appends_all_commit(table):
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda i: table.insert_rows([{"id": i}]), range(3)))
    assert sorted(versions) == [1, 2, 3] and ids(table.read()) == [0, 1, 2]


def test_statistics_skip_files(spark, lake):
    table = lake.create_table("t", FIELDS)
    table.insert(spark.createDataFrame([(i, f"n{i:03d}", float(i)) for i in range(100)], table.schema).repartitionByRange(4, "id"))
    files = table.snapshot().files
    assert sum(x.rows for x in files) == 100 and all(x.size > 0 and x.low["id"] <= x.high["id"] for x in files)
    for text, n in (("id > 90", 9), ("id = 5", 1), ("id != 5", 99), ("name <= 'n004'", 5), ("value < 3.5", 4), ("id > 1000", 0)):
        assert table.query(filters=text).count() == n
        assert len(table.read(filters=text).inputFiles()) <= (0 if n == 0 else 4 if "!=" in text else 1)
    assert table.files().count() == len(files)


TIMES = [{"name": "id", "type": "int64"}, {"name": "day", "type": "date"}, {"name": "at", "type": "timestamp"}, {"name": "local", "type": "timestamp_ntz"}]


@pytest.fixture
def timed(spark, lake):
    """A hundred days in four files."""
    table = lake.create_table("timed", TIMES)
    rows = spark.range(100).selectExpr("id", "date_add(DATE'2024-01-01', cast(id AS int)) AS day", "timestampadd(DAY, id, TIMESTAMP'2024-01-01 12:00:00 UTC') AS at", "timestampadd(DAY, id, TIMESTAMP_NTZ'2024-01-01 12:00:00') AS local")
    table.insert(rows.repartitionByRange(4, "id"))
    assert table.snapshot().rows == 100 and len(table.snapshot().files) == 4
    return table


@pytest.mark.parametrize("text, n, files", [("day > '2024-04-05'", 4, 1), ("day = '2024-01-03'", 1, 1), ("at < '2024-01-03 12:00:00'", 2, 1), ("at >= '2024-01-03T12:00:00+02:00'", 98, 4), ("local <= '2024-01-02 12:00:00'", 2, 1), ("local > '2025-01-01 00:00:00'", 0, 0), ("day > '2024-4-5'", 4, 4)])
def test_dates_and_times_skip_files(timed, text, n, files):
    assert timed.query(filters=text).count() == n
    assert len(timed.read(filters=text).inputFiles()) == files


@pytest.mark.parametrize("where, n, files", [("day > DATE'2024-04-05'", 4, 1), ("at < TIMESTAMP'2024-01-03 12:00:00'", 2, 1), ("local <= TIMESTAMP_NTZ'2024-01-02 12:00:00' AND id >= 0", 2, 1), ("id = 99 OR id = 0", 2, 4), ("id > 1000", 0, 0), ("id + 0 > 90", 9, 1), ("id % 50 = 0", 2, 4), ("id IN (97, 99, NULL)", 2, 1), ("day IN (DATE'2024-01-02', DATE'2024-01-05')", 2, 1), ("id NOT IN (1, 2)", 98, 4)])
def test_sql_skips_files(timed, where, n, files):
    df = timed.lake.sql(f"SELECT * FROM timed WHERE {where}")
    assert df.count() == n and len(df.inputFiles()) == files


def test_sql_reads_what_any_of_its_scans_needs(timed):
    sql = timed.lake.sql
    assert sql("SELECT count(*) AS n FROM timed a JOIN timed b ON a.id = b.id + 90 WHERE a.id >= 90 AND b.id < 10").first()["n"] == 10
    assert sql("SELECT count(*) AS n FROM timed WHERE id > (SELECT max(id) - 5 FROM timed WHERE id < 50)").first()["n"] == 55
    assert sql("WITH x AS (SELECT * FROM timed WHERE id < 3) SELECT count(*) AS n FROM x, timed t WHERE t.id > 97").first()["n"] == 6


def test_sql_keeps_the_settings_of_the_session(spark, timed):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = timed.lake.sql("SELECT cast(at AS string) AS text FROM timed WHERE at < TIMESTAMP'2024-01-01 21:30:00'")
        assert [r.text for r in df.collect()] == ["2024-01-01 21:00:00"]
        assert df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset("spark.sql.caseSensitive")


def test_times_of_writers_side_by_side(spark, lake):
    """All of them write times with bounds, and the session's own setting is back afterwards."""
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    table = lake.create_table("many", [{"name": "at", "type": "timestamp"}])
    rows = spark.range(20).selectExpr("timestampadd(DAY, id, TIMESTAMP'2024-01-01 12:00:00 UTC') AS at")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: table.insert(rows, f"t{i}"), range(8)))
    assert table.read().count() == 160 and all("at" in x.low for x in table.snapshot().files)
    assert spark.conf.get(name) == before


def test_partitioned_tables(spark, lake):
    """Files of one value each, noted in the log; null, the empty string and odd characters are values."""
    fields = [{"name": "id", "type": "int64"}, {"name": "key", "type": "string"}, {"name": "on", "type": "boolean"}]
    table = lake.create_table("p", fields, partition_by=["key", "on"])
    keys = [None, "", "a", "b/c=d e", "n"]
    rows = [(i, keys[i % 5], i % 2 == 0 if i % 3 else None) for i in range(300)]
    table.insert(spark.createDataFrame(rows, table.schema).repartition(3))
    assert sorted(map(str, (tuple(r) for r in table.read().collect()))) == sorted(map(str, rows))
    files = table.snapshot().files
    assert {(x.partition["key"], x.partition["on"]) for x in files} == {(k, o) for _, k, o in rows}
    held = table.read(filters=["key = 'b/c=d e'", "on = true"])
    assert held.count() == sum(1 for _, k, o in rows if k == "b/c=d e" and o) and len(held.inputFiles()) < len(files) / 4
    assert len(lake.sql("SELECT * FROM p WHERE key = ''").inputFiles()) < len(files) / 3
    assert lake.table("p").partition_by == ("key", "on")
    with pytest.raises(SchemaError):
        lake.create_table("q", fields, partition_by="none")


def test_a_new_handle_reads_few_entries(spark, tmp_path):
    """Commits leave checkpoints with their transactions, so what an insert reads of the log does not grow with it."""
    class Counting(LocalStore):
        reads = 0

        def read(self, path):
            self.reads += 1
            return super().read(path)

    store = Counting(str(tmp_path))
    for i in range(65):
        Log(store, "_log", SCHEMA).commit(i, f"txn-{i}", [file(str(i))])
    store.reads, fresh = 0, Log(store, "_log", SCHEMA)
    assert fresh.version_of("txn-3") == 4 and fresh.version_of("never") is None and fresh.latest() == 65
    assert fresh.commit(65, "more", [file("x")]) == (66, False) and fresh.commit(0, "txn-50") == (51, True)
    assert store.reads <= 8
    assert len(fresh.snapshot().files) == 66 and len(fresh.snapshot(30).files) == 30


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_a_writer_that_dies_while_committing(spark, tmp_path, kind, monkeypatch):
    """Neither an empty nor half an entry is seen, and the next writer gets the version."""
    store = LocalStore(str(tmp_path)) if kind == "local" else HadoopStore(spark, f"file://{tmp_path}")
    log = Log(store, "_log", SCHEMA)
    log.commit(0, "one", [file("a")])
    with monkeypatch.context() as m:
        if kind == "local":
            m.setattr("os.link", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        else:
            m.setattr(store, "_claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            log.commit(1, "dead", [file("b")])
    fresh = Log(store, "_log", SCHEMA)
    assert fresh.versions() == [1] and fresh.version_of("dead") is None
    assert fresh.commit(1, "two", [file("c")]) == (2, False)


def test_a_retry_leaves_the_first_try_alone(spark, table):
    """Two tries of one transaction stage apart, so the one that ends first takes nothing from the other."""
    staged = spark.createDataFrame([(3,)], "id long").write
    staged.parquet(table._url("_tmp/same-other/x"))
    assert table.insert_rows([{"id": 1}], "same") == 1
    assert table.store.names(f"{table.folder}/_tmp") == ["same-other"]


def test_passing_errors_of_a_store_are_tried_again(tmp_path):
    class Shaky(LocalStore):
        left = 2

        def put_if_absent(self, path, data):
            self.left -= 1
            if self.left >= 0:
                raise OSError("not now")
            return super().put_if_absent(path, data)

    log = Log(Shaky(str(tmp_path)), "_log", SCHEMA)
    assert log.commit(0, "one", [file("a")]) == (1, False) and log.versions() == [1]


def test_bounds_with_nan_null_and_zero(spark, lake):
    table = lake.create_table("t", FIELDS)
    table.insert(spark.createDataFrame([(1, None, float("nan")), (2, None, -0.0)], table.schema).coalesce(1))
    held = table.snapshot().files[0]
    assert "value" not in held.low and "name" not in held.low and held.low["id"] == 1
    assert ids(table.query(filters="value = 0")) == [2] and ids(table.query(filters="value > 1")) == [1]


def compacted_rows(lake, spark, n=4):
    table = lake.create_table("c", [{"name": "id", "type": "int64"}, {"name": "value", "type": "int64"}, {"name": "category", "type": "string"}])
    for i in range(n):
        rows = [(i * 1000 + j + 1, (17 * j + 7 * i + 42) % 300, "ABC"[(j + i) % 3]) for j in range(100 + 50 * i)]
        table.insert(spark.createDataFrame(rows, table.schema).coalesce(1))
    return table


def test_compaction_preserves_rows(spark, lake):
    table = compacted_rows(lake, spark)
    before = sorted(map(tuple, table.read().collect()))
    compactor = Compactor()
    metrics = compactor.metrics(table).first()
    assert (metrics.small_files, metrics.groups, metrics.worthwhile) == (4, 1, True)
    assert compactor.compact(table) == 5
    assert sorted(map(tuple, table.read().collect())) == before == sorted(map(tuple, table.read(4).collect()))
    assert len(table.snapshot().files) == 1 and table.snapshot().rows == len(before)
    assert compactor.compact(table) is None and compactor.history(table).first().files_before == 4
    table.validate(4)


def test_compaction_is_planned_anew_after_a_conflict(spark, lake, monkeypatch):
    table = compacted_rows(lake, spark)
    compactor, original, raced = Compactor(), table.commit, []

    def commit(*arguments):
        if not raced:
            raced.append(table.insert_rows([{"id": 9}]))
        return original(*arguments)

    monkeypatch.setattr(table, "commit", lambda *a: commit(*a) if str(a[1]).startswith("compact-") else original(*a))
    assert compactor.compact(table) == 6 and raced == [5]
    assert 9 in ids(table.read()) and len(table.snapshot().files) == 1


def test_compaction_policy():
    mib = 1 << 20
    files = tuple(DataFile(f"data/{i}.parquet", rows, size * mib) for i, (rows, size) in enumerate([(1000, 5), (1500, 8), (1200, 6), (1, 50), (1, 80)]))
    now, policy = Snapshot(1, SCHEMA, files), Policy()
    assert [x.size // mib for x in candidates(now, policy)] == [5, 6, 8] and len(groups(now, policy)) == 1
    assert worthwhile(now, policy)
    assert not worthwhile(Snapshot(1, SCHEMA, files[3:]), policy) and not worthwhile(Snapshot(1, SCHEMA, ()), policy)
    assert groups(Snapshot(1, SCHEMA, files[:2] + files[3:]), policy) == []
    assert [len(x) for x in groups(now, Policy(target_bytes=12 * mib, least_files=1))] == [2, 1]


def test_cancelling(table):
    compactor = Compactor()
    assert compactor.running() == [] and compactor.cancel("t") is False
    compactor._running["t"] = threading.Event()
    assert compactor.cancel("t") and compactor.running() == ["t"]
    with pytest.raises(QueryError):
        compactor.compact(table)


def test_transactions(table):
    manager = Transactions(table.lake)
    one, two = manager.begin("t"), manager.begin("t")
    one.adds, two.adds = [file("a")], [file("b")]
    assert len(manager.active()) == 2
    assert manager.commit(one) == 1 == manager.commit(one)
    with pytest.raises(VersionConflict):
        manager.commit(two)
    three = manager.begin("t", "three")
    table.commit(1, "other", [file("c")])
    three.adds = [file("d")]
    assert manager.commit(three, rebase=True) == 3 and three.retries == 1
    assert manager.status("three") == "committed" and manager.stats() == {"active": 0, "committed": 2, "failed": 1, "timed out": 0}
    late = Transactions(table.lake, seconds=-1)
    txn = late.begin("t")
    assert late.sweep() == [txn.id] and late.status(txn.id) == "timed out"
    with pytest.raises(TransactionError):
        late.commit(txn)
    with pytest.raises(TransactionError):
        late.status("unknown")


def test_results_and_kept_snapshots(spark, table):
    from pyspark.errors import AnalysisException

    table.insert_rows([{"id": 1}, {"id": 2}])
    where = table.lake.save_result(table.query(filters="id > 1"), "job_1")
    assert ids(spark.read.parquet(where)) == [2] and where.endswith("results/job_1/result.parquet")
    with pytest.raises(AnalysisException):
        table.lake.save_result(table.read(), "job_1")
    table.read(1), table.read(0)
    assert table.lake.cached_snapshots()[-2:] == [("t", 1), ("t", 0)]
    table.lake.forget("t")
    assert table.lake.cached_snapshots() == [] and ids(table.read()) == [1, 2]


def test_paths():
    assert paths.commit_file(7) == "00000000000000000007.json" and paths.commit_version("00000000000000000007.json") == 7
    assert paths.commit_version("7.json") is None and paths.commit_version("checkpoint_7.json") is None
    path = f"tables/t/{paths.data_file(3)}"
    assert paths.parse_data_file(path)[:2] == ("t", 3) and len(paths.parse_data_file(path)[2]) == 36
    with pytest.raises(FileValidation):
        paths.parse_data_file("tables/t/other/part-1.parquet")


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_stores(spark, tmp_path, kind):
    store = LocalStore(str(tmp_path)) if kind == "local" else HadoopStore(spark, f"file://{tmp_path}")
    assert store.put_if_absent("a/b.json", b"one") and not store.put_if_absent("a/b.json", b"two")
    assert store.read("a/b.json") == b"one" and store.size("a/b.json") == 3 and store.names("none") == []
    store.move("a/b.json", "c/d.json")
    assert store.exists("c/d.json") and not store.exists("a/b.json") and "d.json" in store.names("c")
    store.copy("c/d.json", "e/f.json")
    assert store.read("e/f.json") == store.read("c/d.json") == b"one" and store.sizes("e") == {"f.json": 3} and store.sizes("none") == {}
    store.delete("c")
    assert not store.exists("c")


def test_a_lake_on_a_hadoop_file_system(spark, tmp_path):
    lake = Lake(spark, "x")
    lake.store = HadoopStore(spark, f"file://{tmp_path}")
    table = lake.create_table("t", FIELDS)
    table.insert_rows([{"id": 1, "name": "a"}])
    assert ids(table.read()) == [1] and table.snapshot().files[0].low == {"id": 1, "name": "a"}
    with pytest.raises(VersionConflict):
        table.commit(0, "late", [file("x")])


@pytest.mark.parametrize("compression", ["none", "snappy", "gzip", "zstd", "lz4"])
def test_writer_options(spark, table, compression):
    from tarn.sources.files import WriterOptions

    table.insert(spark.createDataFrame([(1, "a", 0.5)], table.schema), options=WriterOptions(compression=compression, dictionary=False, row_group_bytes=1 << 20))
    assert ids(table.read()) == [1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(max_size=5).filter(lambda x: not any(0xD800 <= ord(c) < 0xE000 for c in x)), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=30), parts=st.integers(1, 5))
def test_parquet_round_trip(spark, tmp_path_factory, rows, parts):
    table = Lake(spark, str(tmp_path_factory.mktemp("trip"))).create_table("t", FIELDS)
    table.insert(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(rows, key=repr)


def test_a_compaction_cycle(spark, lake, monkeypatch):
    """Tables worth it are compacted, the others left; one that fails does not stop the rest."""
    compacted_rows(lake, spark)
    lake.create_table("small", [{"name": "id", "type": "int64"}]).insert_rows([{"id": 1}])
    lake.create_table("empty", [{"name": "id", "type": "int64"}])
    bad = compacted_rows_of(lake, "bad")
    lake.store.delete(f"{bad.folder}/{bad.snapshot().files[0].path}")
    got = {r.table: (r.version, r.error) for r in Compactor().cycle(lake).collect()}
    assert got["c"][0] == 5 and got["small"] == got["empty"] == (None, None) and got["bad"][0] is None and got["bad"][1]
    assert len(lake.table("c").snapshot().files) == 1 and lake.table("bad").latest_version() == 4
    outcomes = {(r.operation, r.table): r.outcome for r in lake.metrics.frame(spark).collect()}
    assert outcomes["compact", "c"] == "done" and ("insert", "small") in outcomes


def compacted_rows_of(lake, name):
    table = lake.create_table(name, [{"name": "id", "type": "int64"}])
    for i in range(4):
        table.insert_rows([{"id": i}])
    return table


def test_jobs(spark, lake):
    """A query beside the caller: its rows, an error, cancelling, history."""
    lake.create_table("t", [{"name": "id", "type": "int64"}]).insert_rows([{"id": i} for i in range(5)])
    done = lake.submit("SELECT sum(id) AS s FROM t")
    assert done.result().column("s").to_pylist() == [10] and done.status == "done" and done.rows == 1
    bad = lake.submit("SELECT nothing FROM t")
    assert bad.wait(60) and bad.status == "failed" and "nothing" in bad.error
    with pytest.raises(QueryError):
        bad.result()
    long = lake.jobs.submit(lambda: spark.range(4).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L) AS x", "id"))
    import time

    time.sleep(1)
    assert lake.jobs.get(long.id).status == "running" and lake.jobs.cancel(long.id) and long.wait(30) and long.status == "cancelled"
    assert not lake.jobs.cancel(done.id) and [x[1] for x in lake.jobs.history()] == ["done", "failed", "cancelled"]
    many = lake.jobs.submit(lambda: spark.range(50), limit=10)
    assert many.wait(60) and many.status == "failed" and "more than 10" in many.error
    counted = {(r.operation, r.outcome): r.count for r in lake.metrics.frame(spark).select("operation", "outcome", "count").collect()}
    assert ("query", "done") in counted and ("query", "cancelled") in counted
    with pytest.raises(QueryError):
        lake.jobs.get("none")
