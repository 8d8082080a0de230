"""Every query of the core against its SQL on the driver's tables."""

import os
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarn import queries, table_queries  # noqa: F401  the latter registers its queries
from tarn.sources.files import WriterOptions
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name], queries.ORACLES[name], spark, FOLDER)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.filter_gt_f64(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_extendedprice,50000.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_grouping_combines_before_the_shuffle(spark):
    plan = queries.agg_filtered(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and "partial_" in plan


def test_layouts_of_more_than_a_row_group(spark, monkeypatch):
    """Files share the rows of a table that is larger than a row group, and the driver gets no file's bytes."""
    monkeypatch.setattr(table_queries, "WriterOptions", partial(WriterOptions, row_group_bytes=32 << 10))
    kind, rows = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [rows.append(x) or x for x in collect(self)])
    assert_same(queries.QUERIES["write_layouts"], queries.ORACLES["write_layouts"], spark, FOLDER)
    assert rows and not any(isinstance(x, bytes | bytearray) for r in rows for x in r)


@pytest.fixture(scope="module")
def wide_orders(tmp_path_factory):
    """Orders of 44 MB that hardly compress: four files of them are not small."""
    where, n = tmp_path_factory.mktemp("wide"), 1100
    texts = [os.urandom(20_000).hex() for _ in range(n)]
    pq.write_table(pa.table({"o_orderkey": range(n), "o_orderstatus": ["FOP"[i % 3] for i in range(n)], "o_orderpriority": texts}), where / "orders.parquet")
    return str(where)


def test_compaction_of_orders_whose_quarters_are_large(spark, wide_orders):
    assert_same(queries.QUERIES["compact_preserves"], queries.ORACLES["compact_preserves"], spark, wide_orders)


def test_metrics_of_orders_whose_quarters_are_large(spark, wide_orders):
    assert_same(queries.QUERIES["compaction_metrics"], queries.ORACLES["compaction_metrics"], spark, wide_orders)
