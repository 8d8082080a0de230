"""Filters, aggregates and the other parts of a structured query, on small fixtures."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarn.errors import FilterError, QueryError, SchemaError
from tarn.operators.predicate import parse
from tarn.operators.query import Query, run, shuffled

PEOPLE = [(1, "Alice", 10.5), (2, "Bob", 20.0), (3, "Charlie", 15.5), (4, "David", 30.0), (5, "Eve", 25.5)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, name string, value double")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls beside empty and zero keys, negatives, zeros, NaN, all types."""
    day, moment = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4)
    rows = [
        (None, 1, None, -5.0, True, 1.5, day, moment),
        ("", 2, 0, -7.0, False, 2.5, None, None),
        ("", None, 3, 0.0, None, None, day, moment),
        (None, 4, None, math.nan, True, 0.5, day, None),
        ("New York", 5, 5, -0.0, False, 1.5, None, moment),
        ("O'Brien", 6, 0, None, None, 1.5, day, moment),
    ]
    return spark.createDataFrame(rows, "s string, i int, l long, d double, b boolean, f float, day date, ts timestamp_ntz")


def ask(df, **arguments):
    return [tuple(r) for r in run(df, Query.of(**arguments)).collect()]


@pytest.mark.parametrize(
    ("text", "n"),
    [("name = 'Alice'", 1), ("id > 3", 2), ("value > 10", 5), ("id >= 2.5", 3), ("name != 'Bob'", 4), ("id<=2", 2), ("name == \"Eve\"", 1), ("value <> 20", 4), ("id < -1", 0), ("name > 'C'", 3)],
)
def test_filters(people, text, n):
    assert len(ask(people, filters=text)) == n


@pytest.mark.parametrize("text", ["invalid filter", "id >", "= 3", "name = Alice", "id ~ 3", ""])
def test_bad_filters(text):
    with pytest.raises(FilterError):
        parse(text)


@pytest.mark.parametrize("text", ["s = 10", "b > true", "b = 1", "i = 'x'", "l < true", "day = 3"])
def test_filters_of_the_wrong_type(odd, text):
    with pytest.raises(FilterError):
        ask(odd, filters=text)


def test_filters_on_every_type(odd):
    n = {t: len(ask(odd, filters=t)) for t in ("s = 'New York'", "s = 'O''Brien'", "i > 2", "l = 0", "d < 0", "d = 0", "b = true", "b != true", "f = 1.5", "day = '2024-01-02'", "ts < '2025-01-01 00:00:00'", "d > 1e300")}
    assert n == {"s = 'New York'": 1, "s = 'O''Brien'": 1, "i > 2": 3, "l = 0": 2, "d < 0": 2, "d = 0": 2, "b = true": 2, "b != true": 2, "f = 1.5": 3, "day = '2024-01-02'": 4, "ts < '2025-01-01 00:00:00'": 4, "d > 1e300": 1}


def test_several_filters_and_an_unprojected_column(people):
    assert ask(people, filters=["id > 1", ("value", "<", 25.0)], projection=["name"]) == [("Bob",), ("Charlie",)]


def test_unknown_columns(people):
    for arguments in ({"filters": "x = 1"}, {"projection": ["x"]}, {"group_by": "x", "aggregates": [("count", "*")]}, {"aggregates": [("sum", "x")]}, {"order_by": "x"}):
        with pytest.raises(SchemaError):
            ask(people, **arguments)


def test_meaningless_queries(people):
    for arguments in ({"group_by": "id"}, {"aggregates": [("sum", "*")]}, {"aggregates": [("median", "id")]}, {"aggregates": [("sum", "name")]}, {"projection": []}, {"limit": -1}):
        with pytest.raises(QueryError):
            ask(people, **arguments)


def test_kernel_grouping(spark):
    rows = [("A", 100, 2), ("B", 200, 1), ("A", 150, 1), ("C", 300, 3), ("B", 250, 2), ("A", 120, 1)]
    df = spark.createDataFrame(rows, "category string, amount long, quantity long")
    got = run(df, Query.of(group_by="category", aggregates=[("sum", "amount", "total_amount"), ("COUNT", "*", "count")], order_by="category"))
    assert got.columns == ["category", "total_amount", "count"]
    assert [tuple(r) for r in got.collect()] == [("A", 370, 3), ("B", 450, 2), ("C", 300, 1)]


def test_nulls_in_groups(odd):
    got = ask(odd, group_by="s", aggregates=[("count", "*"), ("count", "l"), ("min", "l"), ("max", "d")], order_by="s")
    assert [r[:4] for r in got] == [(None, 2, 0, None), ("", 2, 2, 0), ("New York", 1, 1, 5), ("O'Brien", 1, 1, 0)]
    assert math.isnan(got[0][4]) and got[1][4] == 0.0


def test_minimum_and_maximum_of_negatives(spark):
    df = spark.createDataFrame([("a", -5.0), ("a", -7.0), ("b", 0.0), ("b", 3.0)], "k string, v double")
    assert ask(df, group_by="k", aggregates=[("min", "v"), ("max", "v")], order_by="k") == [("a", -7.0, -5.0), ("b", 0.0, 3.0)]


def test_empty_results(people):
    assert ask(people, filters="id > 99") == []
    assert ask(people, filters="id > 99", aggregates=[("count", "*"), ("sum", "id"), ("avg", "value")]) == [(0, None, None)]
    assert ask(people, filters="id > 99", group_by="name", aggregates=[("count", "*")]) == []


def test_order_projection_and_limit(people):
    assert ask(people, order_by=["value desc"], projection=["name"], limit=2) == [("David",), ("Eve",)]
    assert ask(people, limit=3).__len__() == 3
    got = run(people, Query.of(group_by="name", aggregates=[("sum", "value * id", "worth")], projection=["worth", "name"], order_by="worth desc", limit=1))
    assert [tuple(r) for r in got.collect()] == [(127.5, "Eve")]


def test_chaos_rows(spark):
    names = ["Electronics", "Furniture", "Books", "Clothing", "Sports"]
    df = spark.createDataFrame([(i + 1, names[i % 5], float(10 + i % 200)) for i in range(1000)], "id long, category string, value double")
    got = ask(df, filters="value > 50.0", group_by="category", aggregates=[("count", "*"), ("sum", "value", "total"), ("avg", "value"), ("min", "value"), ("max", "value")], order_by="total desc")
    assert got == [
        ("Sports", 160, 21040.0, 131.5, 54.0, 209.0),
        ("Clothing", 160, 20880.0, 130.5, 53.0, 208.0),
        ("Books", 160, 20720.0, 129.5, 52.0, 207.0),
        ("Furniture", 160, 20560.0, 128.5, 51.0, 206.0),
        ("Electronics", 155, 20150.0, 130.0, 55.0, 205.0),
    ]


def test_shuffle(spark, people):
    parts = shuffled(people, 3, ["id"])
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 5
    twice = people.unionAll(people)
    where = shuffled(twice, 3, ["id"]).rdd.mapPartitionsWithIndex(lambda i, rows: [(r.id, i) for r in rows]).collect()
    assert len(where) == 10 and len(set(where)) == 5
    assert shuffled(people, 2).count() == 5
    with pytest.raises(QueryError):
        shuffled(people, 0)


rows = st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from(["A", None]), st.one_of(st.none(), st.integers(1, 100))), max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_grouping_equals_a_plain_model(spark, one, two):
    """Counts and sums equal a model, and batches together equal batches merged."""
    schema = "g string, h string, v long"
    apart = spark.createDataFrame(one, schema).unionAll(spark.createDataFrame(two, schema))
    model: dict = {}
    for g, h, v in one + two:
        n, total = model.get((g, h), (0, None))
        model[g, h] = (n + 1, total if v is None else (total or 0) + v)
    for df in (apart, spark.createDataFrame(one + two, schema)):
        got = ask(df, group_by=["g", "h"], aggregates=[("count", "*"), ("sum", "v")])
        assert {(g, h): (n, s) for g, h, n, s in got} == model
