"""Shards and mixes: sizes, links, targets, reruns."""

import re
import zlib

import numpy as np
import pytest
from tests.llm.conftest import SF, awkward_rows, prose
from tests.oracle import assert_same

from tarn.llm import entry, mixing, sharding


def shards_of(df, n=4):
    got = sharding.shard(df, n).toPandas()
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert got["shard"].between(0, n - 1).all()
    return got


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, prose(i % 400 if i < 1200 else i, 20 + i % 50)) for i in range(4000)]
    got = shards_of(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    assert sorted(got.doc_id) == list(range(4000))
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples(index=False))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.005 * sizes.mean()
    groups = got[got.doc_id < 1200].groupby(got.doc_id % 400)["shard"].nunique()
    assert (groups == 1).all()


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, prose(0, 40) if i % 3 == 0 else prose(i, 40)) for i in range(3000)]
    got = shards_of(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_all_rows_linked(spark):
    """Nothing is left to even out with, so some groups are dealt out again."""
    rows = [(i, prose(i // 5, 30)) for i in range(2000)]
    got = shards_of(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.05 * sizes.mean()
    assert (got.groupby(got.doc_id // 5)["shard"].nunique() == 1).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_no_group_that_fits_is_torn(spark, folder):
    """The query itself: equal texts share a shard unless they are more than a shard, and shards are even."""
    got = entry.op1_sharding(spark, folder).toPandas()
    assert (got.law == "bytes").all() and set(got["shard"]) == set(range(24))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.001 * sizes.mean() + got["size"].mean() / 4
    groups = got.groupby(["text_crc32", "size"]).agg(n=("doc_id", "size"), shards=("shard", "nunique"), total=("size", "sum"))
    groups = groups[groups.n > 1]
    assert len(groups) > 50 and (groups[groups.total <= sizes.mean()].shards == 1).all()


def test_large_hubs_by_hand():
    """Whole where there is room, the settled ones first; cut only if no shard has the room."""
    whole, cut = sharding._place([(1, 60, 0), (2, 60, 0), (3, 50, None), (4, 40, 2)], 3, 100.0)
    assert whole == {1: 0, 2: 1, 4: 2, 3: 2} and cut == {}
    whole, cut = sharding._place([(i, 60, None) for i in range(4)], 3, 100.0)
    assert sorted(whole.values()) == [0, 1, 2] and list(cut) == [3]
    assert [round(60 * x) for _, x in cut[3]] == [40, 20]


def test_quotas_never_overfill():
    pick = np.random.default_rng(0)
    for _ in range(50):
        load = pick.integers(0, 100, 6).astype(float)
        capacity = max(load.max(), 60.0)
        wanted = pick.integers(0, 80, (6, 6)) * (1 - np.eye(6))
        wanted = np.minimum(wanted, load[:, None] / 6)
        flow = sharding._quotas(wanted, load, capacity)
        assert (flow <= wanted + 1e-9).all() and (load + flow.sum(0) - flow.sum(1) <= capacity * 1.0001).all()


def test_awkward_shards(awkward, clashing, empty):
    for df in (awkward, clashing):
        got = shards_of(df, 3)
        expected = sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
        assert sorted(zip(got["size"], got.text_crc32, strict=True)) == expected
    assert sharding.shard(empty, 3).count() == 0


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_mixing_equals_its_sql(spark, folder):
    assert_same(entry.op9_mixing, entry.oracle_sql()["op9_mixing"], spark, folder)


def test_weights_are_shares_of_good_documents(spark):
    """Classes with labels weigh what their labels say, the others the average; without labels all weigh 1."""
    rows = [(i, "###" * 20 + f" word{i}" if i % 2 else prose(i, 50), "a") for i in range(200)]
    numbers = mixing._numbers(spark.createDataFrame(rows, "doc_id long, text string, source string"), 9, ("doc_id",))
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(100)] + [(0, 0), (None, 1), (2, None)], "doc_id long, quality int")
    found, of = mixing.class_weights(numbers, labels), {r["_row"]["doc_id"]: r["_class"] for r in numbers.collect()}
    average = 49 / 100
    assert found[of[0]] == (49 + 10 * average) / 60 and found[of[1]] == (10 * average) / 60
    assert np.allclose(sorted(set(found) - {found[of[0]], found[of[1]]}), average)
    assert set(mixing.class_weights(numbers, None)) == set(mixing.class_weights(numbers, labels.limit(0))) == {1.0}


def test_rows_without_ids_draw_by_their_texts(spark):
    rows = [(None, prose(i, 20), "a") for i in range(400)]
    got = mixing.decided(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).select("times").toPandas()
    assert 0.4 < got.times.mean() < 0.6


def test_many_sources_are_ranked_side_by_side(spark, monkeypatch):
    rows = [(i, prose(i, 3 + i % 9), f"source {i % 97}" if i % 97 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.decided(df).selectExpr("_row.doc_id", "target", "times").collect()))
    monkeypatch.setattr(mixing, "RANKED", 7)
    assert sorted(map(tuple, mixing.decided(df).selectExpr("_row.doc_id", "target", "times").collect())) == one


def expected_targets(sizes: dict) -> dict:
    """By resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    capped: dict = {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), [None, "b", "a", "é", "Z", "hot", "hot", "hot"][i % 8]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decided(df).selectExpr("_row.doc_id", "_row.source", "size", "source_size", "target", "times").toPandas()
    sizes = got.groupby(got.source.where(got.source.notna(), "(null)"))["size"].sum()
    targets = expected_targets({None if k == "(null)" else k: v for k, v in sizes.items()})
    for source, group in got.groupby(got.source.where(got.source.notna(), "(null)")):
        target = targets[None if source == "(null)" else source]
        assert np.isclose(group.target.iloc[0], target) and group.target.nunique() == 1
        assert (group.source_size == group["size"].sum()).all() and group.times.max() <= 2
        assert abs((group["size"] * group.times).sum() - target) <= group["size"].max() / 2 + 1e-6
        # Complete epochs come before a fractional one.
        assert group.times.max() - group.times.min() <= 1
    again = mixing.decided(df.repartition(7)).selectExpr("_row.doc_id", "times").toPandas()
    assert dict(zip(again.doc_id, again.times, strict=True)) == dict(zip(got.doc_id, got.times, strict=True))
    assert mixing.mix(df).count() == got.times.sum() and mixing.mix(df).columns == df.columns


def test_better_documents_come_first(spark):
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30).replace(" ", " ### "), "a" if i < 1500 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality").where("doc_id < 600")
    got = mixing.decided(df, labels, weights=(1, 1), share=0.5).selectExpr("_row.doc_id", "_row.source", "times").toPandas()
    got = got[got.source == "a"]
    good, poor = (got[got.doc_id % 2 == k].times.mean() for k in (1, 0))
    assert good > 2 * poor


def test_many_sources_are_joined_by_a_shuffle(spark, documents, monkeypatch):
    one = sorted(map(tuple, mixing.decided(documents).selectExpr("_row.doc_id", "times").collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, mixing.decided(documents).selectExpr("_row.doc_id", "times").collect())) == one


def test_awkward_mixes(awkward, clashing, empty):
    for df in (awkward, clashing):
        got = mixing.decided(df).selectExpr("_row.text", "size", "times").collect()
        assert len(got) == len(awkward_rows())
        assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got)
        assert mixing.mix(df).columns == df.columns
    assert mixing.decided(empty).count() == 0 and mixing.mix(empty).count() == 0
