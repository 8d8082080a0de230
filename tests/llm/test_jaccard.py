"""The chosen-path join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.conftest import SF, awkward_rows, prose
from tests.oracle import assert_same

from tarn.llm import entry, jaccard
from tarn.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def expected(rows):
    """(class, links) by row number, from every pair."""
    sets = [None if r[1] is None else shingles(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a is not None and b is not None and (5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    names = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], names[find(i)], links[i]) for i in range(len(rows))]


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df).collect()), key=str)


def edited(text, times, seed):
    words, pick = text.split(), random.Random(seed)
    for _ in range(times):
        words[pick.randrange(len(words))] = f"new{pick.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies, chains, exact copies, a passage that all share, and texts of their own."""
    base, passage = prose(0, 120), prose(99, 12)
    texts = [edited(base, i % 4, i) for i in range(60)]
    texts += [edited(prose(7, 200), 8, i) for i in range(25)]
    texts += [prose(i, 80) + " " + passage for i in range(100, 140)] + [prose(3, 50)] * 7
    texts += ["a b c d e", "a b c d f", "short", "short", "", " "]
    return [(i, t) for i, t in enumerate(texts)]


def test_links_equal_those_of_all_pairs(spark, crowd):
    assert got(spark.createDataFrame(crowd, "doc_id long, text string")) == sorted(expected(crowd), key=str)


def test_large_leaves_are_split_and_compared_in_blocks(spark, crowd, monkeypatch):
    """A leaf of six sets at most: nodes are split further, or compared in blocks where splitting does not help."""
    monkeypatch.setattr(jaccard, "LEAF", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert got(df) == sorted(expected(crowd), key=str)


def test_sets_beyond_the_broadcast(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert got(df) == sorted(expected(crowd), key=str)
    assert jaccard.one_of_each(df).count() == len({c for _, c, _ in expected(crowd)})


def test_recall_at_the_threshold():
    """Pairs of exactly the similarity sought are found in four runs at the stated chance."""
    assert 0.8 < jaccard._meeting(1) < 0.9 and jaccard._meeting(6) > 0.4
    pick, hits = np.random.default_rng(5), 0
    for _ in range(300):
        shared, one, two = (pick.integers(0, 2**64, n, np.uint64) for n in (80, 10, 10))
        a, b = jaccard.minhash(np.concatenate([shared, one])), jaccard.minhash(np.concatenate([shared, two]))
        hits += (a == b).mean()
    assert abs(hits / 300 - 0.8) < 0.01


@pytest.mark.parametrize("depth", [2, 4, 6, 8, 12])
def test_runs_make_up_for_coordinates_that_all_of_them_share(depth):
    """Simulated pairs at the threshold: few equal coordinates are a disadvantage in every run."""
    equal = np.random.default_rng(depth).binomial(jaccard.WIDTH, jaccard.SIMILARITY, 200_000) / jaccard.WIDTH
    q = np.ones(len(equal))
    for _ in range(depth):
        miss = 1 - equal * q
        q = 1 - (0.75 * miss + 0.25 * miss * miss)
    assert ((1 - q) ** jaccard._runs(depth)).mean() <= 2 * (1 - jaccard.RECALL)


def test_blocks_by_shingles(spark, crowd, monkeypatch):
    """Long texts make blocks of few sets."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert got(df) == sorted(expected(crowd), key=str)


def test_rows_to_compare_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Texts close to one of their group are counted, those far from all are not dealt; all links are found."""
    monkeypatch.setattr(jaccard, "LEAF", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    made, tasks = [], jaccard._tasks

    def counted(*args):
        found = tasks(*args)
        made.append((found[0] if isinstance(found, tuple) else found).count())
        return found

    monkeypatch.setattr(jaccard, "_tasks", counted)
    base = prose(5, 200)
    for n in (100, 400):
        texts = [edited(base, 12 if i % 3 == 0 else 4 if i % 50 == 1 else 1 + i % 2, i) for i in range(n)]
        rows = list(enumerate([*texts, *texts[:5]]))
        assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(expected(rows), key=str)
    # Four in proportion, sixteen by the square; more runs add to it.
    assert made[1] <= 10 * made[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_that_overlap(spark, monkeypatch, seed):
    """Families around texts that are near copies themselves, with edits in common, lacking and added words."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    pick, base = random.Random(seed), prose(seed, 120)
    heads = [edited(base, 2 * i, i) for i in range(5)]
    texts = []
    for i in range(160):
        words = edited(pick.choice(heads), pick.choice((0, 1, 1, 2, 3, 6)), pick.randint(0, 60)).split()
        a = pick.randint(0, 25)
        texts.append(" ".join(words[a if i % 4 == 0 else 0 :] + (["more", "of", "it", f"t{i % 3}"] * (i % 5))))
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("depth, pairs", [(6, 5_000), (8, 1_500)])
def test_recall_of_planted_pairs(spark, monkeypatch, depth, pairs):
    """Pairs at the threshold meet in a leaf of the real runs, among sets that have nothing in common with them."""
    from tarn.llm.scratch import Scratch

    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "ALIKE", 2.0)
    monkeypatch.setattr(jaccard, "DEEPEST", depth)
    pick = np.random.default_rng(8)
    one = pick.integers(0, 6, (pairs, jaccard.WIDTH)).astype(np.uint32)
    two = np.where(pick.random(one.shape) < jaccard.SIMILARITY, one, one + np.uint32(100))
    rows = [(2 * i + j, 10, bytearray(v.tobytes())) for i in range(pairs) for j, v in enumerate((one[i], two[i]))]
    leaves = jaccard._leaves(spark.createDataFrame(rows, "rep long, n long, vector binary"), Scratch(spark))
    met = leaves.selectExpr("node", "rep div 2 AS pair").groupBy("node", "pair").count().where("count > 1").select("pair").distinct().count()
    assert pairs - met <= 1


def test_recall_of_the_join_at_the_threshold(spark, monkeypatch):
    """Pairs of texts with a similarity of 0.8 or little more, among texts that share a long passage: all links are found."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "ALIKE", 2.0)
    monkeypatch.setattr(jaccard, "DEEPEST", 9)
    depths, runs = [], jaccard._runs
    monkeypatch.setattr(jaccard, "_runs", lambda depth: depths.append(depth) or runs(depth))
    passage, texts = prose(77, 120), []
    for i in range(300):
        # 116 shingles of the passage, 4 across and 40 own ones, of which 17 differ.
        own = prose(1000 + i, 44)
        words = own.split()
        texts += [f"{passage} {own}", f"{passage} {' '.join([*words[:8], f'w{i}', *words[9:20], f'x{i}', *words[21:33], f'y{i}', *words[34:42], f'z{i}', 'end'])}"]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    close = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 600, 2)]
    assert 0.8 <= min(close) and max(close) < 0.81
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(depths) >= 8 and all(got[i] == (i - i % 2, 1) for i in range(600))


def test_common_counts_by_either_way():
    pick = np.random.default_rng(1)
    sets = [np.unique(pick.integers(0, 60, pick.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    left, right = np.triu_indices(20, 1)
    plain = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert jaccard._common(sets, left, right).tolist() == plain
    assert jaccard._common(sets, left[:5], right[:5]).tolist() == plain[:5]


def test_equals_its_sql(spark):
    assert_same(entry.op2_ngram_jaccard_join, entry.oracle_sql()["op2_ngram_jaccard_join"], spark, SF)


def test_awkward_texts(awkward, clashing, empty):
    rows = awkward_rows()
    for df in (awkward, clashing):
        assert got(df) == sorted(expected(rows), key=str)
        kept = jaccard.one_of_each(df)
        # Nulls all stay; (2, 3) have no words, (6, 6, 7) and (8, 9) are copies.
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "4", "5", "6", "None", "8", "10"])
        assert kept.columns == df.columns
    assert jaccard.classes(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(pick.randint(200, 400), pick.randint(200, 400)) for _ in range(150)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ours = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert ours == {i: find(i) for i in list(root) if find(i) != i}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
