"""Jaccard self-join of texts' word shingles by chosen paths, and the classes of near duplicates that follow.

Every set of shingles is embedded as a vector of minhash values, so that two sets agree in a coordinate with a
probability that is their similarity. A run starts with all sets in one node. A node samples coordinates, a little
more than one on average (the inverse of the similarity sought), and for each sends its sets to child nodes by
their value there: similar sets keep meeting, others part. A node with few sets is a leaf, in which all pairs are
compared. So is a node that hardly shrinks, as its sets are alike; it is compared in blocks, so that no task gets
more than a bounded number of sets. Large nodes that runs make of one family of sets become one group, in which sets
are described by how they differ from a pivot, the shingles that most of them have: those close enough to it are
linked to one another for certain and are counted, not compared, and a set goes only to blocks in which it can have a
link. Runs are repeated until the chance that a pair just similar enough meets in none of them, at the depth that
leaves were found at, is below the target. All runs sample the same coordinates, so that chance is an average over the
number of them that such a pair has in common.

Sets that are equal are one set from the start, with a number of copies. A pair that meets in several leaves is
compared in the one with the smallest key only, which each side can tell from its list of leaves. One byte of the
first minhash values is enough for that: chance agreement only adds pairs to check. Nodes are split by whole values of
32 bits, so that sets without anything in common do not stay together, however many there are. Pairs are never rows:
a task adds up links per set and links sets that belong together to the smallest one among them. Candidates from
minhash values are checked on whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.scratch import Scratch
from tarn.llm.words import bounded_batches, chunks, distinct_words, tidy

#: Words in a shingle, similarity from which texts are linked.
SHINGLE, SIMILARITY = 5, 0.8
#: Minhash coordinates, and how many of them are compared pair by pair.
WIDTH, COMPARED = 128, 64
#: How many compared ones must agree for a pair to be checked, 5.5 standard deviations below the mean.
LEAST_EQUAL = int(COMPARED * SIMILARITY - 5.5 * (COMPARED * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Sets in a leaf; a node with more than this share of its parent's sets is not split further.
LEAF, ALIKE, DEEPEST = 800, 0.7, 12
#: Sets and shingles in a block, about: what a task holds is bounded by both, so not by a number of sets of any length.
BLOCK, BLOCK_SHINGLES = 400, 1 << 20
#: Bytes of text that are turned into shingles at a time.
HASHED_BYTES = 2 << 20
#: A node of more blocks than this becomes part of a group; rounds in which such nodes are merged.
FEW_BLOCKS, ROUNDS = 2, 3
#: Members that a group's pivot is made of, at most about (fewer if long: it steers work, not results); parts that its
#: members are ordered into, at most.
SAMPLE, PARTS = 100, 64
#: Elements of a task's sets up to which their common ones are counted by matrix products.
DENSE = 2_000_000
#: The chance that a pair with exactly the similarity sought is found; runs of the first batch.
RECALL, FIRST_RUNS = 0.99999, 6
#: Sets whose texts or vectors are fetched by a broadcast of their keys, at most.
MOST_BROADCAST = 1_000_000

_ONE = np.random.default_rng(2)
_FACTORS = _ONE.integers(0, 2**32, WIDTH, np.uint32) | np.uint32(1)
_SHIFTS = _ONE.integers(0, 2**32, WIDTH, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of one to four words is one shingle, one without words none."""
    names, codes, offsets = distinct_words(texts)
    words = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)[codes]
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * step + words[k : k + len(rolled)]
    rolled = _mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for word in words[a:b]:
                one = one * step + word
            yield _mix(one)
        else:
            yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The minhash vector (32-bit numbers) of a set; zeros for the empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF if len(low) else 0, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096, None] * _FACTORS[None, :] + _SHIFTS[None, :]
        np.minimum(out, part.min(0), out=out)
    return out


def _embedded(docs: DataFrame, text: str) -> DataFrame:
    """Per row: its key (row, doc_id, same, size), the number n of its shingles (-1: null text), their hash (a, b), minhash vector (four bytes a value) and the lowest bytes of its first values."""
    body = F.col(f"`{text}`")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(body).alias("same"), F.octet_length(body).alias("size"), body.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", HASHED_BYTES):
                missing = np.asarray(part.column("_text").is_null())
                n, a, b, vectors, sketches = [], [], [], [], []
                for none, own in zip(missing, shingle_sets(part.column("_text")), strict=True):
                    n.append(-1 if none else len(own))
                    a.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(_mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    vector = minhash(own)
                    vectors.append(vector.tobytes())
                    sketches.append(vector[:COMPARED].astype(np.uint8).tobytes())
                out = [part.column(x) for x in ("row", "doc_id", "same", "size")]
                out += [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(vectors, pa.binary()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "same", "size", "n", "a", "b", "vector", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, same long, size int, n long, a long, b long, vector binary, sketch binary")


def _vectors(column: pa.Array, kind: type = np.uint32, width: int = WIDTH) -> np.ndarray:
    """The minhash vectors of a batch, or the lowest bytes of their first values, a row each."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(-1, width)


def _children(nodes: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, child nodes): a second coordinate is sampled at every fourth node, so 1.25 on average."""
    first = _mix(nodes + np.uint64(0xA0761D6478BD642F))
    one = (first % np.uint64(WIDTH)).astype(np.int64)
    more = _mix(first)
    two = (one + 1 + (more % np.uint64(WIDTH - 1)).astype(np.int64)) % WIDTH
    for at, coordinate in ((np.arange(len(nodes)), one), (np.nonzero((more >> np.uint64(40)) % np.uint64(4) == 0)[0], two)):
        c = coordinate[at]
        yield at, _mix(_mix(nodes[at] + (c + 1).astype(np.uint64)) + vectors[at, c].astype(np.uint64))


def _meeting(depth: int, equal: float = SIMILARITY) -> float:
    """The chance that a pair with a share ``equal`` of its coordinates in common is in one leaf of a run at ``depth``."""
    q = 1.0
    for _ in range(depth):
        miss = 1 - equal * q
        q = 1 - (0.75 * miss + 0.25 * miss * miss)
    return q


def _missing(depth: int, runs: int) -> float:
    """The chance that a pair of the similarity sought meets in no leaf, over all numbers of coordinates it may have in common."""
    chances = (comb(WIDTH, k) * SIMILARITY**k * (1 - SIMILARITY) ** (WIDTH - k) for k in range(WIDTH + 1))
    return sum(p * (1 - _meeting(depth, k / WIDTH)) ** runs for k, p in enumerate(chances))


def _runs(depth: int) -> int:
    """How many runs the target recall takes with leaves at ``depth``."""
    runs = 1
    while _missing(depth, runs) > 1 - RECALL:
        runs += 1
    return runs


def _name(turn: int) -> Column:
    """The name of a node (an aggregate), the same for two of them with a probability that is the similarity of what they hold."""
    return F.min(F.xxhash64("rep", F.lit(turn)))


def _split(sets: DataFrame, runs: range, scratch: Scratch) -> tuple[list[DataFrame], int]:
    """Leaves (node, rep, count, total, name) of some runs over ``sets`` (rep, n, vector), and the depth of the deepest.

    count is the number of a leaf's sets, total that of all their elements, name the least hash of a set.
    """

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column("vector"))
            for run in runs:
                start = _mix(np.full(len(vectors), run + 1, np.uint64))
                for at, child in _children(start, vectors):
                    where = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("rep").take(where), batch.column("n").take(where), pa.array(np.full(len(at), 1 << 62))], names=["node", "rep", "n", "was"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy().astype(np.int64).view(np.uint64)
            for at, child in _children(nodes, _vectors(batch.column("vector"))):
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("rep").take(where), batch.column("n").take(where), batch.column("count").take(where)], names=["node", "rep", "n", "was"])

    schema = "node long, rep long, n long, was long"
    size = len(runs) * sets.count()
    rows, leaves, depth = sets.select("rep", "n", "vector").mapInArrow(tidy(roots), schema), [], 1
    while True:
        # Cheap to make again from the sets, so kept by the executors for the time of one job; what goes on is written.
        rows = rows.persist()
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"), _name(0).alias("name")).where("count > 1").persist()
        done = (F.col("count") <= LEAF) | (F.col("count") > ALIKE * F.col("was")) | F.lit(depth >= DEEPEST)
        live = scratch.save(rows.join(counts, "node").select("node", "rep", "n", "count", "total", "name", done.alias("done")), size)
        counts.unpersist()
        rows.unpersist()
        leaves.append(live.where("done").select("node", "rep", "count", "total", "name"))
        large = live.where("not done")
        if large.isEmpty():
            return leaves, depth
        # Few sets go on: only their vectors are moved.
        going = scratch.save(large.select("rep").distinct(), size)
        vectors = sets.select("rep", "vector").join(F.broadcast(going) if going.count() <= MOST_BROADCAST else going, "rep", "left_semi")
        rows = large.join(vectors, "rep").select("node", "rep", "n", "count", "vector").mapInArrow(tidy(deeper), schema)
        depth += 1


def _leaves(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves of as many runs as the target recall takes."""
    found, made, deepest = [], 0, 1
    need = FIRST_RUNS
    while made < need:
        leaves, depth = _split(sets, range(made, need), scratch)
        found += leaves
        made, deepest = need, max(deepest, depth)
        need = max(need, _runs(deepest))
    return reduce(DataFrame.unionAll, found)


def _few(frame: DataFrame) -> DataFrame:
    """A saved table to join with: broadcast if it is small."""
    return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame


def _merged(large: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rep): large leaves (name, rep), of which those that share most of their sets are one, with a negative key, the largest first.

    Leaves with one name are one. What is one after a round is more alike in the next, which has other names.
    """
    large = scratch.save(large.select(F.col("name").alias("node"), "rep").distinct())
    for turn in range(1, ROUNDS):
        names = scratch.save(large.groupBy("node").agg(_name(turn).alias("name")))
        large = scratch.save(large.join(_few(names), "node").select(F.col("name").alias("node"), "rep").distinct())
    key = -1 - F.shiftleft(F.count(F.lit(1)), 31) - F.shiftrightunsigned("node", 33)
    return scratch.save(large.join(_few(scratch.save(large.groupBy("node").agg(key.alias("key")))), "node").select(F.col("key").alias("node"), "rep").distinct())


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, central): the shingles that more than half of a group's sample have."""
    for batch in batches:
        pivots = []
        for sample in batch.column("sample"):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in sample.values]
            names, times = np.unique(np.concatenate(sets), return_counts=True)
            pivots.append(names[2 * times > len(sets)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(pivots, pa.binary())], names=["node", "central"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a group: how many of its pivot's shingles it lacks, how many that one has, and its further ones."""
    for batch in batches:
        lacks, among, more = [], [], []
        for own, pivot in zip(batch.column("shingles"), batch.column("central"), strict=True):
            own, pivot = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(pivot.as_buffer(), np.uint64)
            rest = np.setdiff1d(own, pivot, assume_unique=True)
            lacks.append(len(pivot) - (len(own) - len(rest)))
            among.append(len(pivot))
            more.append(rest.view(np.int64))
        lists = pa.array(more, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), pa.array(lacks, pa.int64()), pa.array(among, pa.int64()), lists], names=["node", "rep", "lacks", "among", "more"])


def _placed(groups: DataFrame, members: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rep, first, copies, core, lacks, shared, excess, side) of ``groups`` (node, rep), from how members differ from a pivot.

    Of a pivot with p shingles let a member lack a and have b more. Then two members are linked if and only if they
    lack or have in common c >= (e + e') / (2 * (5 + 4)), where e = 2 * (5 * a + 4 * b) - (5 - 4) * p is a member's
    ``excess`` (for a similarity of 4 / 5). So members with e <= 0, the ``core``, are all linked to one another; a set
    is in the core of its first group only. c is at most the lesser ``lacks`` and the lesser ``shared``, the number of
    b that some other member has too. Sides, the blocks, follow the excess, so that bounds of whole blocks tell much;
    those of members that have an earlier group come last.
    """
    sizes = groups.join(members.select("rep", "n"), "rep").groupBy("node").agg(F.ceil(F.greatest(F.count(F.lit(1)) / SAMPLE, F.sum("n") / BLOCK_SHINGLES)).alias("each"))
    some = groups.join(_few(scratch.save(sizes)), "node").where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.col("each")) == 0)
    sample = some.join(shingles, "rep").groupBy("node").agg(F.collect_list("shingles").alias("sample"))
    pivots = scratch.save(sample.mapInArrow(tidy(_central), "node long, central binary"))
    held = pivots.agg(F.sum(F.octet_length("central"))).first()[0] or 0
    # A group of few, very long sets may have no sample: then its pivot is empty, for which all below holds too.
    pairs = groups.join(shingles, "rep").join(F.broadcast(pivots) if held <= 8 * MOST_BROADCAST else pivots, "node", "left").withColumn("central", F.coalesce("central", F.lit(b"")))
    apart = scratch.save(pairs.mapInArrow(tidy(_differences), "node long, rep long, lacks long, among long, more array<long>"))
    further = apart.select("node", "rep", F.explode("more").alias("shingle"))
    twice = further.groupBy("node", "shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    shared = further.join(twice, ["node", "shingle"]).groupBy("node", "rep").agg(F.count(F.lit(1)).alias("shared"))
    part = Fraction(str(SIMILARITY))
    excess = 2 * (part.denominator * F.col("lacks") + part.numerator * F.size("more")) - (part.denominator - part.numerator) * F.col("among")
    rows = apart.select("node", "rep", "lacks", excess.alias("excess")).join(shared, ["node", "rep"], "left").na.fill(0, ["shared"])
    first = groups.groupBy("rep").agg(F.min("node").alias("first"))
    rows = rows.join(first, "rep").join(members.select("rep", "copies", "n"), "rep")
    place = F.col("excess") + F.pmod(F.xxhash64("rep"), F.lit(1000)) / 1000 + F.when(F.col("node") == F.col("first"), 0.0).otherwise(1e11)
    rows = scratch.save(rows.select("*", ((F.col("excess") <= 0) & (F.col("node") == F.col("first"))).alias("core"), place.alias("place")))
    cuts = F.percentile_approx("place", [i / PARTS for i in range(1, PARTS)], 10_000).alias("cuts")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    rows = rows.join(_few(scratch.save(rows.groupBy("node").agg(cuts, blocks))), "node")
    above = F.size(F.filter("cuts", lambda x: x < F.col("place")))
    deep = F.ceil(F.col("blocks") / PARTS)
    side = F.floor(above * F.least("blocks", F.lit(PARTS)) / PARTS) * deep + F.pmod(F.xxhash64("rep", "node"), deep)
    return scratch.save(rows.select("node", "rep", "first", "copies", "core", "lacks", "shared", "excess", side.cast("int").alias("side")))


def _sides(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rep, core, side, other): the blocks of its group in which a member can have a link that is to be checked."""
    names = ("core", "lacks", "shared", "excess", "first", "last")
    most = (F.min("core"), F.max("lacks"), F.max("shared"), F.min("excess"), F.min("first"), F.max("first"))
    bounds = placed.groupBy("node", "side").agg(*[x.alias(name) for x, name in zip(most, names, strict=True)])
    bounds = bounds.groupBy("node").agg(F.collect_list(F.struct("side", *names)).alias("others"))
    part = Fraction(str(SIMILARITY))

    def reached(x):
        most = F.least("lacks", x["lacks"]) + F.least("shared", x["shared"])
        # Pairs that have the same earlier group are compared there.
        earlier = (F.col("first") != F.col("node")) & (x["first"] == F.col("first")) & (x["last"] == F.col("first"))
        return ~(F.col("core") & x["core"]) & ~earlier & (2 * (part.denominator + part.numerator) * most >= F.col("excess") + x["excess"])

    rows = placed.join(_few(scratch.save(bounds)), "node")
    return rows.select("node", "rep", "core", "side", F.explode(F.transform(F.filter("others", reached), lambda x: x["side"])).alias("other"))


def _core_links(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, links, root) as ``_verified`` gives, of the links within cores."""
    core = placed.where("core")
    sums = core.groupBy("node").agg(F.sum("copies").alias("all"), F.min("rep").alias("root"))
    return core.join(_few(scratch.save(sums)), "node").select("rep", (F.col("all") - F.col("copies")).alias("links"), "root").where("links > 0")


def _tasks(leaves: DataFrame, sets: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The rows that a task compares, (task, node, side, alone, core, rep, copies, n, sketch, leaves); links that need none; shingles read so far.

    A leaf above the limits is dealt into blocks; each pair of blocks, and each block with itself, is a task. Leaves
    of more than ``FEW_BLOCKS`` become groups, whose keys come before those of leaves.
    """
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    leaves = leaves.select(F.shiftrightunsigned("node", 1).alias("node"), "rep", "name", blocks.alias("blocks"))
    plain, large = leaves.where(F.col("blocks") <= FEW_BLOCKS), leaves.where(F.col("blocks") > FEW_BLOCKS).select("name", "rep")
    rows = plain.withColumn("side", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int"))
    rows = rows.select("node", "rep", F.lit(False).alias("core"), "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    places, sure, shingles = plain.select("node", "rep"), None, None
    if not large.isEmpty():
        groups = _merged(large, scratch)
        members = scratch.save(groups.select("rep").distinct().join(sets, "rep"))
        shingles = scratch.save(_fetched(docs, text, members.select("rep", "doc_id", "same", "size")))
        placed = _placed(groups, members, shingles, scratch)
        rows, places, sure = rows.unionAll(_sides(placed, scratch)), places.unionAll(groups), _core_links(placed, scratch)
    own = places.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    task = F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other"))
    rows = rows.select(task.alias("task"), "node", "side", (F.col("side") == F.col("other")).alias("alone"), "core", "rep")
    return rows.join(own, "rep").join(sets.select("rep", "copies", "n", "sketch"), "rep"), sure, shingles


class _Group:
    """The members of one task, and which of their pairs it has to check."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, side: np.ndarray, core: np.ndarray, alone: bool, node: int, leaves: list[np.ndarray]):
        self.sizes, self.vectors, self.side, self.core, self.alone, self.node, self.leaves = sizes, vectors, side, core, alone, node, leaves

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.sizes)
        if m == 2:
            a, b = sorted(self.sizes.tolist())
            near = a >= SIMILARITY * b and (self.alone or self.side[0] != self.side[1]) and not self.core.all()
            near = near and int((self.vectors[0] == self.vectors[1]).sum()) >= LEAST_EQUAL
            near = near and min(set(self.leaves[0].tolist()) & set(self.leaves[1].tolist())) == self.node
            return (np.array([0]), np.array([1])) if near else (np.zeros(0, int), np.zeros(0, int))
        left, right = [], []
        shared = self._met_before()
        for at in range(0, m, 64):
            own = slice(at, at + 64)
            equal = (self.vectors[own, None, :] == self.vectors[None, :, :]).sum(-1)
            small, large = np.minimum(self.sizes[own, None], self.sizes[None, :]), np.maximum(self.sizes[own, None], self.sizes[None, :])
            near = (equal >= LEAST_EQUAL) & (small >= SIMILARITY * large) & ~shared[own] & (np.arange(m)[None, :] > np.arange(m)[own, None])
            near &= ~(self.core[own, None] & self.core[None, :])
            if not self.alone:
                near &= self.side[own, None] != self.side[None, :]
            i, j = np.nonzero(near)
            left.append(i + at)
            right.append(j)
        return np.concatenate(left), np.concatenate(right)

    def _met_before(self) -> np.ndarray:
        """Pairs that share a leaf with a smaller key."""
        m = len(self.sizes)
        before = [x[: np.searchsorted(x, self.node)] for x in self.leaves]
        of, keys = np.repeat(np.arange(m), [len(x) for x in before]), np.concatenate([*before, np.zeros(0, np.int64)])
        names, number, times = np.unique(keys, return_inverse=True, return_counts=True)
        keep = times[number] > 1
        number = np.unique(number[keep], return_inverse=True)[1]
        met = np.zeros((m, m), np.float32)
        for a in range(0, int(number.max(initial=-1)) + 1, 1024):
            some = (number >= a) & (number < a + 1024)
            table = np.zeros((m, 1024), np.float32)
            table[of[keep][some], number[some] - a] = 1
            met += table @ table.T
        return met > 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole tasks, and where tasks begin in them (one more at the end). Rows come in order of task."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        tasks = batch.column("task").to_numpy()
        starts = np.concatenate([[0], np.nonzero(np.diff(tasks))[0] + 1])
        rest = batch.slice(int(starts[-1]))
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _members(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[int, int, _Group]]:
    sizes, vectors = batch.column("n").to_numpy(), _vectors(batch.column("sketch"), np.uint8, COMPARED)
    side, node = batch.column("side").to_numpy(), batch.column("node").to_numpy()
    alone, core = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("alone", "core"))
    lists = batch.column("leaves")
    at, keys = lists.offsets.to_numpy(), lists.values.to_numpy()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 1:
            leaves = [keys[at[i] : at[i + 1]] for i in range(a, b)]
            yield a, b, _Group(sizes[a:b], vectors[a:b], side[a:b], core[a:b], bool(alone[a]), int(node[a]), leaves)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows that have a pair to check."""
    for batch, starts in _groups(batches):
        keep = np.zeros(batch.num_rows, bool)
        for a, _, group in _members(batch, starts):
            for side in group.pairs():
                keep[a + side] = True
        if keep.any():
            yield batch.filter(pa.array(keep))


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of common elements of each pair of sets."""
    if len(left) <= 4 * len(sets) or sum(map(len, sets)) > DENSE:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[number] > 1
    of, number = of[keep], np.unique(number[keep], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    of, number = of[order], number[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        some = slice(*np.searchsorted(number, (a, a + 2048)))
        table = np.zeros((len(sets), 2048), np.float32)
        table[of[some], number[some] - a] = 1
        total += table @ table.T
    return total[left, right].astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a task: how many documents it is linked to there, and the smallest member it hangs together with."""
    for batch, starts in _groups(batches):
        reps, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
        raw = batch.column("shingles")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b, group in _members(batch, starts):
            left, right = group.pairs()
            if not len(left):
                continue
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(a, b)]
            common = _common(sets, left, right)
            size = group.sizes[left] + group.sizes[right] - common
            near = common >= SIMILARITY * size
            left, right = left[near], right[near]
            links = np.bincount(left, copies[a + right], b - a) + np.bincount(right, copies[a + left], b - a)
            root = np.arange(b - a)[np.argsort(reps[a:b])]
            order = np.empty(b - a, np.int64)
            order[root] = np.arange(b - a)
            # Labels are ranks by rep, lowered along links until nothing changes.
            label = order.copy()
            while True:
                before = label.copy()
                least = np.minimum(label[left], label[right])
                np.minimum.at(label, left, least)
                np.minimum.at(label, right, least)
                label = label[root[label]]
                if (label == before).all():
                    break
            own = np.nonzero(links)[0]
            found.append((reps[a + own], links[own].astype(np.int64), reps[a + root[label[own]]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["rep", "links", "root"])


def _fetched(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of ``wanted`` sets (rep, doc_id, same, size), from the texts of their first documents."""
    body = F.col(f"`{text}`")
    texts = docs.select("doc_id", F.xxhash64(body).alias("same"), F.octet_length(body).alias("size"), body.alias("_text"))
    keys = wanted.select("rep", F.col("doc_id").alias("_id"), F.col("same").alias("_same"), F.col("size").alias("_size"))
    keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys
    texts = texts.join(keys, (F.col("same") == F.col("_same")) & (F.col("size") == F.col("_size")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("rep", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", HASHED_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([x.tobytes() for x in shingle_sets(part.column("_text"))], pa.binary())], names=["rep", "shingles"])

    return texts.mapInArrow(tidy(run), "rep long, shingles binary").dropDuplicates(["rep"])


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: row, doc_id, same, size, class_id, n_links and first.

    Rows are linked if the Jaccard similarity of their texts' sets of five-word shingles is 0.8 or more. class_id is
    the smallest doc_id that chains of links lead to, n_links the number of rows linked directly, ``first`` whether
    the row is the one of its class to keep: that with the smallest doc_id, of equal ones any one.

    Words are runs outside ASCII white space, as they are written. A text of one to four words is one shingle; texts
    without words have equal, empty sets and are linked. A null text is linked to nothing, and its class is its own
    id. Very long texts are read whole; repeated rows are linked like copies; null ids come last; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    base = scratch.save(_embedded(docs, text))
    size = base.count()
    keys = ["a", "b", "n"]
    # Nulls sort first: an id that is missing must not name a class.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    equal = scratch.save(base.where("n >= 0").groupBy(*keys).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), first), size)
    sets = equal.select("rep", "copies").join(base.select(F.col("row").alias("rep"), "n", "vector", "sketch", "doc_id", "same", "size"), "rep")
    sets = scratch.save(sets.where("n > 0"), size)
    rows, sure, known = _tasks(_leaves(sets, scratch), sets, docs, text, scratch)
    order = rows.repartition("task").sortWithinPartitions("task")
    near = scratch.save(order.mapInArrow(tidy(_sketched), order.schema), size)
    wanted = near.select("rep").distinct().join(sets.select("rep", "doc_id", "same", "size"), "rep")
    if known is not None:
        wanted = wanted.join(known.select("rep"), "rep", "left_anti")
    shingles = scratch.save(_fetched(docs, text, scratch.save(wanted, size)), 8 * size)
    if known is not None:
        shingles = shingles.unionAll(known)
    checked = near.join(shingles, "rep").repartition("task").sortWithinPartitions("task")
    linked = scratch.save(checked.mapInArrow(tidy(_verified), "rep long, links long, root long"), size)
    if sure is not None:
        linked = linked.unionAll(sure)
    roots = components(linked.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = equal.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = scratch.save(named.select(*keys, "copies", "least", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), size)
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    named = scratch.save(named.join(heads, "root").select(*keys, "head", (F.col("copies") - 1 + F.col("links")).alias("n_links")), size)
    out = base.drop("vector", "sketch").join(named, keys, "left")
    return out.select(
        "row", "doc_id", "same", "size",
        F.when(F.col("n") < 0, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ((F.col("n") < 0) | (F.col("head.row") == F.col("row"))).alias("first"),
    )


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, unchanged: that with the smallest doc_id.

    Rows are told apart by doc_id and text; of rows alike in both one stays, whichever its other columns are. Rows
    with null texts are in no class and all stay; texts without words are one class; null ids come last; very long
    texts are compared whole; an empty table gives no rows; all columns stay, whatever their names. Hashes of rows to
    drop are broadcast up to ``MOST_BROADCAST``, joined beyond.
    """
    key = ["doc_id", "same", "size"]
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(classes(docs, text))
    body = F.col("_row")[text]
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row")["doc_id"].alias("_id"), F.xxhash64(body).alias("_same"), F.octet_length(body).alias("_size"))

    def match(other: DataFrame):
        return F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_same") == other["same"]) & (F.col("_size") == other["size"])

    def known(frame: DataFrame) -> DataFrame:
        frame = scratch.save(frame)
        return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame

    by_key = found.where("size is not null").groupBy(*key).agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("times"))
    gone = known(by_key.where("not stays").select(*key))
    left = rows.join(gone, match(gone), "left_anti")
    twice = known(by_key.where("stays and times > 1").select(*key))
    if twice.isEmpty():
        return left.select("_row.*")
    once = left.join(twice, match(twice), "left_anti").select("_row")
    repeated = left.join(twice, match(twice), "left_semi").groupBy("_id", "_same", "_size").agg(F.first("_row").alias("_row"))
    return once.unionAll(repeated.select("_row")).select("_row.*")
