"""Exact top-k inner products in three phases with a uniform threshold.

Components are dealt into groups, each like a node with a list of local scores, and a score is the sum of a row's
entries in all lists. Phase 1 gathers lists of local scores: a row is scored in one group only, and the entries that
head a group's list are totalled; the k-th best total of all is a safe cutoff. Phase 2 broadcasts it and collects the
entries that can still reach it: group by group an entry is scored and leaves play as soon as what it has, plus the
most that its other groups can add (the product of norms), falls short of the cutoff, or as no list can hold it at or
above the uniform threshold, the cutoff divided by the number of groups, which one list must. Phase 3 resolves the
remaining local scores of those that stay, so their totals are exact, and keeps each task's k best.

Queries are taken in blocks of a bounded number, each broadcast in turn; rows are never moved. Products that phases 2
and 3 skip are counted (``spent``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.words import bounded_batches, tidy

#: Queries that are broadcast together, about, and rows that are scored against them at a time.
QUERY_BLOCK, ROW_BLOCK = 8192, 256
#: Share of a block's entries in play up to which they are scored one by one, and how many at a time.
FEW, PAIRS = 0.2, 1 << 16
#: What an integer component is multiplied by before it is rounded down.
SCALE = 1024


def integer_rows(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and floor(1024 * x) of the rows that take part, filled up with zeros to ``width``.

    Values are exact integers in float64; rows with a null id, a null vector or a null or non-finite component are
    left out.
    """
    keep = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    sizes = np.diff(vectors.offsets.to_numpy()) * keep
    flat = vectors.flatten()
    if not keep.all():
        # flatten() skips null lists.
        sizes = np.where(np.asarray(vectors.is_valid()), np.diff(vectors.offsets.to_numpy()), 0)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * values)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) > 0
    out = np.zeros((len(sizes), width))
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = column < width
    out[row[inside], column[inside]] = values[inside]
    keep &= ~bad
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[keep], out[keep]


class _Queries:
    """A block of queries by groups of components, those with the largest part of the queries' energy first."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, groups: int):
        cuts = np.array_split(np.arange(queries.shape[1]), max(1, min(groups, queries.shape[1])))
        self.cuts = sorted(cuts, key=lambda c: -float((queries[:, c] ** 2).sum()))
        self.ids, self.whole = ids, queries
        self.parts = [np.ascontiguousarray(queries[:, c]) for c in self.cuts]
        self.norms, self.rest = self.bounds(queries)
        self.most = float(np.abs(queries).max(initial=0))
        self.order = np.argsort(ids, kind="stable")

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms by group and row, and of all groups from each on; a little above the true ones."""
        squares = np.array([(rows[:, c] ** 2).sum(1) for c in self.cuts])
        return np.sqrt(squares) * (1 + 1e-9), np.sqrt(np.cumsum(squares[::-1], 0)[::-1]) * (1 + 1e-9)

    def small(self, rows: np.ndarray) -> bool:
        """Whether scores and their bounds are exact enough in float64."""
        return float(np.abs(rows).max(initial=0)) * self.most * max(1, rows.shape[1]) < 2**52

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """All scores by Python's integers, whatever their size."""
        one, two = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (rows, self.whole))
        return one.dot(two.T)

    def own(self, row_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (row, query) of queries' own rows."""
        at = np.searchsorted(self.ids, row_ids, sorter=self.order)
        found = self.order[np.minimum(at, len(self.ids) - 1)]
        same = np.nonzero(self.ids[found] == row_ids)[0]
        return same, found[same]

    def pairs(self, rows: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The products of rows i and queries j."""
        out = np.empty(len(i))
        for a in range(0, len(i), PAIRS):
            out[a : a + PAIRS] = np.einsum("ij,ij->i", rows[i[a : a + PAIRS]], columns[j[a : a + PAIRS]])
        return out


def _heads(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k highest entries of each column; of equal ones the first."""
    if len(scores) <= k:
        return np.ones(scores.shape, bool)
    least = np.sort(scores, axis=0)[-k] if scores.dtype == object else np.partition(scores, -k, axis=0)[-k]
    above, level = scores > least, scores == least
    return above | (level & (np.cumsum(level, axis=0) <= k - above.sum(0)))


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k highest, ties to the smaller id."""
    order = sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i])) if score.dtype == object else np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that take part, in blocks ordered by id."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            ids, rows = integer_rows(part.column(0), part.column(1), width)
            order = np.argsort(ids, kind="stable")
            if len(ids):
                yield ids[order], rows[order]


def _long(values: np.ndarray) -> list[int]:
    return [max(-(2**63), min(2**63 - 1, int(v))) for v in values]


def _raised(lists: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The highest entries of each column of both, as many as ``lists`` has rows, ascending."""
    k = len(lists)
    return np.sort(np.partition(np.concatenate([lists, more]), -k, axis=0)[-k:], axis=0)


def _gathered(held: _Queries, batches: Iterator[pa.RecordBatch], k: int, spent: Callable[[int], None]) -> np.ndarray:
    """Phase 1 of a task: each query's highest totals (k rows, ascending) among the entries that head a group's list.

    A list is as long as it takes for all lists to hold twice as many entries as are sought.
    """
    n, width = held.whole.shape
    lists = [np.full((-(-2 * k // len(held.cuts)), n), -np.inf) for _ in held.cuts]
    best = np.full((k, n), -np.inf)
    for row_ids, block in _blocks(batches, width):
        if not held.small(block):
            totals = held.exact(block).astype(float)
            totals[held.own(row_ids)] = -np.inf
            spent(totals.size * width)
            best = _raised(best, totals)
            continue
        group = (row_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(len(held.cuts))
        for g, cut in enumerate(held.cuts):
            at = np.nonzero(group == g)[0]
            if not len(at):
                continue
            local = block[np.ix_(at, cut)] @ held.parts[g].T
            spent(local.size * len(cut))
            local[held.own(row_ids[at])] = -np.inf
            some = np.nonzero(local.max(0) > lists[g][0])[0]
            if not len(some):
                continue
            local, before = local[:, some], lists[g][0, some]
            lists[g][:, some] = _raised(lists[g][:, some], local)
            i, j = np.nonzero((local > before) & (local >= lists[g][0, some]))
            totals = np.full(local.shape, -np.inf)
            totals[i, j] = held.pairs(block[at], held.whole[some], i, j)
            spent(len(i) * (width - len(cut)))
            best[:, some] = _raised(best[:, some], totals)
    return best


def _in_play(held: _Queries, row_ids: np.ndarray, block: np.ndarray, cutoff: np.ndarray, spent: Callable[[int], None]) -> tuple[np.ndarray, np.ndarray]:
    """Phases 2 and 3 for a block of rows: (which entries reach the cutoff, totals, exact for those)."""
    norms, rest = held.bounds(block)
    last, uniform = len(held.cuts) - 1, cutoff / len(held.cuts)
    live = rest[0][:, None] * held.rest[0] >= cutoff
    live[held.own(row_ids)] = False
    # By group: for which queries a later list can still hold an entry at or above the uniform threshold.
    reach = norms.max(1, initial=0)[:, None] * held.norms >= uniform
    later = np.logical_or.accumulate(reach[::-1], 0)[::-1]
    listed = np.zeros(live.shape, bool) if not later.all() else None
    totals = np.zeros(live.shape)
    for g, cut in enumerate(held.cuts):
        many = np.count_nonzero(live)
        if not many:
            break
        if many > FEW * live.size:
            r, q = np.nonzero(live.any(1))[0], np.nonzero(live.any(0))[0]
            local, where = block[np.ix_(r, cut)] @ held.parts[g][q].T, np.ix_(r, q)
        else:
            where = np.nonzero(live)
            local = held.pairs(block[:, cut], held.parts[g], *where)
        spent(local.size * len(cut))
        totals[where] += local
        if listed is not None:
            listed[where] |= local >= (uniform[where[1]] if local.ndim == 1 else uniform[where[1].ravel()])
        if g < last:
            live &= totals >= cutoff - rest[g + 1][:, None] * held.rest[g + 1]
            if listed is not None:
                live &= listed | later[g + 1]
    return live & (totals >= cutoff), totals


def _resolved(held: _Queries, batches: Iterator[pa.RecordBatch], k: int, cutoff: np.ndarray, spent: Callable[[int], None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 of a task: (query, row id, total) of its k best of each query."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found, kept, width = [none], 0, held.whole.shape[1]
    cutoff = cutoff.copy()
    for row_ids, block in _blocks(batches, width):
        if held.small(block):
            live, totals = _in_play(held, row_ids, block, cutoff, spent)
        else:
            totals = held.exact(block)
            live = (totals >= cutoff).astype(bool)
            live[held.own(row_ids)] = False
            spent(live.size * width)
        crowded = np.nonzero(np.count_nonzero(live, 0) > k)[0]
        if len(crowded):
            live[:, crowded] &= _heads(np.where(live[:, crowded], totals[:, crowded], -np.inf), k)
        row, query = np.nonzero(live)
        found.append((query, row_ids[row], totals[row, query]))
        kept += len(row)
        if kept > 4 * k * len(cutoff):
            found = [_best(*map(np.concatenate, zip(*found, strict=True)), k)]
            query, _, score = found[0]
            kept, full = len(query), np.bincount(query, minlength=len(cutoff)) == k
            if score.dtype != object:
                # What a task has found already is a cutoff for its other rows.
                lowest = np.full(len(cutoff), np.inf)
                np.minimum.at(lowest, query, score)
                cutoff[full] = np.maximum(cutoff[full], lowest[full])
    return _best(*map(np.concatenate, zip(*found, strict=True)), k)


def _block_top_k(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, groups: int, spent: Accumulator | None) -> DataFrame:
    """The k best of a block of queries: query_id, vec_id, score, at most k a task and query."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(_Queries(ids, queries, groups))
    add = (lambda n: None) if spent is None else spent.add

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _gathered(held.value, batches, k, add)
        listed = [[float(v) for v in best[:, q] if v > -np.inf] for q in range(best.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(listed))), pa.array(listed, pa.list_(pa.float64()))], names=["query", "totals"])

    lists = rows.mapInArrow(tidy(gather), "query long, totals array<double>").groupBy("query").agg(F.flatten(F.collect_list("totals")).alias("totals"))
    kth = F.element_at(F.sort_array("totals", asc=False), F.lit(k))
    cutoff = np.full(len(ids), -np.inf)
    for r in lists.select("query", F.when(F.size("totals") >= k, kth).alias("cutoff")).collect():
        # Totals beyond 2 ** 53 were rounded: a cutoff a little lower stays safe.
        if r["cutoff"] is not None:
            cutoff[r["query"]] = r["cutoff"] if abs(r["cutoff"]) < 2**53 else r["cutoff"] - abs(r["cutoff"]) * 1e-12
    cutoffs = spark.sparkContext.broadcast(cutoff)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, near, score = _resolved(held.value, batches, k, cutoffs.value, add)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(near), pa.array(_long(score), pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(tidy(resolve), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, groups: int = 8, vec_id: str = "vec_id", vector: str = "embedding", spent: Accumulator | None = None) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``is_query`` holds, candidates all rows with another id. Ties go to the smaller
    id. Rows with a null id, a null vector or a null or non-finite component take no part. A shorter vector counts
    as filled up with zeros. Repeated rows are candidates each on its own; an id that is repeated among the queries
    is asked once, for its smallest vector. A query with fewer than k candidates gets them all; an empty table
    gives no rows. Scores beyond a long are saturated. Other columns are not read, so their names cannot clash.
    ``spent`` counts the products of components that all phases take, as the result is computed.
    """
    bounded_batches(vectors.sparkSession)
    of, values = F.col(f"`{vec_id}`").cast("long"), F.col(f"`{vector}`")
    rows = vectors.select(of.alias("vec_id"), values.alias("embedding"))
    part = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    asked = vectors.where(is_query).select(of.alias("vec_id"), values.alias("embedding")).where(part & F.col("vec_id").isNotNull())
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = []
    for block in range(blocks if n else 0):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if own.num_rows:
            ids, queries = integer_rows(own.column("vec_id").chunk(0), own.column("embedding").chunk(0), width)
            found.append(_block_top_k(rows, ids, queries, k, groups, spent))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
