"""Shards of near equal bytes by balanced label propagation.

Documents and links form a hypergraph: a hub stands for documents that belong together, such as equal texts. Linked
documents begin on shards drawn by hash. In each round every hub names the shard where most of its members are,
and members want to move there. What may move from one shard to another is a quota worked out on the driver from
the bytes that want to move (a table of shards by shards by gain), so that no shard outgrows its capacity; larger
gains go first, and what a hub moves from one shard to another goes as one.

Hubs that are whole by then stay as far as their shard has room. The others are placed whole: large ones and large
documents, of which there can be only so many, on the driver, each where there is most room; small ones on a line
that is cut in proportion to the room left. Documents without links are indifferent, so they are dealt out last, to even out the
sizes. A hub is cut only if it is larger than a shard, or than the room that any shard has left.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch

#: How far shards may outgrow their target while labels move; what is above it is dealt out again.
SLACK = 1.05
#: Hubs above this share of a shard are placed on the driver: there are at most so many times the number of shards.
LARGE_SHARE = 64
#: What a part of a hub that is larger than a shard holds at most, as a share of a shard.
PART = 0.9
#: Rows of a table of hubs up to which it is broadcast.
MOST_BROADCAST = 1_000_000
#: Rows that one bucket of the dealing line holds about, and how many buckets there are at most.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 16


def _quotas(wanted: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """The bytes that may move between shards, at most those ``wanted``, with no load above ``capacity`` after it.

    A shard that would overflow has its inflow scaled down, which lessens outflows elsewhere, until all fit.
    """
    flow = wanted.astype(float).copy()
    for _ in range(200):
        after = load + flow.sum(0) - flow.sum(1)
        over = after - capacity
        if (over <= 1e-6 * capacity).all():
            break
        inflow = flow.sum(0)
        scale = np.where((over > 0) & (inflow > 0), np.clip(1 - over / np.maximum(inflow, 1), 0, 1), 1)
        flow *= scale[None, :]
    return flow


def propagate(rows: DataFrame, members: DataFrame, shards: int, capacity: float, rounds: int = 6) -> DataFrame:
    """Labels (row, size, label) for linked ``rows`` (row, size), by their ``members`` (row, hub).

    A row may have several hubs; each adds its number of members on the shard it names to the votes for it. Ties go
    to the label with the larger hash. Which of the rows that want to move from one shard to another do so is drawn by
    hub. Stops when nothing wants to move, or after ``rounds``: then some hubs may still be on several shards.
    """
    scratch = Scratch(rows.sparkSession)
    state = scratch.save(rows.select("row", "size", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("label")))
    label, held = F.col("label"), [state]
    for turn in range(rounds):
        by_hub = members.join(state.select("row", label.alias("label")), "row").groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
        names = by_hub.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "label").alias("tie"), "label")).alias("top"))
        votes = members.join(names, "hub").groupBy("row", F.col("top.label").alias("to")).agg(F.sum("top.n").alias("n"), F.max("top.tie").alias("tie"), F.min("hub").alias("via"))
        best = votes.groupBy("row").agg(F.max(F.struct("n", "tie", "to", "via")).alias("best"))
        wants = state.select("row", "size", label.alias("label")).join(best, "row", "left")
        wants = wants.select("row", "size", "label", F.coalesce("best.to", "label").alias("to"), F.floor(F.log2("best.n")).cast("int").alias("gain"), F.coalesce("best.via", "row").alias("via"))
        state = scratch.save(wants)
        sums = state.groupBy("label", "to", "gain").agg(F.sum("size").alias("bytes")).collect()
        load, wanted, by_gain = np.zeros(shards), np.zeros((shards, shards)), {}
        for r in sums:
            load[r["label"]] += r["bytes"]
            if r["to"] != r["label"]:
                wanted[r["label"], r["to"]] += r["bytes"]
                by_gain.setdefault((r["label"], r["to"]), []).append((-r["gain"], r["bytes"]))
        flow = _quotas(wanted, load, capacity)
        # Moves from one shard to another: all with a gain above the least, of those with the least a share.
        least, part = [99] * shards**2, [0.0] * shards**2
        for (a, b), gains in by_gain.items():
            left = flow[a, b]
            for gain, size in sorted(gains):
                least[a * shards + b], part[a * shards + b] = -gain, min(1.0, left / size)
                left -= size
                if left <= 0:
                    break
        pair = (F.col("label") * shards + F.col("to") + 1).cast("int")
        luck = F.pmod(F.xxhash64("via", F.lit(turn + 2)), F.lit(1 << 30)) / float(1 << 30)
        limit = F.element_at(F.lit(least), pair)
        moves = (F.col("to") != F.col("label")) & ((F.col("gain") > limit) | ((F.col("gain") == limit) & (luck < F.element_at(F.lit(part), pair))))
        label = F.when(moves, F.col("to")).otherwise(F.col("label"))
        held.append(state)
        if not by_gain:
            break
    out = scratch.save(state.select("row", "size", label.alias("label")))
    scratch.drop(*held)
    return out


def _bucket(row: Column, buckets: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, room: np.ndarray, buckets: int) -> DataFrame:
    """Labels ``rows`` (row, size, _key, _bucket): laid on a line, bucket after bucket, and cut in proportion to ``room``.

    Rows of one key lie side by side.
    """
    sums = {r["_bucket"]: r["bytes"] for r in rows.groupBy("_bucket").agg(F.sum("size").alias("bytes")).collect()}
    own = np.array([sums.get(b, 0) for b in range(buckets)], np.int64)
    before = (np.cumsum(own) - own).tolist()
    cuts = (np.cumsum(room)[:-1] / max(room.sum(), 1e-9) * own.sum()).tolist()
    inside = Window.partitionBy("_bucket").orderBy("_key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.element_at(F.lit(before), F.col("_bucket") + 1) + F.sum("size").over(inside) - F.col("size") / 2
    # The number of cuts at or before the middle, found by halving.
    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        at = (lo + hi) // 2
        return F.when(F.col("_middle") < cuts[at], cut(lo, at)).otherwise(cut(at + 1, hi))

    return rows.select("*", middle.alias("_middle")).withColumn("label", cut(0, len(cuts))).drop("_middle")


def _place(large: list[tuple[int, int, int | None]], shards: int, target: float) -> tuple[dict[int, int], dict[int, list[tuple[int, float]]]]:
    """Where large hubs (hub, bytes, shard that it is whole on, or None) go: whole, or cut as (shard, share) where none has room.

    A hub stays on its shard while that has room, the largest first; the others go, largest first, where most room is.
    """
    room, whole, cut, left = np.full(shards, float(target)), {}, {}, []
    for hub, size, label in sorted(large, key=lambda x: (-x[1], x[0])):
        if label is not None and size <= room[label]:
            whole[hub] = label
            room[label] -= size
        else:
            left.append((hub, size))
    # The shard with most room first; of equal ones the first.
    heap = [(-float(x), at) for at, x in enumerate(room)]
    heapify(heap)
    for hub, size in left:
        most, at = heap[0]
        if size <= -most:
            whole[hub] = at
            heapreplace(heap, (most + size, at))
            continue
        cut[hub], rest = [], float(size)
        while rest > 0:
            most, at = heap[0]
            # Where there is not a byte of room, by what hashes leave uneven, the rest goes to one shard.
            some = min(rest, -most) if most < -1 else rest
            cut[hub].append((at, some / size))
            heapreplace(heap, (most + some, at))
            rest -= some
    return whole, cut


def _loads(table: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for r in table.groupBy("label").agg(F.sum("size").alias("bytes")).collect():
        out[r["label"]] = r["bytes"]
    return out


def _luck(column: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _labelled_hubs(linked: DataFrame, labels: DataFrame, alone: DataFrame, shards: int, target: float, buckets: int, scratch: Scratch) -> tuple[DataFrame, dict[int, list[tuple[int, float]]]]:
    """One shard for each hub (hub, label) of ``linked`` (row, size, hub), by its rows' ``labels``; and the hubs to cut.

    Large documents ``alone`` (size, hub) are placed with the large hubs.
    """
    spark = linked.sparkSession
    held = labels.join(linked.select("row", "hub"), "row").groupBy("hub").agg(F.sum("size").alias("size"), F.min("label").alias("label"), F.max("label").alias("other"))
    held = held.select("hub", "size", F.when(F.col("label") == F.col("other"), F.col("label")).alias("label"))
    hubs = scratch.save(held.unionAll(alone.select("hub", "size", F.lit(None).cast("int").alias("label"))))
    is_large = F.col("size") * LARGE_SHARE > target
    large = [(r["hub"], r["size"], r["label"]) for r in hubs.where(is_large).collect()]
    whole, cut = _place(large, shards, target)
    sizes = {hub: size for hub, size, _ in large}
    load = np.zeros(shards)
    for hub, at in whole.items():
        load[at] += sizes[hub]
    for hub, parts in cut.items():
        for at, share in parts:
            load[at] += share * sizes[hub]
    small = hubs.where(~is_large)
    own = _loads(small.where("label is not null"), shards)
    stay = np.clip((target - load) / np.maximum(own, 1), 0, 1).tolist()
    settled = scratch.save(small.where(_luck("hub", 3) < F.element_at(F.lit(stay), F.col("label") + 1)))
    load += _loads(settled, shards)
    free = small.join(settled.select("hub"), "hub", "left_anti").select(F.col("hub").alias("row"), "size", F.col("hub").alias("_key"), _bucket(F.col("hub"), buckets).alias("_bucket"))
    dealt = _dealt(scratch.save(free), np.maximum(target - load, 0) + 1e-6, buckets)
    placed = spark.createDataFrame(list(whole.items()), "hub long, label int")
    return scratch.save(placed.unionAll(settled.select("hub", "label")).unionAll(dealt.select(F.col("row").alias("hub"), "label"))), cut


def shard(docs: DataFrame, shards: int = 24, text: str = "text", rounds: int = 6) -> DataFrame:
    """All rows of ``docs``: doc_id, size, text_crc32, shard, slot; linked by equal texts, equal in bytes.

    size is the UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard; only a group larger than a
    shard, or than the room that large groups leave on any shard, is cut, into few parts. Null texts are not linked.
    slot counts a shard's rows from 0 without gaps. Repeated rows, null ids and ties are placed each on their own;
    very long texts count whole; an empty table gives no rows; other columns are not read. The sizes of shards differ
    by no more than about a small document if there are enough documents without copies. ``rounds`` bounds the
    propagation: what is not whole by then is placed whole afterwards.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.col(f"`{text}`")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.when(body.isNotNull(), F.xxhash64(body)).alias("same"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = scratch.save(base)
    n, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = int(min(MOST_BUCKETS, max(64, n // BUCKET_ROWS)))
    target = total / shards
    groups = base.where("same is not null").groupBy("same", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = F.col("n") * F.col("size")
    parts = F.when(held > target, F.ceil(held / max(PART * target, 1))).otherwise(F.lit(1))
    groups = scratch.save(groups.select("same", "size", parts.alias("parts")))
    part = F.pmod(F.xxhash64("row", F.lit(1 << 20)), F.col("parts"))
    linked = scratch.save(base.join(groups, ["same", "size"]).select("row", "size", F.xxhash64("same", "size", part).alias("hub")))
    single = scratch.save(base.where(F.col("size") * LARGE_SHARE > target).join(linked.select("row"), "row", "left_anti").select("row", "size", F.xxhash64("row").alias("hub")))
    labels = propagate(linked.select("row", "size"), linked.select("row", "hub"), shards, SLACK * target, rounds)
    hubs, cut = _labelled_hubs(linked, labels, single, shards, target, buckets, scratch)
    hubs = F.broadcast(hubs) if hubs.count() <= MOST_BROADCAST else hubs
    units = linked.unionAll(single)
    done = [units.join(hubs, "hub").select("row", "size", "label")]
    for hub, shares in cut.items():
        # Its rows by hash, in proportion to the shares.
        label, ends = F.lit(shares[-1][0]), np.cumsum([x for _, x in shares])
        for (at, _), end in reversed(list(zip(shares[:-1], ends[:-1].tolist(), strict=True))):
            label = F.when(_luck("row", 7) < end, F.lit(at)).otherwise(label)
        done.append(units.where(F.col("hub") == hub).select("row", "size", label.cast("int").alias("label")))
    kept = scratch.save(reduce(DataFrame.unionAll, done))
    free = base.join(kept.select("row"), "row", "left_anti").select("row", "size", F.xxhash64("row").alias("_key"))
    free = scratch.save(free.withColumn("_bucket", _bucket(F.col("_key"), buckets)))
    done, mean, load = [kept.select("row", "label")], total / max(n, 1), _loads(kept, shards)
    # The largest first; each tier evens out what the one before left.
    for above, upto in ((2 * mean, float("inf")), (mean / 4, 2 * mean), (mean / 12, mean / 4), (0, mean / 12)):
        tier = _dealt(free.where((F.col("size") > above) & (F.col("size") <= upto)), np.maximum(target - load, 0) + 1e-6, buckets)
        tier = scratch.save(tier.select("row", "size", "label"))
        load += _loads(tier, shards)
        done.append(tier.select("row", "label"))
    placed = base.drop("same").join(reduce(DataFrame.unionAll, done), "row")
    # Not the buckets of the line, in each of which few shards have all rows.
    placed = placed.select("*", _bucket(F.col("row"), buckets, 5).alias("_bucket"))
    counts = scratch.save(placed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = counts.select("label", "_bucket", (F.sum("_n").over(Window.partitionBy("label").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket", "label").orderBy("row"))
    # shards x buckets rows at most.
    out = placed.select("*", rank.alias("_rank")).join(F.broadcast(before), ["label", "_bucket"])
    return out.select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), (F.col("_before") + F.col("_rank") - 1).alias("slot"))
