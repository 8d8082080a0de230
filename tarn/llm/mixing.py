"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, in Spark expressions alone.

Each document draws an exponential key, -ln(u) / weight, from a hash of its id; ascending keys are a sample without
replacement whose odds follow the weights. A document's weight is its quality: the share of good ones among labelled
documents like it. A source first gives all its documents as often as its target holds complete epochs; for the rest
of the target its documents are taken in key order until their sizes reach it.

Texts are read once; all else goes by the numbers taken from them. No task sorts a source. Keys fall into buckets of
equal width in ln(key), of which none holds more than about a thousandth of a source; sums by bucket show the one
bucket in which a source's budget ends, and only that bucket's rows are put in order. What comes out is one row per
source with the last document taken, against which rows are decided one by one, with no join on anything but the
table of sources. Sources, however many, are ranked by ranges of their names, and their common level is found by a
few sums over all of them.
"""

from __future__ import annotations

from math import inf

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch
from tarn.llm.words import WORD

#: Buckets of keys for a factor e between keys.
FINENESS = 512
#: Sources up to which their table is broadcast; with more of them it is joined by a shuffle.
MOST_BROADCAST = 10_000
#: Sources that one task ranks, about.
RANKED = 50_000
#: Where documents are told apart for their quality: shares of symbol characters and numbers of words.
SYMBOL_CUTS, WORD_CUTS = (0.0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32), (10, 30, 100, 300, 1000)
#: Labelled documents of the average quality that count towards each class, and the least weight.
PRIOR, LEAST = 10.0, 0.05


def n_words(text: Column) -> Column:
    """Words of a text (long), 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_share(text: Column) -> Column:
    """The share of a text's characters that are among ``#*$%&|<>!``; 0 for null or empty."""
    left = F.length(F.regexp_replace(text, "[#*$%&|<>!]+", ""))
    return F.coalesce((F.length(text) - left) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def _class(share: Column, size: Column) -> Column:
    """The class of a document, from 0: by how many cuts its share of symbols and its number of words are above."""
    above = lambda cuts, x: F.size(F.filter(F.lit(list(cuts)), lambda cut: cut < x))
    return above(SYMBOL_CUTS, share) * (len(WORD_CUTS) + 1) + above(WORD_CUTS, size)


def _numbers(docs: DataFrame, seed: int, keep: tuple[str, ...] | None) -> DataFrame:
    """What the sample needs of each row, and the row, or its columns ``keep``, as _row; the names within cannot clash."""
    row, text = F.col("_all"), F.col("_all")["text"]
    # A row without an id draws by its text.
    key = F.coalesce(row["doc_id"].cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    found = docs.select(F.struct("*").alias("_all")).select(
        (row if keep is None else F.struct(*[row[x].alias(x) for x in keep])).alias("_row"),
        row["doc_id"].alias("_id"),
        F.coalesce(F.concat(F.lit("s"), row["source"].cast("string")), F.lit("n")).alias("_source"),
        n_words(text).alias("_size"),
        symbol_share(text).alias("_share"),
        u.alias("_u"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    return found.select("_row", "_id", "_source", "_size", "_u", "_crc", _class(F.col("_share"), F.col("_size")).alias("_class"))


def class_weights(numbers: DataFrame, labels: DataFrame | None) -> list[float]:
    """A weight for each class of documents: its share of good ones by ``labels`` (doc_id, quality), drawn to the average.

    Null labels are none; of contradictory labels of one id the worse counts. Without labels all weigh 1.
    """
    weights = [1.0] * ((len(SYMBOL_CUTS) + 1) * (len(WORD_CUTS) + 1))
    if labels is None:
        return weights
    told = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    counts = numbers.join(told, "_id").groupBy("_class").agg(F.sum("_good").alias("good"), F.count(F.lit(1)).alias("n"))
    found = {r["_class"]: (r["good"], r["n"]) for r in counts.collect()}
    if not found:
        return weights
    average = float(sum(g for g, _ in found.values())) / float(sum(n for _, n in found.values()))
    good = [found.get(i, (0, 0)) for i in range(len(weights))]
    return [max(LEAST, (g + PRIOR * average) / (n + PRIOR)) for g, n in good]


def _drawn(numbers: DataFrame, weights: list[float]) -> DataFrame:
    key = -F.ln("_u") / F.element_at(F.lit(weights), F.col("_class") + 1)
    out = numbers.withColumns({"_key": key, "_tie": F.struct(F.col("_id").alias("id"), F.col("_crc").alias("crc"))})
    return out.withColumn("_bucket", F.floor(F.ln("_key") * FINENESS).cast("int"))


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with _rank, from 0, by name, null last: ranges of names are ranked side by side."""
    parts = max(1, -(-sources.count() // RANKED))
    # Null sources are 'n', which code points put before every 's...': they go last.
    order = [F.col("_source") == "n", F.col("_source")]
    dealt = scratch.save(sources.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([counts.get(x, 0) for x in range(max(counts, default=0) + 1)])
    before = F.element_at(F.lit((np.cumsum(held) - held).tolist()), F.col("_part") + 1)
    return dealt.select("*", (before + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).alias("_rank")).drop("_part")


def _level(sources: DataFrame, share: float) -> float:
    """What each unit of weight gets of ``share`` of all sizes, where none gets more than its cap and the excess is reshared.

    It only rises as sources reach their caps, so sums over all sources are taken until no more of them do.
    """
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        total, capped, free = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not free:
            return inf
        after = (float(total) * share - float(capped or 0)) / float(free)
        if after <= level:
            return level
        level = after


def source_plan(drawn: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: source_size, target, epochs and where its fractional selection ends (_end, _last)."""
    scratch = Scratch(drawn.sparkSession)
    rows = drawn.select("_source", "_size", "_key", "_tie", "_bucket")
    by_bucket = scratch.save(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")))
    sources = _ranked(by_bucket.groupBy("_source").agg(F.sum("_sum").alias("source_size")), scratch)
    weight = F.element_at(F.lit(list(weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    sources = scratch.save(sources.select("_source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(most)).alias("_cap")))
    target = F.least("_cap", F.lit(_level(sources, share)) * F.col("_weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select("_source", "source_size", target.alias("target"), epochs.alias("epochs"))
    sources = sources.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy("_source").orderBy("_bucket")
    through = by_bucket.select("*", F.sum("_sum").over(inside).alias("_through"))
    ends = through.join(sources, "_source").where((F.col("_through") - F.col("_sum") <= F.col("_rest")) & (F.col("_rest") < F.col("_through")))
    ends = scratch.save(ends.select("_source", F.col("_bucket").alias("_end"), (F.col("_through") - F.col("_sum")).alias("_before"), "_rest"))
    at_end = small_join(rows, ends, "_source", "inner").where(F.col("_bucket") == F.col("_end"))
    order = Window.partitionBy("_source").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    last = at_end.select("*", place.alias("_place")).where(2 * F.col("_place") + F.col("_size") <= 2 * F.col("_rest"))
    last = last.groupBy("_source").agg(F.max(F.struct("_key", "_tie")).alias("_last"))
    ends = sources.join(ends.select("_source", "_end"), "_source", "left").join(last, "_source", "left").drop("_rest")
    # A source whose budget ends beyond its last document gives everything once more.
    return scratch.save(ends.withColumn("_all", F.col("_end").isNull() & (F.col("target") > F.col("epochs") * F.col("source_size"))))


def small_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Joins a written table, broadcast if it is counted to be small."""
    return left.join(F.broadcast(right) if right.count() <= MOST_BROADCAST else right, key, how)


def decided(
    docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Each row of ``docs`` as _row, with its size, source_size, target and times (how often the mix takes it).

    ``docs`` has doc_id, text and source, ``labels`` doc_id and quality (1 is good); without labels all documents
    weigh alike. Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes;
    none gets more than ``most`` times its size, the excess going to the others by weight. The size of a document is
    its words: 0 for a null or empty text, whose times follow its key all the same. Very long texts count whole.
    Taken sizes end within half a document of the target; rows alike in doc_id, text and source fare alike. A row
    without an id draws by its text. Further columns of any name stay in _row, or those in ``keep``. An empty table
    gives no rows.
    """
    numbers = Scratch(docs.sparkSession).save(_numbers(docs, seed, keep))
    drawn = _drawn(numbers, class_weights(numbers, labels))
    plan = source_plan(drawn, weights, share, most)
    rows = small_join(drawn, plan, "_source", "inner")
    first = (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & (F.struct("_key", "_tie") <= F.col("_last")))
    more = F.coalesce(F.col("_all") | first, F.lit(False)).cast("long")
    return rows.select("_row", F.col("_size").alias("size"), "source_size", "target", (F.col("epochs") + more).alias("times"))


def mix(docs: DataFrame, labels: DataFrame | None = None, **parameters) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``decided`` says, with all their columns.

    Nulls, empty and very long texts, ties, repeated rows and clashing names are as there; an empty table gives no rows.
    """
    rows = decided(docs, labels, **parameters).where("times > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).select("_row.*")
