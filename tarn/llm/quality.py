"""Quality rules learned as a decision list, in Spark expressions alone.

Statistics of a text are built-in functions of it. Sequential covering learns from labelled statistics: a rule
grows by the threshold condition with the best information gain until no good document is left in it, then loses
its last conditions as long as that helps on rows kept apart; rows it covers are set aside and the next rule grows.
All counts are Spark aggregations of one row per feature and bin; the outcome is an ordered ``when`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch
from tarn.llm.words import WORD

SPACE = r"[\x20\x09-\x0D]+"
#: What the rules may look at: columns of ``statistics``.
FEATURES = ("symbol_share", "mark_share", "upper_share", "digit_share", "repeat_share", "dup_line_share", "mean_word_chars", "words_per_line", "n_words")
#: Thresholds lie between neighbouring quantiles of either class.
QUANTILES = (0.0, 0.002, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.998, 1.0)


def bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _n_without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(windows: Column) -> Column:
    """Words covered by windows of five whose hash is there twice or more; in n log n for any text."""

    def covered(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        places = F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound(pairs, covered))


def _word_numbers(words: Column) -> Column:
    five = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    places = F.when(F.size(words) >= 5, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        bound(F.transform(places, five), _repeated).alias("n_repeat_words"),
    )


def statistics(text: Column) -> Column:
    """A struct of the numbers that rules use, for a whole text; null counts as empty.

    Words are runs outside ASCII white space; lines are split at newlines and count if they have a word.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    line_numbers = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return F.struct(
        bound(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), _word_numbers).alias("words"),
        bound(lines, line_numbers).alias("lines"),
        _n_without(body, "[#*$%&|<>]+").alias("n_symbols"),
        _n_without(body, "[!?]+").alias("n_marks"),
        _n_without(body, "[0-9]+").alias("n_digits"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The row of ``docs`` as _row and its statistics and features; names within _row cannot clash with them."""
    # Behind a generator, so that the optimiser does not make them again for each use, above all in filters.
    found = docs.select(F.struct("*").alias("_row")).select("_row", F.explode(F.array(statistics(F.col("_row")[text]))).alias("_s"))
    flat = found.select("_row", "_s.words.*", "_s.lines.*", "_s.n_symbols", "_s.n_marks", "_s.n_digits", "_s.n_upper")
    chars, words, lines = (F.greatest(F.col(x), F.lit(1)) for x in ("word_chars", "n_words", "n_lines"))
    return flat.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_marks") / chars).alias("mark_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_words") / lines).alias("words_per_line"),
    )


def base_failed() -> Column:
    """Too short or too repetitive, whatever the rules say."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        """``feature > threshold``, or at most the threshold."""
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _all(rule)
    return out


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered expression: the number of the first rule that rejects, or null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        out = F.when(_all(rule), F.lit(number)).otherwise(out)
    return out


def _thresholds(rows: DataFrame, features: tuple[str, ...]) -> dict[str, list[float]]:
    """Per feature, the middles between neighbouring quantiles of the good and the bad."""
    quantiles = F.lit(list(QUANTILES))
    wanted = [F.percentile_approx(x, quantiles, 10_000).alias(x) for x in features]
    found: dict[str, set[float]] = {x: set() for x in features}
    for r in rows.groupBy("bad").agg(*wanted).collect():
        for x in features:
            found[x] |= set(map(float, r[x] or ()))
    return {x: [(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:], strict=False)] for x, v in found.items()}


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], features: tuple[str, ...], most: int) -> Rule:
    """``rows`` (bins, bad): adds the condition with the best information gain while the rule still holds good rows."""
    rule: Rule = ()
    while len(rule) < most:
        inside = rows.where(_all(rule)).select("bad", F.posexplode("bins").alias("f", "bin"))
        counts = inside.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        by: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
        if not by:
            break
        p_all, n_all = (sum(v[i] for v in by[0].values()) for i in (0, 1))
        if not p_all or not n_all:
            break
        best: tuple = (1e-9,)
        for f, bins in sorted(by.items()):
            p_low = n_low = 0
            for k, threshold in enumerate(thresholds[features[f]]):
                p, n = bins.get(k, (0, 0))
                p_low, n_low = p_low + p, n_low + n
                for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                    if p:
                        gain = p * (log2(p / (p + n)) - log2(p_all / (p_all + n_all)))
                        best = max(best, (gain, -f, -k, Condition(features[f], above, threshold)), key=lambda x: x[:3])
        if len(best) == 1:
            break
        rule = (*rule, best[3])
    return rule


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, most_rules: int = 8, most_conditions: int = 3, min_precision: float = 0.95, min_bad: int = 3) -> list[Rule]:
    """Rules that reject, from rows with the ``features``, bad (0 or 1, not null) and fold (any long).

    Two thirds of the rows (by fold modulo 3) grow rules, the others prune them. A rule counts only if, on the rows
    kept apart and not yet covered, it holds ``min_bad`` bad rows and ``min_precision`` of what it holds is bad.
    Without rows of both classes the list is empty. The driver sees counts by feature and bin alone. ``most_rules``
    and ``most_conditions`` keep the list short enough to be read; they bound the list, not the rows it learns from
    or decides on.
    """
    scratch = Scratch(labelled.sparkSession)
    rows = scratch.save(labelled.select("bad", "fold", *features))
    thresholds = _thresholds(rows, features)
    # Bin k of a feature holds values above k thresholds.
    def bin_of(feature: str) -> Column:
        return F.size(F.filter(F.lit(thresholds[feature] or [float("inf")]), lambda t: t < F.col(feature)))

    bins = F.array(*[bin_of(x) for x in features])
    binned = scratch.save(rows.withColumn("bins", bins))
    apart = F.pmod("fold", F.lit(3)) == 0
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = binned.where(~_any(rules))
        rule = _grow(left.where(~apart), thresholds, features, most_conditions)
        if not rule:
            break
        parts = [rule[: i + 1] for i in range(len(rule))]
        held = [f(F.when(_all(x), c)) for x in parts for f, c in ((F.sum, F.col("bad")), (F.sum, 1 - F.col("bad")))]
        got = [v or 0 for v in left.where(apart).agg(*[c.alias(f"c{i}") for i, c in enumerate(held)]).first()]
        # The shortest form that does best.
        value, size = max(((got[2 * i] - got[2 * i + 1]) / max(1, got[2 * i] + got[2 * i + 1]), -i) for i in range(len(parts)))
        p, n = got[-2 * size], got[-2 * size + 1]
        if p < min_bad or p < min_precision * (p + n):
            break
        rules.append(parts[-size])
    scratch.drop(rows, binned)
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, **parameters) -> list[Rule]:
    """The rules by ``labels`` (doc_id, quality: 0 is bad) for rows with doc_id and statistics.

    Learns from all labelled rows that do not fail the base; null labels are none; of contradictory labels of one
    id the worse counts.
    """
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    return learn(stats.where(~base_failed()).join(told, "doc_id").withColumn("fold", F.xxhash64("doc_id")), **parameters)


def _columns() -> list[str]:
    return list(dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]))


def judged(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, the base numbers, base_failed, kept and rule (which one rejects) of every row of ``docs``.

    Null and empty texts have no word and fail the base; very long texts are read whole; repeated rows fare alike;
    an empty table gives no rows; without labels only the base rejects. Other columns are not read.
    """
    flat = with_statistics(docs).select(F.col("_row")["doc_id"].alias("doc_id"), *_columns())
    stats = Scratch(docs.sparkSession).save(flat)
    rules = learned_rules(stats, labels, **parameters)
    failed, rule = base_failed(), decision(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def accepted(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that neither the base nor a learned rule rejects, unchanged.

    Null and empty texts have no word and go; very long texts are read whole; repeated rows fare alike; an empty
    table gives no rows; without labels only the base rejects. All columns stay, whatever their names. Statistics
    are made once: rows that pass the base are written with them, learned from and then read back.
    """
    flat = with_statistics(docs).where(~base_failed()).select("_row", *_columns())
    rows = Scratch(docs.sparkSession).save(flat)
    rules = learned_rules(rows.select(F.col("_row")["doc_id"].alias("doc_id"), *_columns()), labels, **parameters)
    return rows.where(decision(rules).isNull()).select("_row.*")
