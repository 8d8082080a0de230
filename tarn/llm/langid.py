"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 4-grams of each lower-case word with a space on either side, hashed to a fixed number of
buckets and weighted by term frequency and inverse document frequency. The regression is trained by
follow-the-regularised-leader with per-coordinate rates and an elastic-net penalty, then its logits are divided by
a temperature that minimises the loss on documents kept apart for that.

As features are divided by their number in the text, logits are sums over words: each distinct word of a batch is
scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import widened
from tarn.llm.words import bounded_batches, chunks, distinct_words, sums, tidy

#: Buckets that n-grams are hashed to, as a power of two, and the longest n-gram.
BITS, LONGEST = 15, 4
#: What term frequencies are multiplied by, so that a text's features are of the order of 1.
GAIN = 20.0
#: Labelled documents to fit to, about, over all languages; every fifth of them sets the temperature.
SAMPLE = 2000
#: Predicted where there is nothing to go by.
UNKNOWN = "und"


#: Characters of distinct words whose n-grams are in memory at a time; a longer word is taken alone.
TOGETHER = 200_000


def _word_slices(names: list[str]) -> Iterator[list[str]]:
    sizes = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
    at = 0
    while at < len(names):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
        yield names[at:upto]
        at = upto


def word_grams(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram buckets of words, one after another, where each word's begin (one more at the end), and which words have a letter."""
    lower = [f" {x.lower()} " for x in names]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    word = np.repeat(np.arange(len(lower), dtype=np.int32), sizes)
    kinds, at = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds], bool)[at] if len(kinds) else np.zeros(0, bool)
    has_letter = np.bincount(word[letter], minlength=len(lower)) > 0
    ends, found, owner = np.cumsum(sizes)[word], [], []
    rolled = np.zeros(len(points), np.uint64)
    place = np.arange(len(points))
    for n in range(1, LONGEST + 1):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        fits = place[: len(rolled)] + n <= ends[: len(rolled)]
        if n == 1:
            fits &= points != 32
        mixed = (rolled[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        found.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.uint16))
        owner.append(word[: len(rolled)][fits])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lower)))]), has_letter


def _all_word_grams(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_grams`` of many words, a slice of them at a time."""
    parts = [word_grams(x) for x in _word_slices(names)] or [word_grams([])]
    sizes = np.concatenate([np.diff(first) for _, first, _ in parts])
    return np.concatenate([x for x, _, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x for _, _, x in parts])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _text_grams(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text with a letter: its place, its buckets and how often each occurs."""
    names, codes, offsets = distinct_words(part.column("_text"))
    grams, first, has_letter = _all_word_grams(names)
    for i in range(part.num_rows):
        own, many = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
        if has_letter[own].any():
            sizes = first[own + 1] - first[own]
            counts = np.bincount(grams[_ranges(first[own], sizes)], np.repeat(many, sizes), minlength=1 << BITS)
            used = np.nonzero(counts)[0]
            yield i, used, counts[used]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``texts`` (_text) each bucket occurs, and how many texts have a letter; all of them are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in chunks(batch, "_text"):
                for _, used, _ in _text_grams(part):
                    seen[used] += 1
                    n += 1
        used = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], n))], names=["bucket", "n"])

    out, n = np.zeros(1 << BITS, np.int64), 0
    for r in texts.mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


@dataclass
class Model:
    """weights: by bucket and language, with GAIN and inverse document frequencies already in."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_regression(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Weights by feature and class (the last feature is the bias) from (features, values, class), by FTRL-proximal."""
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return -np.sign(own) * np.maximum(np.abs(own) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(10)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            w = weights(at)
            g = x[:, None] * (_softmax(x @ w) - (np.arange(classes) == label))
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(np.arange(width + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, on a grid of factors of 1.1."""
    if not len(labels):
        return 1.0
    grid = 1.1 ** np.arange(-30, 31)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the rows of ``labelled`` whose text and language are not null.

    Document frequencies are those of all rows. Weights are fitted to about ``sample`` rows, drawn by a hash of the
    text, as many distinct texts of each language, or all of a language that has fewer; whole texts each. The draw is
    the same in every run. Without any row the model has no language.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang")).where("_text is not null and _lang is not null")
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count_distinct(F.xxhash64("_text")).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    seen, n = document_frequencies(rows.select("_text"))
    each = max(1, sample // len(langs))
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, each / counts[k]))]), F.col("_lang"))
    luck = F.pmod(F.xxhash64("_text"), F.lit(1 << 30))
    # Equal texts are drawn together: the limit holds if one text makes up a large part of a language.
    drawn = rows.where(luck < share * (1 << 30)).select("_text", "_lang", luck.alias("_luck")).dropDuplicates(["_luck"]).orderBy("_luck").limit(2 * sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                got = list(_text_grams(part))
                of = pa.array([i for i, _, _ in got], pa.int32())
                lists = [pa.array([v[j].astype(np.int32) for v in got], pa.list_(pa.int32())) for j in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column("_lang").take(of), part.column("_luck").take(of), *lists], names=["lang", "luck", "at", "n"])

    got = drawn.mapInArrow(tidy(features), "lang string, luck long, at array<int>, n array<int>").toArrow()
    order = np.argsort(got.column("luck").to_numpy(), kind="stable")
    idf = np.log((1 + n) / (1 + seen)) + 1
    number = {x: i for i, x in enumerate(langs)}
    label = [number[x] for x in got.column("lang").to_pylist()]
    at, many = got.column("at").combine_chunks(), got.column("n").combine_chunks()
    train, apart = [], []
    for turn, i in enumerate(order):
        own, c = at[int(i)].values.to_numpy(), many[int(i)].values.to_numpy()
        (apart if turn % 5 == 4 else train).append((own, GAIN * c / c.sum() * idf[own], label[i]))
    w = fit_regression(train, 1 << BITS, len(langs))
    logits = np.array([x @ w[own] + w[-1] for own, x, _ in apart]).reshape(-1, len(langs))
    t = _temperature(logits, np.array([y for _, _, y in apart], int))
    return Model(langs, (GAIN * idf[:, None] * w[:-1]).astype(np.float32), w[-1], t)


def _score_words(model: Model, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: the sum of its n-grams' weights by language, their number, and whether it has a letter."""
    parts = []
    for some in _word_slices(names):
        grams, first, has_letter = word_grams(some)
        parts.append((sums(model.weights[grams].astype(np.float64), first), np.diff(first), has_letter))
    if not parts:
        return np.zeros((0, len(model.langs))), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def predict(docs: DataFrame, model: Model, keep: tuple[Column, ...], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score (the calibrated probability) of each row's whole text. No shuffle.

    A null text, or one without a letter, gets ``und`` and 0, as does every text if the model has no language.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(f"`{text}`").alias("_text"))
    columns = kept.columns[:-1]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in chunks(batch, "_text"):
                names, codes, offsets = distinct_words(part.column("_text"))
                per_word, n_grams, has_letter = _score_words(model, names)
                known = sums(has_letter[codes].astype(np.int64), offsets) > 0
                if not model.langs:
                    known[:] = False
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if known.any():
                    n = sums(n_grams[codes], offsets)
                    logits = sums(per_word[codes], offsets) / np.maximum(n, 1)[:, None] + model.bias
                    chance = _softmax(logits / model.temperature)
                    best = chance.argmax(1)
                    score = np.where(known, chance.max(1), 0.0)
                pred = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in columns], pa.array(pred, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return kept.mapInArrow(tidy(run), widened(kept.drop("_text").schema, lang_pred="string", score="double"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for all rows of ``docs`` (doc_id, text, lang).

    Held out, and not learned from, are the rows for which crc32 of the id as text leaves 2 when divided by 4 (a
    null id counts as empty). Null and empty texts and texts without a letter get ``und``; very long texts are read
    whole; repeated rows get equal predictions; an empty table gives no rows; other columns are not read.
    """
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2).alias("held_out")
    return predict(docs, fit(docs.where(~held_out), sample=sample), (F.col("doc_id"), held_out))
