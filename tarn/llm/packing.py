"""Packing of documents into training sequences by large-item matching and best fit.

A piece longer than a third of the capacity is large; no more than two of them fit into one sequence. Large pieces
are paired greedily: the longest with the longest that still fits beside it. Smaller pieces then go, longest
first, each into the tightest remaining gap.

Only lengths matter to this, and there are at most ``capacity`` of them. So the whole corpus is packed at once on
the driver from a histogram of lengths, whatever its size: equal lengths are placed as runs, and the outcome is a
list of slots (a length, how many pieces, which sequences, which offset). The executors rank the pieces of each
length and look their slot up.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch, widened
from tarn.llm.words import bounded_batches, chunks, coded_words, tidy

#: Bytes of text that are encoded at a time: what a worker holds beside its tokenizer goes with it.
ENCODED_BYTES = 1 << 20
#: Rows of one length that one task ranks, at most, and at least.
MOST_RANKED, LEAST_RANKED = 250_000, 256


class _Bins:
    """Sequences under construction, kept as runs of equal ones: gap -> [(pieces as ((length, copies), ...), how many)]."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.gaps, self.done = capacity, {}, [], []

    def add(self, gap: int, held: tuple, many: int) -> None:
        if not many:
            return
        if gap == 0:
            self.done.append((held, many))
            return
        if gap not in self.runs:
            self.runs[gap] = []
            insort(self.gaps, gap)
        self.runs[gap].append((held, many))

    def tightest(self, length: int) -> tuple[int, tuple, int] | None:
        """Takes out a run with the smallest gap that holds ``length``."""
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        held, many = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            del self.gaps[at]
        return gap, held, many

    def fill(self, gap: int, held: tuple, many: int, length: int, count: int) -> int:
        """Puts up to ``count`` pieces into ``many`` equal sequences, each filled before the next; returns what is left."""
        fit = gap // length
        full = min(many, count // fit)
        self.add(gap - fit * length, (*held, (length, fit)), full)
        count -= full * fit
        if full < many:
            part = min(count, fit)
            self.add(gap - part * length, (*held, (length, part)) if part else held, 1)
            self.add(gap, held, many - full - 1)
            count -= part
        return count


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packs a histogram of lengths: [(pieces of a sequence as ((length, copies), ...), number of such sequences)]."""
    left = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside 1 to the capacity")
    bins = _Bins(capacity)
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        # The longest partner that fits; ``a`` itself only if two of them are left.
        at = bisect_left(large, capacity - a + 1) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1
        if at < 0:
            bins.add(capacity - a, ((a, 1),), left[a])
            large.pop()
            continue
        b = large[at]
        if a == b:
            pairs = left[a] // 2
            bins.add(capacity - 2 * a, ((a, 2),), pairs)
            left[a] -= 2 * pairs
        else:
            pairs = min(left[a], left[b])
            bins.add(capacity - a - b, ((a, 1), (b, 1)), pairs)
            left[a] -= pairs
            left[b] -= pairs
            if not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        count = left[length]
        while count:
            found = bins.tightest(length)
            if found is None:
                found = (capacity, (), -(-count // (capacity // length)))
            count = bins.fill(*found, length, count)
    return bins.done + [run for runs in bins.runs.values() for run in runs]


def _slots(packed: list) -> tuple[np.ndarray, ...]:
    """By length and rank: (length, first rank, first sequence, offset of the first copy, copies in a sequence)."""
    ranked: dict[int, int] = {}
    rows, first = [], 0
    for held, many in packed:
        offset = 0
        for length, copies in held:
            rank = ranked.get(length, 0)
            rows.append((length, rank, first, offset, copies))
            ranked[length] = rank + copies * many
            offset += length * copies
        first += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(table[:, i] for i in range(5))


class _Encoder:
    """Ids of distinct words; remembers the stems and tails it has seen, up to a number of them.

    Where the tokenizer takes letter runs and punctuation runs apart and marks the end of each, words of letters
    with punctuation behind them are taken apart here: their stems are encoded many at a time, separated by spaces,
    and cut at the end marks. All other words, such as those that hold the string of a special token, are encoded
    whole, each on its own.
    """

    #: Stems in one string; stems and tails to remember, and characters of one; ASCII punctuation that begins no contraction.
    TOGETHER, MOST, LONGEST, MARKS = 1000, 150_000, 64, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        parts = json.loads(Path(path).read_text())
        pattern = json.dumps(parts.get("pre_tokenizer"))
        suffix = parts["model"].get("end_of_word_suffix")
        special = [x["content"] for x in parts.get("added_tokens") or ()]
        if any(re.search(r"[\x20\x09-\x0D]", x) for x in special):
            raise ValueError("a special token holds white space, so a text's ids are not those of its words")
        self.splits = bool(suffix) and r"|[\\p{L}]+|" in pattern and r"|[^\\s\\p{L}\\p{N}]+" in pattern
        # A special token of letters or of marks alone would be found within stems or tails.
        self.splits = self.splits and not any(x.isalpha() or not x.strip(self.MARKS) for x in special)
        self.lowers = "Lowercase" in json.dumps(parts.get("normalizer"))
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if self.splits:
            self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Part 0 is empty; part k has the ids from ``starts[k]`` to ``starts[k + 1]``."""
        self.index: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _numbers(self, names: list[str], encode: Callable[[list[str]], list[bytes]], fits: Callable[[str], bool]) -> np.ndarray:
        """The part of each name, encoded if it is new; -1 for those that do not fit."""
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        fresh = [i for i in np.nonzero(at < 0)[0].tolist() if fits(names[i])]
        if fresh:
            own, n = [names[i] for i in fresh], len(self.starts) - 1
            found, sizes = _joined(encode(own))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, found])
            at[fresh] = np.arange(n, n + len(own))
            self.index.update(zip(own, range(n, n + len(own)), strict=True))
        return at

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _stems(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, got in zip(groups, self.model.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(cuts) != len(group) or cuts[-1] != 4 * len(ids):
                out += self._each(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _plain(self, stem: str) -> bool:
        """Whether a stem is letters alone, also when normalised: normalising some letters yields marks, which are runs of their own."""
        return len(stem) < self.LONGEST and stem.isalpha() and (stem.isascii() or normalize("NFC", stem).lower().isalpha())

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, where each part begins and one more, each word's first and second part); part 0 is empty."""
        if len(self.index) > self.MOST:
            self._forget()
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        whole = np.arange(len(words))
        if self.splits and len(words):
            stems = pc.utf8_rtrim(words, self.MARKS)
            tails = _behind(words, stems).dictionary_encode()
            if self.lowers:
                stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
            stems = stems.dictionary_encode()
            one = self._numbers(stems.dictionary.to_pylist(), self._stems, self._plain)[stems.indices.to_numpy()]
            two = self._numbers(tails.dictionary.to_pylist(), self._each, lambda x: 0 < len(x) < self.LONGEST)
            # No tail is part 0; a word with a long one is taken whole.
            two[[x == "" for x in tails.dictionary.to_pylist()]] = 0
            two = two[tails.indices.to_numpy()]
            split = (one >= 0) & (two >= 0)
            first[split], second[split] = one[split], two[split]
            whole = np.nonzero(~split)[0]
        first[whole] = len(self.starts) - 1 + np.arange(len(whole))
        more, sizes = _joined(self._each(words.take(pa.array(whole)).to_pylist()))
        return np.concatenate([self.ids, more]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)]), first, second


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts, and how many each has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _behind(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows each stem in its word."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
    sizes = pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()
    upto = np.cumsum(sizes)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    own = data[np.repeat(ends - upto, sizes) + np.arange(upto[-1])] if len(upto) else data[:0]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32)), pa.py_buffer(own.tobytes()))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int).

    A document's ids are those that the tokenizer gives its text (without adding special tokens; the string of one in
    the text gives its id), then ``end_id``. The tokenizer must split at ASCII white space and drop it, so that a
    text's ids are its words' ids in turn. Only a document longer than ``capacity`` is cut, into
    pieces of ``capacity`` and a last one. A null text counts as empty: one piece, the end id alone.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select("doc_id", F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            for part in chunks(batch, "_text", ENCODED_BYTES):
                names, codes, offsets = coded_words(part.column("_text"))
                flat, starts, first, second = encode(names)
                # Two parts a word, one after another.
                parts = np.stack([first[codes], second[codes]], 1).ravel()
                n_ids = np.diff(starts)[parts]
                ends = np.cumsum(n_ids)
                total = int(ends[-1]) if len(ends) else 0
                ids = flat[np.repeat(starts[parts] - (ends - n_ids), n_ids) + np.arange(total)] if total else flat[:0]
                bounds = np.concatenate([[0], ends])[2 * offsets]
                rows = []
                for doc in range(part.num_rows):
                    own = np.append(ids[bounds[doc] : bounds[doc + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), cut))
                of, piece, start, length, crc, cuts = zip(*rows, strict=True)
                out = [part.column("doc_id").take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(cuts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    more = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "array<int>"} if with_ids else {})
    return kept.mapInArrow(tidy(run), widened(kept.drop("_text").schema, **more))


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with a ``length`` of 1 to ``capacity``.

    Every row is placed; rows in a sequence do not overlap and leave no gap before or between them; ties between
    equal lengths are broken by doc_id and piece, so that only rows alike in both may swap. An empty table gives
    an empty table. Any further columns are kept; their names must not be sequence_id, offset or begin with _.

    The driver gets one row per length (at most ``capacity``), then one per length and share of its rows. A share
    is a hash bucket of a length's rows, small enough for one task, so that a length that a third of all rows have
    is ranked by many tasks.
    """
    spark = pieces.sparkSession
    bounded_batches(spark)
    table = Scratch(spark).save(pieces)
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(MOST_RANKED, max(LEAST_RANKED, sum(counts.values()) // 1024))
    shares = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        shares[length] = -(-n // most)
    split = table.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(shares.tolist()), (F.col("length") + 1).cast("int"))))
    first = np.concatenate([[0], np.cumsum(shares)])
    before = np.zeros(int(first[-1]) + 1, np.int64)
    for r in split.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("n")).collect():
        before[first[r["length"]] + r["_share"]] = r["n"]
    # Rows of the same length in the shares before.
    total = np.cumsum(before) - before
    of = np.repeat(np.arange(capacity + 1), shares)
    ranks = total[:-1] - total[first[:-1]][of]
    lengths, from_rank, sequence, offset, copies = _slots(pack_lengths(counts, capacity))
    shift, columns = 1 << 44, table.columns
    keys = lengths * shift + from_rank
    where = spark.sparkContext.broadcast((first, ranks, keys, lengths, from_rank, sequence, offset, copies))
    order = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", *[x for x in ("ids_crc32", "start") if x in table.columns])
    ranked = split.withColumn("_rank", F.row_number().over(order))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ranks, keys, lengths, from_rank, sequence, offset, copies = where.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            share = batch.column("_share").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64) - 1 + ranks[first[length] + share]
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            into = rank - from_rank[at]
            out = [batch.column(x) for x in columns]
            out += [pa.array(sequence[at] + into // copies[at]), pa.array(offset[at] + into % copies[at] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(look_up), widened(table.schema, sequence_id="long", offset="long"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: ``tokenized`` pieces with their ``place``.

    Rows: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Nulls and empty texts give the end id
    alone; very long texts are cut, nothing else is; repeated rows are placed each on its own; an empty table gives
    no rows; other columns of ``docs`` are not read, so their names cannot clash.
    """
    return place(tokenized(docs, tokenizer_path, capacity, end_id, with_ids=with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (array of int), doc_ids and starts of the parts, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    held = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return held.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))
