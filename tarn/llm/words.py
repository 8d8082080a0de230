"""Words of whole texts in Arrow batches, each distinct word handled once.

A word is a maximal run of characters outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tarn.llm.scratch import ship

#: A word, for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that are turned into words at a time; a longer text is a batch of its own.
CHUNK_BYTES = 4 << 20


#: Bytes in one Arrow batch, about: batches of a fixed number of whole texts have no bound.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Readies a session for Python on the executors: keeps Arrow batches small, as texts of any length go through them whole."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    size = int(re.sub("[^0-9-]", "", now)) if re.fullmatch("-?[0-9]+b?", now) else 0
    if not 0 < size <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives free memory back, or nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a task, after which its worker, which stays for other tasks, gives free memory back to the system."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + most
        upto = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the word number at each place, and where each text's places begin (one more at the end).

    Nulls count as empty texts. The empty string can be among the distinct words, at no place.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    nothing = pc.index(coded.dictionary, "").as_py()
    if nothing >= 0:
        keep = codes != nothing
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return coded.dictionary, codes, offsets


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``coded_words`` with the words as a list."""
    names, codes, offsets = coded_words(texts)
    return names.to_pylist(), codes, offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` (rows, if it has two dimensions) between neighbouring offsets."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


class WordCache:
    """Results for words already seen by this worker process, at most ``most`` of them."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 300_000, longest: int = 64):
        self.compute, self.most, self.longest, self.seen = compute, most, longest, {}

    def __call__(self, names: list[str]) -> list:
        seen = self.seen
        out = [seen.get(x) for x in names]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            fresh = self.compute([names[i] for i in missing])
            if len(seen) + len(missing) > self.most:
                seen.clear()
            for i, value in zip(missing, fresh, strict=True):
                out[i] = value
                if len(names[i]) <= self.longest and len(seen) < self.most:
                    seen[names[i]] = value
        return out
