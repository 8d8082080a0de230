"""Counts and durations of what is done to tables, kept in the process."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Upper ends of the buckets that durations are counted in, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)


class Metrics:
    """By operation, table and outcome: how often, how long in all, and how often within each bucket."""

    def __init__(self):
        self._lock = threading.Lock()
        self._held: dict[tuple[str, str, str], list] = {}

    def add(self, operation: str, table: str, outcome: str, seconds: float) -> None:
        with self._lock:
            found = self._held.setdefault((operation, table, outcome), [0, 0.0, [0] * (len(BUCKETS) + 1)])
            found[0] += 1
            found[1] += seconds
            found[2][bisect_left(BUCKETS, seconds)] += 1

    @contextmanager
    def timed(self, operation: str, table: str) -> Iterator[None]:
        """Counts what happens within as done, or by the class of the error that ends it."""
        start, outcome = time.perf_counter(), "done"
        try:
            yield
        except BaseException as e:
            outcome = type(e).__name__
            raise
        finally:
            self.add(operation, table, outcome, time.perf_counter() - start)

    def rows(self) -> list[tuple]:
        """(operation, table, outcome, count, seconds, counts by bucket), in order."""
        with self._lock:
            return [(*key, n, seconds, list(held)) for key, (n, seconds, held) in sorted(self._held.items())]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "operation string, table string, outcome string, count long, seconds double, buckets array<long>")
