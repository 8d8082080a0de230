"""Queries that run beside the caller: status, result, cancelling, history."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tarn.errors import QueryError
from tarn.metrics import Metrics

#: Ended queries that are remembered.
KEPT = 1000


@dataclass
class Job:
    """A query that was handed in; status is running, done, failed or cancelled."""

    id: str
    started: float
    status: str = "running"
    seconds: float = 0.0
    rows: int | None = None
    error: str | None = None
    _result: pa.Table | None = None
    _ended: threading.Event = field(default_factory=threading.Event)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has ended within the time."""
        return self._ended.wait(seconds)

    def result(self) -> pa.Table:
        """The rows, once it is done; waits for that."""
        self.wait()
        if self.status != "done":
            raise QueryError(f"query {self.id} has {self.status}" + (f": {self.error}" if self.error else ""))
        return self._result


class Jobs:
    """Runs queries in threads of their own. Each one's Spark jobs carry its id as a tag, by which they are cancelled."""

    def __init__(self, spark: SparkSession, metrics: Metrics | None = None):
        self.spark, self.metrics = spark, metrics or Metrics()
        self._held: OrderedDict[str, Job] = OrderedDict()
        self._lock = threading.Lock()

    def submit(self, make: Callable[[], DataFrame], limit: int = 1_000_000) -> Job:
        """Runs the query that ``make`` builds; a result of more than ``limit`` rows fails, as the driver holds it."""
        job = Job(uuid.uuid4().hex, time.time())
        with self._lock:
            self._held[job.id] = job
            ended = [x for x, y in self._held.items() if y._ended.is_set()]
            for x in ended[: max(0, len(ended) - KEPT)]:
                del self._held[x]
        InheritableThread(target=self._run, args=(job, make, limit), daemon=True).start()
        return job

    def _run(self, job: Job, make: Callable[[], DataFrame], limit: int) -> None:
        context = self.spark.sparkContext
        context.addJobTag(job.id)
        status, error, found = "failed", None, None
        try:
            found = make().limit(limit + 1).toArrow()
            if found.num_rows > limit:
                error = f"the result has more than {limit} rows"
            else:
                status = "done"
        except BaseException as e:  # noqa: BLE001  kept for whoever asks
            error = str(e).split("\n")[0]
        finally:
            context.removeJobTag(job.id)
        with self._lock:
            job.seconds = time.time() - job.started
            if job.status == "running":
                job.status, job.error = status, error
                if status == "done":
                    job.rows, job._result = found.num_rows, found
            self.metrics.add("query", "", job.status, job.seconds)
            job._ended.set()

    def cancel(self, job_id: str) -> bool:
        """Stops a running query; whether it was running."""
        job = self.get(job_id)
        with self._lock:
            if job.status != "running":
                return False
            job.status = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def get(self, job_id: str) -> Job:
        found = self._held.get(job_id)
        if found is None:
            raise QueryError(f"there is no query {job_id}")
        return found

    def history(self) -> list[tuple[str, str, float, int | None]]:
        """(id, status, seconds, rows) of all queries remembered, the oldest first."""
        with self._lock:
            return [(x.id, x.status, x.seconds, x.rows) for x in self._held.values()]
