"""A streaming sink on a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tarn.table import Table


def into_table(stream: DataFrame, table: Table, name: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch to ``table``, exactly once.

    A batch commits under ``<name>-<batch id>``; after a failure the same batch comes again under the same id, which
    the log answers with the version it already has. ``name`` must be the stream's own, for good.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: table.insert(batch, f"{name}-{number}") and None)
