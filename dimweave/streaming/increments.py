"""Incremental loads from a stream: each micro-batch is merged into a dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.spec import TargetSpec
from ..plans.planner import Plan, Transfer


def merge_stream(rows: DataFrame, target: TargetSpec, warehouse: str, checkpoint: str, load_date: dt.date | None = None, **trigger) -> StreamingQuery:
    """Merges `rows`, a stream with the target's columns, into its dimension.

    A merge reads what the dimension holds and publishes by a swap.  Repeating
    a batch after a failure changes nothing: equal rows of a key are one
    overwritten row, or a version that is dropped as not newer.
    """

    def merge(batch: DataFrame, number: int) -> None:
        Plan(Transfer(batch, target), load_date=load_date).load(batch.sparkSession, warehouse)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
