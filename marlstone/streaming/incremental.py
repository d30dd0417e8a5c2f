"""A Structured Streaming sink onto the lake: each micro-batch is checked and appended, at least once.

A load replaces a source as a whole, so a batch is merged with what its sources already hold: batch rows come first in
the order, the lake's rows after them, and the first row per key stays. A repeated batch gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..contracts import get_contract
from ..plans.lake import Lake
from ..settings import Run
from ..sources.rawzone import ORDER, arrival


def merge_batch(lake: Lake, dataset: str, batch: DataFrame, run: Run) -> int:
    contract = get_contract(dataset)
    touched = batch.select("source").distinct()
    fresh = contract.project(batch).withColumn(ORDER, arrival(0))
    held = lake.table(dataset).join(touched, "source", "left_semi").select(*contract.column_names)
    held = held.withColumn(ORDER, arrival(1))
    return lake.load_dataset(dataset, fresh.unionByName(held), run)


def load_stream(stream: DataFrame, lake: Lake, dataset: str, run: Run, checkpoint: str, **trigger) -> StreamingQuery:
    """Start loading a stream of canonical rows; `trigger` as in DataStreamWriter.trigger (default: all there is, then stop)."""
    sink = stream.writeStream.foreachBatch(lambda batch, _: merge_batch(lake, dataset, batch, run) and None)
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
