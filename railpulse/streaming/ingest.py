"""Structured Streaming ingest and per-batch jobs.

``start_ingest``: raw messages -> ``flatten_predictions`` (stateless, append)
-> ``foreachBatch`` append to the fact table (``sinks.fact_table``), with its own
checkpoint.  The default trigger is 10 s processing time; tests pass ``availableNow``.
A batch's rows carry the batch's own time, which the checkpoint keeps with the
offsets, and its folders are named after the query and the batch: a batch that is run
again after a failure ends as if it had been run once.

``start_positions``: the stream-static join to dimensions (T10).  Each
micro-batch is joined to dimension tables loaded inside the batch function, so
a rebuilt dimension is picked up by the next batch without a restart, and one that
hasn't changed is not built again (``streaming.dimensions``).
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from railpulse.operators.flatten import flatten_predictions
from railpulse.session import scratch_job
from railpulse.sinks.fact_table import FactTable, as_fact

DEFAULT_TRIGGER = {"processingTime": "10 seconds"}


def start_ingest(raw: DataFrame, sink_path: str, checkpoint: str,
                 trigger: dict | None = None, query_name: str | None = None
                 ) -> StreamingQuery:
    """Flatten each micro-batch and append it to the fact table at ``sink_path``."""
    table = FactTable(raw.sparkSession, sink_path)
    rows = as_fact(flatten_predictions(raw))

    def append(batch: DataFrame, batch_id: int) -> None:
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.append(batch, batch_id, source[:8])

    w = (rows.writeStream.foreachBatch(append)
         .option("checkpointLocation", checkpoint)
         .outputMode("append")
         .trigger(**(trigger or DEFAULT_TRIGGER)))
    if query_name:
        w = w.queryName(query_name)
    return w.start()


def start_positions(rows: DataFrame, load_dims: Callable[[], tuple[DataFrame, DataFrame]],
                    job: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
                    sink_path: str, checkpoint: str, trigger: dict | None = None
                    ) -> StreamingQuery:
    """Per micro-batch, ``job(batch, stations, edges)`` with the dimensions as they are then.

    ``load_dims``: see ``dimensions.Dimensions``.  What the job stores on its way is deleted
    when the batch has been written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_job(rows.sparkSession, "positions"):
            stations, edges = load_dims()
            out = job(batch, stations, edges)
            out.write.mode("overwrite").parquet(os.path.join(sink_path, f"batch_id={batch_id}"))

    return (rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or DEFAULT_TRIGGER)).start())


def stop(query: StreamingQuery, timeout_s: float = 30.0) -> None:
    """Graceful stop: let the running batch finish, for ``timeout_s`` at most, then stop."""
    end = time.monotonic() + timeout_s
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    query.stop()
