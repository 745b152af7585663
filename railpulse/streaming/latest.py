"""The latest row per train as a stream (T7 with C2).

Each train's best row so far, by the order of ``operators.latest`` (newest poll, then countdown
rank, then the tie-breakers), is kept in the state store.  The watermark trails the newest
timestamp by the view's window, so a row that arrives behind the watermark lies outside the
window of every later view and may be dropped; and a train whose best row falls behind
it is out of the view: an event-time timer removes its state and emits it once more
with ``removed = true``.  The state holds the trains of the window, however long the
stream runs.  ``RocksDB`` keeps it on the executors' disks.

``start_latest`` puts what changes into a keyed table of which each batch rewrites only the
buckets that its trains fall in; ``view`` reads it and applies the window exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from railpulse.functions.constants import LATEST_WINDOW
from railpulse.functions.text import countdown_rank
from railpulse.operators.latest import VIEW_COLUMNS, order_columns
from railpulse.schemas import TRAIN_POSITIONS
from railpulse.session import materialize, scratch_job
from railpulse.sinks.keyed_table import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["set_number", "line_code"]
_TYPES = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in TRAIN_POSITIONS.fields}
_ROW = ", ".join(f"{c} {_TYPES[c]}" for c in VIEW_COLUMNS)
_OUT = f"{_ROW}, removed boolean"


class LatestRow(StatefulProcessor):
    """Keeps a train's best row until the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", f"{_ROW}, newest_first bigint, rank bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [*VIEW_COLUMNS, "newest_first", "rank"]
        old = dict(zip(columns, self.best.get())) if self.best.exists() else None
        best = old
        for part in rows:
            for row in part.to_dict("records"):
                row = {**row, **dict(zip(KEYS, key))}  # the key's columns come with the key
                row = {c: None if pd.isna(row[c]) else row[c] for c in columns}
                if best is None or _place(row) < _place(best):
                    best = row
        if best is not old:
            self.best.update(tuple(best[c] for c in columns))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-best["newest_first"] // 1000 + 1)
            yield _frame(best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            row = dict(zip([*VIEW_COLUMNS, "newest_first", "rank"], self.best.get()))
            self.best.clear()
            yield _frame(row, True)

    def close(self) -> None:
        pass


def _place(row: dict) -> tuple:
    """Sort key of a row: ids that are null come last, other nulls first, as in the batch order."""
    return (row["newest_first"], row["rank"], row["id"] is None, row["id"] or 0,
            *((row[c] is not None, row[c] or "") for c in order_columns()[1:]))


def _frame(row: dict, removed: bool) -> pd.DataFrame:
    return pd.DataFrame([{**{c: row[c] for c in VIEW_COLUMNS}, "removed": removed}]).astype(
        {"id": "Int64", "calculated_lat": "float64", "calculated_lng": "float64"})


def latest_stream(rows: DataFrame, window: str = LATEST_WINDOW) -> DataFrame:
    """Changes of the latest row per train: ``VIEW_COLUMNS`` (timestamp in UTC) and ``removed``."""
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    keyed = rows.select(*VIEW_COLUMNS).withColumns({
        "timestamp": F.col("timestamp").cast("timestamp"), "newest_first": -micros,
        "rank": countdown_rank("time_to_station").cast("bigint")})
    return keyed.withWatermark("timestamp", window).groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=LatestRow(), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")


def start_latest(rows: DataFrame, view_path: str, checkpoint: str, window: str = LATEST_WINDOW,
                 trigger: dict | None = None, buckets: int = 16) -> StreamingQuery:
    """Keep the view's table at ``view_path`` up to date with a stream of fact rows."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = KeyedTable(spark, view_path, KEYS, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        # a train may leave and come back in one batch: what it has now counts
        with scratch_job(spark, "latest"):
            last = materialize(batch, "changes").groupBy(*KEYS).agg(F.max_by(F.struct(*batch.columns), F.struct(~F.col("removed"), "timestamp")).alias("r"))
            changes = last.select("r.*").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
            table.upsert(changes, removed="removed")

    return (latest_stream(rows, window).writeStream.foreachBatch(merge).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def view(spark: SparkSession, view_path: str, window: str = LATEST_WINDOW) -> DataFrame | None:
    """The view as it stands: rows within ``window`` of the newest one (None before the first batch)."""
    rows = KeyedTable(spark, view_path, KEYS).read()
    if rows is None:
        return None
    newest = rows.agg(F.max("timestamp").alias("m")).first()["m"]
    return rows.where(F.col("timestamp") >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {window}")).select(*VIEW_COLUMNS)
