"""Latest row per train (C2), recency counts (A13) and stale retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import LATEST_WINDOW
from railpulse.functions.text import countdown_rank

VIEW_COLUMNS = ["id", "set_number", "trip_number", "line_code", "station_code", "station_name",
                "platform_name", "current_location", "time_to_station", "destination",
                "calculated_lat", "calculated_lng", "heading", "timestamp"]


def order_columns() -> list[str]:
    """What breaks ties behind timestamp and countdown rank."""
    return ["id", "trip_number", "station_code", "station_name", "platform_name",
            "current_location", "time_to_station", "destination"]


def global_max_timestamp(df: DataFrame, ts_col: str = "timestamp"):
    """Newest timestamp of the fact table as a driver-side scalar.

    Taken first so the recency filter below is a literal: it then reaches the
    Parquet scan (partition pruning on a date partition, row-group min/max)
    instead of being evaluated after a full scan.
    """
    return df.agg(F.max(ts_col).alias("m")).first()["m"]


def latest_positions(df: DataFrame, window: str = LATEST_WINDOW, line: str | None = None,
                     batch_ts=None, partition_col: str = "ingest_date") -> DataFrame:
    """One row per (set_number, line_code): newest poll, then best countdown rank.

    Rows older than ``window`` behind the global newest timestamp are ignored.
    The global maximum is computed over all lines even when ``line`` is given.
    Ties left open by (timestamp desc, rank asc) are broken by ``id``, then by
    the remaining columns, so the result is deterministic.

    ``row_number() == 1`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot train key never ships more than one row per map task.
    """
    if batch_ts is None:
        batch_ts = global_max_timestamp(df)
    if batch_ts is None:
        return df.select(*VIEW_COLUMNS).limit(0)
    lower = F.lit(batch_ts) - F.expr(f"INTERVAL {window}")
    recent = df.filter(F.col("timestamp") >= lower)
    if partition_col in df.columns:
        # the fact table is partitioned by the date of ``timestamp``: prune whole days
        recent = recent.filter(F.col(partition_col) >= F.to_date(lower))
    if line:
        recent = recent.filter(F.col("line_code") == line)
    order = [F.col("timestamp").desc(), countdown_rank("time_to_station").asc(),
             F.col("id").asc_nulls_last()]
    order += [F.col(c).asc() for c in order_columns()[1:]]
    w = Window.partitionBy("set_number", "line_code").orderBy(*order)
    return (recent.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1)
            .select(*VIEW_COLUMNS))


def recent_count(df: DataFrame, as_of, within: str = "5 minutes") -> DataFrame:
    """Health check: rows newer than ``as_of - within`` (strictly), and all rows."""
    lo = F.lit(as_of) - F.expr(f"INTERVAL {within}")
    return df.agg(
        F.count_if(F.col("timestamp") > lo).alias("recent_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def with_retention(snapshots: DataFrame, key_cols=("set_number", "line_code"),
                   ts_col: str = "timestamp", ttl_seconds: int = 90,
                   line: str | None = None) -> DataFrame:
    """Keys absent from the newest snapshot are kept (``stale``) until ``ttl`` passes.

    ``snapshots`` holds one row per key per poll.  For every key seen at or
    before the newest poll: its newest row, ``last_seen`` and ``stale``.  A
    key not in the newest poll survives while ``newest - last_seen < ttl``.
    With a line filter, keys of other lines are not retained.
    """
    keys = list(key_cols)
    newest = global_max_timestamp(snapshots, ts_col)
    if line:
        snapshots = snapshots.filter(F.col("line_code") == line)
    w = Window.partitionBy(*keys).orderBy(F.col(ts_col).desc())
    last = (snapshots.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .drop("_rn").withColumn("last_seen", F.col(ts_col)))
    age = F.unix_micros(F.lit(newest).cast("timestamp")) - F.unix_micros(
        F.col("last_seen").cast("timestamp"))
    in_newest = F.col("last_seen") == F.lit(newest)
    keep = in_newest | (age < F.lit(ttl_seconds * 1_000_000))
    return last.filter(keep).withColumn("stale", ~in_newest)
