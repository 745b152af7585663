"""Sinks: keyed dimension tables, retention counts, envelopes, GeoJSON.

All writes go from the executors (``DataFrame.write``); nothing is collected
to the driver.  Errors are raised, never swallowed, so a failed micro-batch
is retried from its checkpointed offsets instead of being lost.

The fact table is ``sinks.fact_table``, tables with a key are ``sinks.keyed_table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.operators.features import to_geojson
from railpulse.sinks.keyed_table import Changed, KeyedTable


# --------------------------------------------------------------------------- S9-S11
def read_table(spark: SparkSession, path: str, key: str = "code") -> DataFrame | None:
    return KeyedTable(spark, path, [key]).read()


def replace_table(df: DataFrame, path: str, key: str = "code") -> Changed:
    """Delete-all + bulk insert, visible as one change."""
    return KeyedTable(df.sparkSession, path, [key]).replace(df)


def upsert_table(df: DataFrame, path: str, key: str = "code") -> Changed:
    """Insert or update-all-columns on key conflict."""
    return KeyedTable(df.sparkSession, path, [key]).upsert(df)


def seed_table(df: DataFrame, path: str, key: str = "code") -> Changed:
    """Insert rows whose key is absent."""
    return KeyedTable(df.sparkSession, path, [key]).insert_if_absent(df)


# --------------------------------------------------------------------------- C23 / S14
def retention_counts(df: DataFrame, as_of, keep: str, ts_col: str = "timestamp") -> DataFrame:
    """Rows a retention sweep deletes (older than ``as_of - keep``) and keeps."""
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {keep}")
    return df.agg(F.count_if(F.col(ts_col) < cutoff).alias("deleted_count"),
                  F.count_if(F.col(ts_col) >= cutoff).alias("kept_count"))


# --------------------------------------------------------------------------- S2 / S16
def to_envelope(snapshots: DataFrame, source: str = "tracker") -> DataFrame:
    """(line_code, xml, ts) -> value + 4 headers, as written to the topic."""
    h = F.array(
        F.struct(F.lit("source").alias("key"), F.lit(source).cast("binary").alias("value")),
        F.struct(F.lit("line_code").alias("key"), F.col("line_code").cast("binary").alias("value")),
        F.struct(F.lit("timestamp").alias("key"),
                 F.col("ts").cast("string").cast("binary").alias("value")),
        F.struct(F.lit("content-type").alias("key"),
                 F.lit("application/xml").cast("binary").alias("value")))
    return snapshots.select(F.lit(None).cast("binary").alias("key"),
                            F.col("xml").cast("binary").alias("value"), h.alias("headers"),
                            F.col("ts").cast("timestamp").alias("timestamp"))


def write_envelopes_kafka(env: DataFrame, servers: str, topic: str) -> None:
    (env.select("key", "value", "headers").write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.acks", "all").option("kafka.retries", "3").save())


def write_geojson(features: DataFrame, path: str, lng: str = "lng", lat: str = "lat") -> None:
    """One GeoJSON feature per line of text."""
    to_geojson(features, lng, lat).write.mode("overwrite").text(path)
