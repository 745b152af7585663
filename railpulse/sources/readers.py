"""Sources: message streams, landed XML snapshots, JSON documents, dimensions.

* S1 ``kafka_stream``: the topic with headers (``startingOffsets=latest``).
  The Kafka connector jar is not bundled; the function only declares the
  source, tests use ``raw_messages`` over files with the same schema.
* S3 ``xml_snapshots``: one whole XML document per file (``wholetext``),
  line code from the file name ``<line>_<anything>.xml``.
* S4-S6: JSON documents (stop points, route sequences, timetables) read with
  declared schemas and flattened with ``posexplode`` so every row carries the
  input ordinals the "first occurrence" rules need.
* S7 ``dimension``: column-pruned Parquet reads.
* S15 ``read_evolved``: tables written before an additive column change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.schemas import RAW_MESSAGE, ROUTE_DOC, STOP_POINTS_DOC, TIMETABLE_DOC


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 group_id: str = "railpulse-consumer", starting: str = "latest") -> DataFrame:
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting)
            .option("kafka.group.id", group_id)
            .option("includeHeaders", "true")
            .load())


def raw_messages(spark: SparkSession, path: str, stream: bool = False,
                 max_files: int | None = None) -> DataFrame:
    """Landed raw messages (Parquet, RAW_MESSAGE schema), batch or stream."""
    if stream:
        r = spark.readStream.schema(RAW_MESSAGE)
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        return r.parquet(path)
    return spark.read.schema(RAW_MESSAGE).parquet(path)


def xml_snapshots(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Whole-file XML documents as raw messages with a ``line_code`` header."""
    r = (spark.readStream if stream else spark.read)
    df = r.format("text").option("wholetext", "true").load(path)
    fname = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\z", 1)
    line = F.regexp_extract(fname, r"^([^_]+)_", 1)
    return df.select(
        F.col("value").cast("binary").alias("value"),
        F.array(F.struct(F.lit("source").alias("key"), F.lit(b"file").cast("binary").alias("value")),
                F.struct(F.lit("line_code").alias("key"), line.cast("binary").alias("value"))
                ).alias("headers"),
        F.col("_metadata.file_modification_time").alias("timestamp"))


def _document():
    """Key of a JSON document: its file, and its place among the file's documents."""
    # a multi-line file is read by one task, so the ids within a file follow its order
    return F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))


def stop_points(spark: SparkSession, path: str) -> DataFrame:
    """Stop-point documents -> one row per stop point with (doc_idx, sp_idx).

    ``doc_idx`` orders documents by file name, then by their place in the file.
    """
    docs = spark.read.schema(STOP_POINTS_DOC).option("multiLine", "true").json(path)
    docs = docs.withColumn("doc_idx", _document())
    return docs.select("doc_idx", F.posexplode("stopPoints").alias("sp_idx", "sp")).select(
        "doc_idx", "sp_idx", "sp.*")


def route_stops(spark: SparkSession, path: str) -> DataFrame:
    """Route documents -> line_id, seq_no, pos, stationId, id, name, lat, lon.

    A document whose route list is empty yields no stops; more than one route
    repeats its sequences, which adds no edge, so they are read once.  ``seq_no``
    is (document, sequence), so documents of one line never mix.
    """
    docs = spark.read.schema(ROUTE_DOC).option("multiLine", "true").json(path)
    d = docs.filter(F.size(F.coalesce("orderedLineRoutes", F.array())) > 0).select(
        F.col("lineId").alias("line_id"), _document().alias("doc"),
        F.posexplode("stopPointSequences").alias("sq", "seq"))
    d = d.select("line_id", F.struct("doc", "sq").alias("seq_no"),
                 F.posexplode("seq.stopPoint").alias("pos", "sp"))
    return d.select("line_id", "seq_no", "pos", "sp.stationId", "sp.id", "sp.name",
                    "sp.lat", "sp.lon")


def timetable_intervals(spark: SparkSession, path: str, line_map: DataFrame) -> DataFrame:
    """Timetable documents -> line_code, departure, route_idx, set_idx, interval_idx,
    stop_id, time_to_arrival (``line_map``: line_id -> line_code).

    ``route_idx`` is (document, route), so timetables of one departure never mix."""
    docs = spark.read.schema(TIMETABLE_DOC).option("multiLine", "true").json(path)
    d = docs.select(F.col("lineId").alias("line_id"),
                    F.col("timetable.departureStopId").alias("departure"),
                    _document().alias("doc"), F.posexplode("timetable.routes").alias("route", "r"))
    d = d.select("line_id", "departure", F.struct("doc", "route").alias("route_idx"),
                 F.posexplode("r.stationIntervals").alias("set_idx", "si"))
    d = d.select("line_id", "departure", "route_idx", "set_idx",
                 F.posexplode("si.intervals").alias("interval_idx", "iv"))
    d = d.join(line_map.select("line_id", "line_code"), "line_id")
    return d.select("line_code", "departure", "route_idx", "set_idx", "interval_idx",
                    F.col("iv.stopId").alias("stop_id"),
                    F.col("iv.timeToArrival").alias("time_to_arrival"))


def dimension(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files differ by added columns (missing ones are NULL)."""
    return spark.read.option("mergeSchema", "true").parquet(path)
