"""Structured Streaming: file source -> flatten -> idempotent sink."""

import os

from pyspark.sql import functions as F

from railpulse.operators import flatten
from railpulse.plans import fixtures as fx
from railpulse.schemas import RAW_MESSAGE
from railpulse.sources import readers
from railpulse.streaming import ingest
from conftest import SMALL

ONCE = {"availableNow": True}


def _land(spark, msgs, path, parts):
    msgs.repartition(parts).write.mode("overwrite").parquet(path)


def test_ingest_idempotent_restart(spark, tmp_dir):
    msgs = fx.xml_messages(spark, SMALL).select(*RAW_MESSAGE.fieldNames())
    a, b = msgs.randomSplit([0.6, 0.4], seed=1)
    land, sink, ck = (os.path.join(tmp_dir, x) for x in ("land", "sink", "ck"))
    _land(spark, a, os.path.join(land, "p1"), 3)
    src = readers.raw_messages(spark, land + "/*", stream=True, max_files=1)
    q = ingest.start_ingest(src, sink, ck, trigger=ONCE)
    q.awaitTermination()
    n1 = spark.read.parquet(sink).count()
    assert n1 == flatten.flatten_predictions(a).count()
    # same checkpoint, nothing new: no duplicate rows
    q = ingest.start_ingest(readers.raw_messages(spark, land + "/*", stream=True), sink, ck,
                            trigger=ONCE)
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == n1
    # new files are picked up once
    _land(spark, b, os.path.join(land, "p2"), 2)
    q = ingest.start_ingest(readers.raw_messages(spark, land + "/*", stream=True), sink, ck,
                            trigger=ONCE)
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == n1 + flatten.flatten_predictions(b).count()
    row = spark.read.parquet(sink).select("timestamp", "ingest_date").first()
    assert row.timestamp is not None and row.ingest_date == row.timestamp.date()


def test_failed_batch_is_retried_not_lost(spark, tmp_dir):
    msgs = fx.xml_messages(spark, SMALL).select(*RAW_MESSAGE.fieldNames())
    land, sink, ck, flag = (os.path.join(tmp_dir, x) for x in ("land", "sink", "ck", "flag"))
    _land(spark, msgs, land, 1)
    rows = flatten.flatten_predictions(readers.raw_messages(spark, land, stream=True))

    def flaky(batch, batch_id):
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("sink down")
        batch.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    q = rows.writeStream.foreachBatch(flaky).option("checkpointLocation", ck).trigger(**ONCE).start()
    try:
        q.awaitTermination()
    except Exception:
        pass
    q = rows.writeStream.foreachBatch(flaky).option("checkpointLocation", ck).trigger(**ONCE).start()
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == flatten.flatten_predictions(msgs).count()


def test_xml_landing_dir_and_stream_static_positions(spark, tmp_dir):
    from railpulse.operators import position
    from railpulse.plans import queries as Q
    land, sink, ck = (os.path.join(tmp_dir, x) for x in ("xml", "pos", "ck"))
    os.makedirs(land)
    docs = {
        "N_0001.xml": '<ROOT><S Code="ST1" N="Supplier#000000001"><P N="Platform 1" Code="1">'
                      '<T S="7" T="1" C="0:30" DE="Supplier#000000002" '
                      'L="Between Supplier#000000001 and Supplier#000000004"/>'
                      '<T S="8" T="2" C="-" DE="Supplier#000000003" L="At Platform"/></P></S></ROOT>',
        "A_0002.xml": '<ROOT><S Code="ST4" N="Supplier#000000004"><P N="P2" Code="2">'
                      '<T S="9" T="3" C="due" DE="Supplier#000000005" L="Approaching Supplier#000000004"/>'
                      '</P></S></ROOT>',
        "A_0003.xml": "<ROOT><S Code=",
    }
    for n, x in docs.items():
        with open(os.path.join(land, n), "w") as f:
            f.write(x)
    raw = readers.xml_snapshots(spark, land)
    rows = flatten.flatten_predictions(raw).collect()
    assert sorted((r.set_number, r.line_code) for r in rows) == [("7", "N"), ("8", "N"), ("9", "A")]

    stations = fx.stations(spark, SMALL)
    edges = Q._edges(spark, SMALL)

    def job(batch, st, e):
        b = batch.select(
            F.monotonically_increasing_id().alias("id"), "set_number", "trip_number", "line_code",
            "station_code", "station_name", "platform_name", "current_location",
            "time_to_station", "destination",
            F.lit(None).cast("double").alias("calculated_lat"),
            F.lit(None).cast("double").alias("calculated_lng"),
            F.lit(None).cast("string").alias("heading"),
            F.current_timestamp().cast("timestamp_ntz").alias("timestamp"))
        return position.with_positions(b, st, e, validate=False).select(
            "set_number", "line_code", "lat", "lng", "position_confidence")

    stream_rows = flatten.flatten_predictions(readers.xml_snapshots(spark, land, stream=True))
    q = ingest.start_positions(stream_rows, lambda: (stations, edges), job, sink, ck, trigger=ONCE)
    q.awaitTermination()
    out = {r.set_number: r for r in spark.read.parquet(sink).collect()}
    assert set(out) == {"7", "8", "9"}
    assert out["7"].position_confidence == "interpolated"      # between, 0:30 known
    assert out["8"].position_confidence == "exact"             # At Platform -> platform station
