"""Edges are dealt once, and segments aren't dealt by line."""

import re

from pyspark.sql import functions as F

from railpulse.operators import features, refdata

EDGE = ("line_code string, from_code string, to_code string, sequence_order int, from_lat double, from_lng double, "
        "to_lat double, to_lng double, travel_time_seconds int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_once_and_not_by_line(spark):
    stops = spark.createDataFrame(
        [(f"L{s % 2}", "L", s, p, "", f"S{(s * 2 + p * 3) % 5}", 1.0 + p, 2.0) for s in range(9) for p in range(4)],
        "line_id string, line_code string, seq_no long, pos int, stationId string, id string, lat double, lon double")
    lines = stops.select("line_id", "line_code", F.col("line_id").alias("line_rank")).distinct()
    text = plan(refdata.build_edges(stops, lines))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # the routes and the pairs
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_segments_stay_where_they_are(spark):
    lines = spark.createDataFrame([("L", "Line", "#1"), ("L", "Again", "#2"), ("M", "Bare", "#3"), (None, "None", "#4")],
                                  "code string, name string, color string")
    edges = spark.createDataFrame([("L", f"s{i}", f"s{i + 1}", i, 1.0, 1.0, 2.0, 2.0, None) for i in range(6)]
                                  + [("X", "s0", "s1", 0, 1.0, 1.0, 2.0, 2.0, None)], EDGE)
    seg = features.line_segments(lines, edges, spark)
    drawn = plan(features.segments_to_geojson(seg.where("from_code IS NOT NULL")))
    assert "BroadcastHashJoin" in drawn and "hashpartitioning" not in drawn
    got = seg.select("code", "name", "from_code").collect()
    want = [("L", n, f"s{i}") for n in ("Line", "Again") for i in range(6)] + [("M", "Bare", None), (None, "None", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
