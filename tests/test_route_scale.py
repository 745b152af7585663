"""The window over route sequences uses a dealing by line and sequence that is there already."""

import re

from pyspark.sql import functions as F

from railpulse.operators import refdata


def test_routes_dealt_by_line_and_sequence_are_not_dealt_again(spark):
    stops = spark.createDataFrame(
        [("L0", "L", 10 * s, p, "", f"S{(s + p) % 5}", 1.0 + p, 2.0) for s in range(6) for p in range(4)],
        "line_id string, line_code string, seq_no long, pos int, stationId string, id string, lat double, lon double")
    lines = stops.select("line_id", "line_code", F.lit(1).alias("line_rank")).distinct()
    dealt = refdata.build_edges(stops.repartition("line_code", "seq_no"), lines)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((line_code#\d+, )?line_id#\d+, seq_no", plan)
    assert sorted(dealt.collect()) == sorted(refdata.build_edges(stops.drop("line_code"), lines).collect())


def test_edges_dealt_by_pair_give_the_same_times(spark):
    stops = spark.createDataFrame(
        [(f"L{s % 2}", "L", s, p, "", f"S{(s * 2 + p * 3) % 5}", 1.0 + p, 2.0) for s in range(9) for p in range(4)],
        "line_id string, line_code string, seq_no long, pos int, stationId string, id string, lat double, lon double")
    lines = stops.select("line_id", "line_code", F.col("line_id").alias("line_rank")).distinct()
    times = spark.createDataFrame([("L", "S0", "S3", 40, 1), ("L", "S3", "S0", 50, 2), ("L", "S1", "S4", 60, 3)],
                                  "line_code string, from_code string, to_code string, seconds int, first_seen int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paired = refdata.apply_times(refdata.build_edges(stops, lines, paired=True), times)
        plain = refdata.apply_times(refdata.build_edges(stops, lines), times)
        shuffles = [len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))
                    for df in (paired, plain)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles[0] < shuffles[1]
    assert sorted(paired.collect()) == sorted(plain.collect()) and paired.where("timed").count() > 0
