"""JSON sources, envelopes, versioned tables, retention, evolved schemas, GeoJSON."""

import json
import os

from pyspark.sql import functions as F

from railpulse.operators import flatten, refdata
from railpulse.plans import fixtures as fx
from railpulse.sinks import writers
from railpulse.sources import readers
from conftest import SMALL


def _write_json(path, docs):
    os.makedirs(path, exist_ok=True)
    for i, d in enumerate(docs):
        with open(os.path.join(path, f"d{i}.json"), "w") as f:
            json.dump(d, f, indent=1)


def test_stop_point_json_to_stations(spark, tmp_dir):
    p = os.path.join(tmp_dir, "sp")
    _write_json(p, [{"stopPoints": [
        {"naptanId": "N1", "stationNaptan": "", "commonName": "Acton Town Underground Station",
         "lat": 51.5, "lon": -0.28,
         "lineModeGroups": [{"modeName": "tube", "lineIdentifier": ["district", "piccadilly",
                                                                     "district"]}],
         "lines": [{"id": "piccadilly"}, {"id": "circle"}, {"id": "bakerloo"}]},
        {"naptanId": "N2", "stationNaptan": "S2", "commonName": "Bus Stop", "lat": 51.5,
         "lon": -0.1, "lineModeGroups": [{"modeName": "bus", "lineIdentifier": ["x"]}],
         "lines": []},
        {"naptanId": "N3", "commonName": "Zero", "lat": 0, "lon": -0.1,
         "lineModeGroups": [{"modeName": "tube", "lineIdentifier": ["central"]}]},
        {"naptanId": "N1", "commonName": "Duplicate", "lat": 51.0, "lon": -0.2,
         "lineModeGroups": [{"modeName": "tube", "lineIdentifier": ["central"]}]},
    ]}])
    st = {r.code: r for r in refdata.build_stations(readers.stop_points(spark, p)).collect()}
    assert set(st) == {"N1"}
    assert st["N1"].name == "Acton Town"
    assert st["N1"].lines == ["D", "P", "D", "B"]     # duplicates from groups kept
    assert st["N1"].location_wkt == "POINT(-0.28 51.5)"


def test_route_json_to_edges(spark, tmp_dir):
    p = os.path.join(tmp_dir, "routes")
    stop = lambda c, lat, lon: {"stationId": c, "id": c, "name": c, "lat": lat, "lon": lon}
    _write_json(p, [
        {"lineId": "victoria", "orderedLineRoutes": [{"name": "r1"}, {"name": "r2"}],
         "stopPointSequences": [
             {"branchId": "1", "direction": "outbound",
              "stopPoint": [stop("A", 51.1, -0.1), stop("B", 51.2, -0.2), stop("C", 51.3, -0.3)]},
             {"branchId": "1", "direction": "inbound",
              "stopPoint": [stop("C", 51.3, -0.3), stop("B", 51.2, -0.2), stop("A", 51.1, -0.1)]}]},
        {"lineId": "central", "orderedLineRoutes": [],
         "stopPointSequences": [{"stopPoint": [stop("X", 1, 1), stop("Y", 2, 2)]}]},
    ])
    stops = readers.route_stops(spark, p)
    lm = spark.createDataFrame([("victoria", "V", 1), ("central", "C", 2)],
                               "line_id string, line_code string, line_rank int")
    e = {(r.from_code, r.to_code): r.sequence_order
         for r in refdata.build_edges(stops, lm).collect()}
    assert e == {("A", "B"): 0, ("B", "C"): 1}      # reverse direction deduped, empty routes


def test_envelope_round_trip(spark):
    rows = fx.predictions(spark, SMALL).limit(5)
    xml = rows.select("line_code", "timestamp", F.concat(
        F.lit('<ROOT><S Code="'), F.col("station_code"), F.lit('" N="x"><P N="p" Code="1"><T S="'),
        F.col("set_number"), F.lit('"/></P></S></ROOT>')).alias("xml")).withColumnRenamed(
        "timestamp", "ts")
    env = writers.to_envelope(xml)
    assert [h.key for h in env.first().headers] == ["source", "line_code", "timestamp",
                                                    "content-type"]
    back = flatten.flatten_predictions(env).select("set_number", "line_code").collect()
    assert sorted(map(tuple, back), key=str) == sorted(
        map(tuple, rows.select("set_number", "line_code").collect()), key=str)


def test_dimension_tables(spark, tmp_dir):
    path = os.path.join(tmp_dir, "stations")
    a = spark.createDataFrame([("A", "Old A"), ("B", "Old B")], "code string, name string")
    b = spark.createDataFrame([("B", "New B"), ("C", "New C")], "code string, name string")
    writers.replace_table(a, path)
    writers.upsert_table(b, path)
    assert {r.code: r.name for r in writers.read_table(spark, path).collect()} == {
        "A": "Old A", "B": "New B", "C": "New C"}
    writers.seed_table(spark.createDataFrame([("A", "Seed"), ("D", "Seed D")],
                                             "code string, name string"), path)
    assert {r.code: r.name for r in writers.read_table(spark, path).collect()} == {
        "A": "Old A", "B": "New B", "C": "New C", "D": "Seed D"}


def test_evolved_schema_read(spark, tmp_dir):
    old = spark.createDataFrame([("L", "A", "B")], "line_code string, from_code string, to_code string")
    new = spark.createDataFrame([("L", "B", "C", 90)],
                                "line_code string, from_code string, to_code string, "
                                "travel_time_seconds int")
    old.write.parquet(os.path.join(tmp_dir, "e", "part=0"))
    new.write.parquet(os.path.join(tmp_dir, "e", "part=1"))
    rows = readers.read_evolved(spark, os.path.join(tmp_dir, "e")).collect()
    assert sorted((r.from_code, r.travel_time_seconds) for r in rows) == [("A", None), ("B", 90)]


def test_geojson_sink(spark, tmp_dir):
    st = fx.stations(spark, SMALL)
    writers.write_geojson(st, os.path.join(tmp_dir, "gj"))
    line = spark.read.text(os.path.join(tmp_dir, "gj")).first().value
    f = json.loads(line)
    assert f["type"] == "Feature" and f["geometry"]["type"] == "Point"
    assert len(f["geometry"]["coordinates"]) == 2 and "code" in f["properties"]
