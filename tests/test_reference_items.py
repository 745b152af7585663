"""Names by grams, ordered output, affected-row counts, line maps and geometry, dimensions by version, documents of several lines."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from railpulse.functions import text
from railpulse.operators import features, names, ordering, refdata
from railpulse.plans import fixtures as fx
from railpulse.session import checkpoint_dir
from railpulse.sinks.keyed_table import KeyedTable
from railpulse.sources import readers
from railpulse.streaming import ingest
from railpulse.streaming.dimensions import Dimensions
from conftest import SMALL


# ----------------------------------------------------------------- C3 / J4
def stations(spark, rows):
    return spark.createDataFrame([(c, n, 51.0, -0.1) for c, n in rows], "code string, name string, lat double, lng double")


def best(query, rows):
    """(code, tier) by looking at every station; queries here need no cleaning."""
    q, found = query.lower(), []
    for code, name in rows:
        d = name.replace(".", "").lower()
        bare = q.replace("'", "")
        amp = q.replace(" and ", " & ")
        tier = 0 if d == q else 1 if d == amp else 2 if d.startswith(q) else 3 if d.replace("'", "") == bare else 4 if d == q else 5 if q in d else None
        if tier is not None:
            found.append((tier, len(name), name, code))
    return (min(found)[3], min(found)[0]) if found else (None, None)


def test_containment_by_grams(spark):
    rng = random.Random(2)
    alphabet = "abc '&é"
    rows = [(f"C{k}", "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 8, 30, 100]))).strip() or "x") for k in range(120)]
    rows += [("K1", "King's Cross & St. Pancras"), ("K2", "Kings Cross"), ("L1", "Elephant & Castle"), ("L2", "Shepherd's Bush Market"), ("X1", "T" * 100)]
    asked = ["s cross", "Elephant and Castle", "kings cross", "herd's bush", "t" * 60, "t" * 101, "zzz", "a", "b c", "é", "&", "castle"]
    asked += [n[a:a + rng.choice([1, 2, 3, 5, 12])].strip() for _, n in rows[:60] for a in [rng.randrange(max(1, len(n)))]]
    asked = sorted({a for a in asked if a})
    got = {r["name"]: (r["code"], r["match_priority"]) for r in names.resolve_names(spark.createDataFrame([(a,) for a in asked], "name string"), stations(spark, rows)).collect()}
    assert got == {a: best(a, rows) for a in asked}
    assert {t for _, t in got.values()} >= {0, 1, 2, 3, 5, None}


def test_keys_and_index_are_linear_in_the_name(spark):
    for n in (10, 100, 1000):
        rng = random.Random(n)
        s = stations(spark, [("A", "".join(rng.choice("abcdefghij") for _ in range(n)))])
        assert names.station_keys(s).count() == n + 5 and names.gram_index(s).count() <= 3 * n


# ----------------------------------------------------------------- O1
def test_ranks_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *"abcdefgh"]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, id int").repartition(7)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.ranked(df, "name", "id").orderBy("rank").collect()
        assert [r["rank"] for r in out] == list(range(1, 501))
        assert [(r["name"], r["id"]) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        assert ordering.in_order(df, "name", "id").collect() == [r for r in df.orderBy("name", "id").collect()]
        assert ordering.ranked(df.limit(0), "name").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)


# ----------------------------------------------------------------- A12, J11, F19, S16
def test_affected_rows_are_counted_while_writing(spark):
    edge = lambda a, b: ("N", a, b, 0, 1.0, 2.0, 3.0, 4.0, None)
    edges = spark.createDataFrame([edge("A", "B"), edge("B", "C"), edge("C", "D")], "line_code string, from_code string, to_code string, sequence_order int, from_lat double, from_lng double, to_lat double, to_lng double, travel_time_seconds int")
    times = spark.createDataFrame([("N", "A", "B", 60, 1), ("N", "B", "A", 80, 2), ("N", "C", "B", 90, 3), ("V", "C", "D", 90, 1)], "line_code string, from_code string, to_code string, seconds int, first_seen int")
    stored, counts = refdata.apply_times_counted(edges, times)
    assert counts == {"updated": 3, "defaulted": 1, "edges": 3}
    assert {(r.from_code, r.travel_time_seconds) for r in stored.collect()} == {("A", 80), ("B", 90), ("C", 120)}
    assert refdata.apply_times_counted(edges.limit(0), times)[1] == {"updated": 0, "defaulted": 0, "edges": 0}


def test_circle_stops_belong_to_h(spark):
    stop = lambda line, k, c: (line, 0, k, c, None, 1.0 + k, 2.0)
    stops = spark.createDataFrame([stop("circle", 0, "A"), stop("circle", 1, "B"), stop("hammersmith-city", 0, "B"), stop("hammersmith-city", 1, "C"), stop("tram", 0, "X"), stop("tram", 1, "Y")], "line_id string, seq_no int, pos int, stationId string, id string, lat double, lon double")
    edges = refdata.build_edges(stops, refdata.adjacency_lines(spark))
    assert {(r.line_code, r.from_code, r.to_code) for r in edges.collect()} == {("H", "A", "B"), ("H", "B", "C")}
    assert [r.segment_geometry for r in refdata.with_geometry(edges).orderBy("from_code").collect()] == ["LINESTRING(2.0 1.0, 2.0 2.0)"] * 2
    broken = edges.withColumn("to_lat", F.lit(None).cast("double"))
    assert {r.segment_geometry for r in refdata.with_geometry(broken).collect()} == {None}


def test_line_segments_as_geojson(spark):
    rows = spark.createDataFrame([("N", None, 1.5, 2.0, 3.0, 4.0)], "code string, name string, from_lng double, from_lat double, to_lng double, to_lat double")
    f = json.loads(features.segments_to_geojson(rows).first().feature)
    assert f["geometry"] == {"type": "LineString", "coordinates": [[1.5, 2.0], [3.0, 4.0]]} and f["properties"] == {"code": "N", "name": None}


# ----------------------------------------------------------------- S5, S6
def documents(path, docs):
    os.makedirs(path)
    for k, d in enumerate(docs):
        with open(os.path.join(path, f"d{k}.json"), "w") as f:
            json.dump(d, f)


def test_two_documents_of_a_line_stay_apart(spark, tmp_dir):
    stop = lambda c, x: {"stationId": c, "id": c, "name": c, "lat": x, "lon": x}
    route = lambda *cs: {"lineId": "victoria", "orderedLineRoutes": [{"name": "r"}], "stopPointSequences": [{"branchId": "1", "direction": "outbound", "stopPoint": [stop(c, 1.0 + k) for k, c in enumerate(cs)]}]}
    documents(tmp_dir + "/routes", [route("A", "B"), route("C", "D")])
    edges = refdata.build_edges(readers.route_stops(spark, tmp_dir + "/routes"), refdata.adjacency_lines(spark))
    assert {(r.from_code, r.to_code) for r in edges.collect()} == {("A", "B"), ("C", "D")}  # never B-C
    times = lambda dep, *xs: {"lineId": "victoria", "timetable": {"departureStopId": dep, "routes": [{"stationIntervals": [{"intervals": [{"stopId": s, "timeToArrival": t} for s, t in xs]}]}]}}
    documents(tmp_dir + "/times", [times("A", ("B", 2.0)), times("C", ("D", 3.0), ("E", 4.5))])
    rows = readers.timetable_intervals(spark, tmp_dir + "/times", refdata.adjacency_lines(spark).select("line_id", "line_code"))
    got = {(r.from_code, r.to_code, r.seconds) for r in refdata.segment_times(rows).collect()}
    assert got == {("A", "B", 120), ("C", "D", 180), ("D", "E", 90)}


# ----------------------------------------------------------------- golden row
def test_no_break_spaces_are_trimmed(spark):
    df = spark.createDataFrame([("\u00a0Bank\u00a0",)], "x string")
    assert df.select(text.js_trim(F.col("x")).alias("y")).first().y == "Bank"


# ----------------------------------------------------------------- T10
@pytest.mark.parametrize("change", [False, True])
def test_dimensions_are_built_once_a_version(spark, tmp_dir, change):
    table = KeyedTable(spark, tmp_dir + "/stations", ["code"], buckets=4)
    table.replace(fx.stations(spark, SMALL).select("code", "name", "lat", "lng"))

    def derive(rows):
        return {"stations": rows["stations"], "edges": rows["stations"].select("code").limit(3)}

    dims = Dimensions(spark, {"stations": table}, derive)
    for k in range(2):
        spark.range(3).withColumn("batch", F.lit(k)).coalesce(1).write.parquet(f"{tmp_dir}/in/b={k}")
    seen = []

    def job(batch, st, edges):
        seen.append(st.count())
        if change and len(seen) == 1:
            table.upsert(spark.createDataFrame([("NEW", "New", 1.0, 2.0)], "code string, name string, lat double, lng double"))
        return batch.crossJoin(edges.limit(1))

    base = checkpoint_dir(spark)
    before = set(os.listdir(base))
    src = spark.readStream.schema("id long, batch int").option("maxFilesPerTrigger", 1).parquet(tmp_dir + "/in/*")
    q = ingest.start_positions(src, lambda: tuple(dims.load()[n] for n in ("stations", "edges")), job, tmp_dir + "/out", tmp_dir + "/ck", trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None and len(seen) == 2
    assert (dims.builds, seen[1] - seen[0]) == ((2, 1) if change else (1, 0))
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and next(iter(left)).startswith("dimensions-")
    dims.close()
    assert set(os.listdir(base)) - before == set()
    assert spark.read.parquet(tmp_dir + "/out").count() == 6
