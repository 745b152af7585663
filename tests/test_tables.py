"""One fact table from stream to sweep; keyed tables of which only touched buckets change; the latest row as a stream."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from railpulse.operators import latest as L
from railpulse.plans import fixtures as fx
from railpulse.schemas import RAW_MESSAGE, TRAIN_POSITIONS
from railpulse.sinks.fact_table import FactTable, as_fact
from railpulse.sinks.keyed_table import KeyedTable
from railpulse.sources import readers
from railpulse.streaming import ingest
from railpulse.streaming import latest as SL
from conftest import SMALL

ONCE = {"availableNow": True}
NOON = datetime(2024, 3, 10, 12)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def facts(spark, rows):
    """(set_number, line, countdown, seconds after noon) -> fact rows without id."""
    df = spark.createDataFrame([(s, l, c, NOON + timedelta(seconds=t)) for s, l, c, t in rows], "set_number string, line_code string, time_to_station string, timestamp timestamp_ntz")
    return as_fact(df, F.col("timestamp"))


def content(df):
    return sorted((r.set_number, r.line_code, r.time_to_station, r.timestamp) for r in df.collect())


# ----------------------------------------------------------------- fact table
def test_append_once_and_ids_in_order(spark, tmp_dir):
    t = FactTable(spark, tmp_dir + "/facts")
    assert t.read().count() == 0 and t.newest() is None and t.latest().count() == 0
    a, b = facts(spark, [("1", "N", "-", 0), ("2", "N", "due", 0)]), facts(spark, [("1", "N", "1:00", 30)])
    assert t.append(a, 0) and not t.append(a, 0) and t.append(b, 1) and not t.append(b, 1) and not t.append(a, 0)
    assert t.append(a, 0, source="other")
    rows = t.read().orderBy("id").collect()
    assert [r.set_number for r in rows] == ["1", "2", "1", "1", "2"] and len({r.id for r in rows}) == 5
    assert t.read().columns == [*TRAIN_POSITIONS.fieldNames(), "ingest_date", "batch_id"]
    assert t.newest() == NOON + timedelta(seconds=30)
    assert files(tmp_dir + "/facts")[0].startswith("ingest_date=2024-03-10/batch_id=")


def test_a_batch_that_failed_before_its_commit_is_replaced(spark, tmp_dir, monkeypatch):
    t = FactTable(spark, tmp_dir + "/facts")
    a = facts(spark, [(str(k), "N", "-", 0) for k in range(10)])
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda change: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.append(a, 0)
    assert t.read().count() == 0
    t.append(a, 0)
    assert t.read().count() == 10 and spark.read.parquet(tmp_dir + "/facts").count() == 10


def test_a_commit_in_between_is_not_lost(spark, tmp_dir, monkeypatch):
    t, other = (FactTable(spark, tmp_dir + "/facts") for _ in range(2))
    real, raced = t.commits.newest, []

    def newest():
        known = real()
        if not raced:
            raced.append(1)
            other.append(facts(spark, [("9", "V", "-", 0)]), 0, source="other")
        return known

    monkeypatch.setattr(t.commits, "newest", newest)
    t.append(facts(spark, [("1", "N", "-", 0)]), 0)
    rows = t.read().collect()
    assert sorted(r.set_number for r in rows) == ["1", "9"] and len({r.id for r in rows}) == 2


def test_prune_drops_days_and_rewrites_what_the_cutoff_cuts(spark, tmp_dir):
    t = FactTable(spark, tmp_dir + "/facts")
    day = 86400
    rows = [("1", "N", "-", -3 * day), ("1", "N", "-", -2 * day), ("2", "N", "-", -day - 10), ("2", "N", "due", -day), ("3", "N", "-", -10), ("3", "N", "-", 0)]
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        t.append(facts(spark, part), k)
    before = files(t.path)
    swept = t.prune(NOON, "1 day")
    after = files(t.path)
    assert (swept.deleted, swept.kept) == (3, 3)
    assert [f.day for f in swept.dropped] == ["2024-03-07", "2024-03-08"] and [f.day for f in swept.rewritten] == ["2024-03-09"]
    assert content(t.read()) == content(facts(spark, rows[3:])) == content(spark.read.parquet(t.path))
    today = [f for f in before if f.startswith("ingest_date=2024-03-10")]
    assert today and [f for f in after if f.startswith("ingest_date=2024-03-10")] == today
    assert {f.split("/")[0] for f in after} == {"ingest_date=2024-03-09", "ingest_date=2024-03-10"}
    again = t.prune(NOON, "1 day")
    assert (again.deleted, again.kept, again.rewritten) == (0, 3, []) and files(t.path) == after


def test_compact_merges_crowded_days(spark, tmp_dir):
    t = FactTable(spark, tmp_dir + "/facts")
    for k in range(5):
        t.append(facts(spark, [(str(k), "N", "-", 10 * k)]), k)
    t.append(facts(spark, [("x", "N", "-", 86400)]), 5)
    kept = content(t.read())
    assert t.compact(many=3) == ["2024-03-10"]
    assert content(t.read()) == kept and len(t.manifest().live) == 2 and len(files(t.path)) == 2
    assert not t.append(facts(spark, [("0", "N", "-", 0)]), 3) and t.compact(many=3) == []


def test_latest_opens_no_folder_outside_the_window(spark, tmp_dir):
    t = FactTable(spark, tmp_dir + "/facts")
    rows = [("1", "N", "-", -86400 * 5), ("1", "N", "due", -121), ("1", "N", "due", -100), ("2", "N", "0:30", -120), ("3", "V", "5:00", 0), ("3", "V", "due", 0)]
    for k, r in enumerate(rows):
        t.append(facts(spark, [r]), k)
    df = t.latest()
    assert sorted({f.split("/ingest_date=")[1].split("/part")[0] for f in df.inputFiles()}) == [f"2024-03-10/batch_id=stream-{k}" for k in (2, 3, 4, 5)]
    expect = L.latest_positions(t.read())
    assert sorted(map(str, df.collect())) == sorted(map(str, expect.collect())) and df.count() == 3
    assert [r.set_number for r in t.latest(line="V").collect()] == ["3"]


def test_stream_to_latest_to_sweep_on_one_folder(spark, tmp_dir):
    msgs = fx.xml_messages(spark, SMALL).select(*RAW_MESSAGE.fieldNames())
    land, sink, ck = (os.path.join(tmp_dir, x) for x in ("land", "sink", "ck"))
    msgs.repartition(3).write.parquet(os.path.join(land, "p1"))
    ingest.start_ingest(readers.raw_messages(spark, land + "/*", stream=True, max_files=1), sink, ck, trigger=ONCE).awaitTermination()
    table = FactTable(spark, sink)
    m = table.manifest()
    assert len(m.live) == 3 and all(f.least == f.most for f in m.live)  # one time for each batch
    got = table.read()
    assert got.filter("id IS NULL OR timestamp IS NULL").isEmpty() and got.select("id").distinct().count() == got.count()
    trains = got.select("set_number", "line_code").distinct().count()
    assert table.latest().count() == trains
    before = files(sink)
    cut = datetime.fromisoformat(sorted(f.most for f in m.live)[0]) + timedelta(milliseconds=1)
    swept = table.prune(cut + timedelta(hours=2), "2 hours")
    first = min(m.live, key=lambda f: f.most)
    assert (swept.deleted, [f.batch for f in swept.dropped], swept.rewritten) == (first.rows, [first.batch], [])
    assert files(sink) == [f for f in before if not f.startswith(first.place)]
    assert table.read().count() == swept.kept == spark.read.parquet(sink).count()


# ----------------------------------------------------------------- keyed tables
def dim(spark, rows):
    return spark.createDataFrame(rows, "code string, name string")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir + "/t", ["code"], buckets=16)
    assert t.read() is None
    first = t.upsert(dim(spark, [(f"K{k}", f"old {k}") for k in range(200)]))
    assert (first.inserted, first.updated, first.deleted) == (200, 0, 0) and len(first.buckets) == 16
    before = files(t.path)
    done = t.upsert(dim(spark, [("K7", "new"), ("K300", "more"), (None, "null")]))
    assert (done.inserted, done.updated, done.deleted) == (2, 1, 0)
    after = files(t.path)
    own = tuple(f"bucket={b}/" for b in done.buckets)
    assert len(done.buckets) <= 3 and [f for f in after if not f.startswith(own)] == [f for f in before if not f.startswith(own)]
    assert not set(f for f in after if f.startswith(own)) & set(before)
    rows = {r.code: r.name for r in t.read().collect()}
    assert len(rows) == 202 and (rows["K7"], rows["K300"], rows[None], rows["K8"]) == ("new", "more", "null", "old 8")
    assert t.upsert(dim(spark, [(None, "null again")])).updated == 1


def test_seed_keeps_what_is_there_and_writes_nothing_for_it(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir + "/t", ["code"], buckets=4)
    t.insert_if_absent(dim(spark, [("A", "a"), ("B", "b")]))
    before = files(t.path)
    assert t.insert_if_absent(dim(spark, [("A", "x")])).inserted == 0 and files(t.path) == before
    assert t.insert_if_absent(dim(spark, [("A", "x"), ("C", "c")])).inserted == 1
    assert {r.code: r.name for r in t.read().collect()} == {"A": "a", "B": "b", "C": "c"}


def test_replace_delete_and_empty(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir + "/t", ["code"], buckets=4)
    t.upsert(dim(spark, [("A", "a"), ("B", "b"), ("C", "c")]))
    gone = spark.createDataFrame([("A", None, True), ("D", "d", False), ("E", None, True)], "code string, name string, gone boolean")
    done = t.upsert(gone, removed="gone")
    assert (done.inserted, done.updated, done.deleted) == (1, 0, 1)
    assert sorted(r.code for r in t.read().collect()) == ["B", "C", "D"]
    assert t.replace(dim(spark, [("B", "z")])).deleted == 2
    assert [tuple(r) for r in t.read().collect()] == [("B", "z")]
    t.replace(dim(spark, []))
    assert t.read().count() == 0 and files(t.path) == []
    assert t.upsert(dim(spark, [])).inserted == 0


def test_counts_without_an_observation(spark, tmp_dir, monkeypatch):
    """Where nothing is left to write, Spark may drop the part of the plan that observes the counts."""
    from py4j.protocol import Py4JJavaError
    from railpulse.sinks import keyed_table

    t = KeyedTable(spark, tmp_dir + "/t", ["code"], buckets=4)
    t.upsert(dim(spark, [("A", "a"), ("B", "b")]))

    def lost(self):
        raise Py4JJavaError("no metrics", type("E", (), {"_target_id": "o1"})())

    monkeypatch.setattr(keyed_table.Observation, "get", property(lost))
    done = t.upsert(dim(spark, [("B", "z"), ("C", "c")]))
    assert (done.inserted, done.updated, done.deleted) == (1, 1, 0)
    assert t.replace(dim(spark, [])).deleted == 3
    assert t.read().count() == 0


def test_two_rows_of_a_key_and_other_columns_are_errors(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir + "/t", ["code"], buckets=4)
    t.upsert(dim(spark, [("A", "a")]))
    before = files(t.path)
    with pytest.raises(ValueError):
        t.upsert(dim(spark, [("B", "1"), ("B", "2")]))
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([("A", 1)], "code string, size int"))
    assert files(t.path) == before and json.loads(json.dumps([tuple(r) for r in t.read().collect()])) == [["A", "a"]]


# ----------------------------------------------------------------- the latest row as a stream
def test_latest_as_a_stream_with_late_rows(spark, tmp_dir):
    """After every batch the view equals the batch job over all rows so far; the state holds the window's trains only."""
    rng = random.Random(4)
    batches, t = [], 0
    for _ in range(5):
        t += rng.choice([30, 60, 200])
        rows = []
        for train in rng.sample(range(14), 8):
            late = rng.choice([0, 0, 0, 30, 110, 119.999, 120, 120.001, 400])  # behind the newest poll
            rows.append((f"T{train}", rng.choice(["N", "V", None]), rng.choice(["-", "due", "0:30", "12:00", "x", None]), t - late))
        rows += rows[:2]
        batches.append(rows)
    base = 0
    for k, rows in enumerate(batches):
        df = facts(spark, rows).coalesce(1).withColumn("id", F.when(F.rand(k) < 0.9, F.monotonically_increasing_id() + base))
        df.select(*TRAIN_POSITIONS.fieldNames()).write.parquet(f"{tmp_dir}/rows/b={k}")
        base += 100
    view, ck, seen = f"{tmp_dir}/view", f"{tmp_dir}/ck", []
    for k in range(len(batches)):
        os.makedirs(f"{tmp_dir}/in", exist_ok=True)
        src = spark.readStream.schema(TRAIN_POSITIONS).parquet(f"{tmp_dir}/in")
        for f in os.listdir(f"{tmp_dir}/rows/b={k}"):
            if f.endswith(".parquet"):
                with open(f"{tmp_dir}/rows/b={k}/{f}", "rb") as a, open(f"{tmp_dir}/in/{k}-{f}", "wb") as b:
                    b.write(a.read())
        q = SL.start_latest(src, view, ck, trigger=ONCE, buckets=4)
        q.awaitTermination(300)
        assert q.exception() is None
        seen.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
        so_far = spark.read.schema(TRAIN_POSITIONS).parquet(f"{tmp_dir}/in")
        expect = L.latest_positions(so_far)
        assert sorted(map(str, SL.view(spark, view).collect())) == sorted(map(str, expect.collect())), k
        # what has left the window has left the table, too
        assert KeyedTable(spark, view, SL.KEYS).read().count() <= expect.count() + len({r[:2] for r in batches[k]})
    ever = len({r[:2] for rows in batches for r in rows})
    assert ever > 15 and max(seen) > 0
