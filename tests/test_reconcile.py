"""The batch fold and the stream against the client's poll loop, written out here on its own
(a map of trains; each poll builds a new one and carries over what was seen less than 90 s ago)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from railpulse.operators import reconciliation as R
from railpulse.operators import trajectory
from railpulse.streaming import state

T0 = 1_700_000_000_000
SHOWN = ("from_lat", "from_lng", "to_lat", "to_lng", "eta_s", "data_ts_ms", "pred_lat", "pred_lng", "pred_tt")


def _obs(key, t, station, eta, lat=51.5, lng=-0.1, to=(51.6, -0.2), pred=(None, None, None), line="N"):
    ms = T0 + round(t * 1000)
    return {"set_number": key, "line_code": line, "station_name": station,
            "from_lat": lat, "from_lng": lng, "to_lat": to[0], "to_lng": to[1],
            "eta_s": eta, "data_ts_ms": ms, "pred_lat": pred[0],
            "pred_lng": pred[1], "pred_tt": pred[2], "now_ms": ms}


OBS = [
    _obs("A", 0, "X", 100.0), _obs("A", 30, "X", 75.0),       # shift 5 s -> keep
    _obs("A", 60, "X", 10.0),                                   # shift 40 s -> re-anchor
    _obs("A", 90, "Y", None, pred=(51.7, -0.3, 90.0)),          # station change, no ETA
    _obs("A", 120, "Y", 30.0),                                  # previous ETA missing -> replace
    _obs("B", 0, "Z", 50.0), _obs("B", 30, "Z", 25.0),
    _obs("B", 150, "Z", 40.0),                                  # polls at 60, 90, 120: gone at 120
    _obs("C", 0, "Q", 60.0), _obs("C", 60, "Q", 45.0),          # absent at 30 s only -> kept
    _obs("D", 30, "W", 20.0), _obs("D", 60, "W", 0.0), _obs("D", 90, "W", 200.0),
]


def replay(obs, ttl_ms=90_000):
    """Last state of every train ever shown, and the polls at which one was dropped."""
    shown, ever, dropped = {}, {}, []
    for now in sorted({o["now_ms"] for o in obs}):
        fresh = {}
        for o in (o for o in obs if o["now_ms"] == now):
            k = (o["set_number"], o["line_code"])
            old = shown.get(k)
            t = {f: o[f] for f in SHOWN} | {"station": o["station_name"], "seen": now, "moves": 0}
            if old and old["station"] == o["station_name"] and old["eta_s"] is not None and o["eta_s"] is not None:
                was, will = old["data_ts_ms"] + old["eta_s"] * 1000, o["data_ts_ms"] + o["eta_s"] * 1000
                common = {f: o[f] for f in ("pred_lat", "pred_lng", "pred_tt")} | {"seen": now}
                if abs(will - was) < 20_000:
                    t = old | common
                else:
                    lat, lng = old["from_lat"], old["from_lng"]
                    if old["to_lat"] is not None and old["to_lng"] is not None and old["eta_s"] > 0:
                        part = min(1.0, max(0.0, (now - old["data_ts_ms"]) / 1000.0) / old["eta_s"])
                        lat, lng = lat + (old["to_lat"] - lat) * part, lng + (old["to_lng"] - lng) * part
                    t = old | common | {"from_lat": lat, "from_lng": lng, "to_lat": o["to_lat"], "to_lng": o["to_lng"],
                                        "data_ts_ms": now, "eta_s": max(0.0, (will - now) / 1000.0), "moves": old["moves"] + 1}
            fresh[k] = ever[k] = t
        for k, t in shown.items():
            if k not in fresh:
                if now - t["seen"] < ttl_ms:
                    fresh[k] = t
                else:
                    dropped.append((k, now))
        shown = fresh
    return ever, dropped


def _close(a, b):
    if R.absent(a):
        return R.absent(b)
    return not R.absent(b) and abs(a - b) < 1e-9


def _frame(spark, obs):
    schema = ("set_number string, line_code string, station_name string, from_lat double, from_lng double, to_lat double, "
              "to_lng double, eta_s double, data_ts_ms long, pred_lat double, pred_lng double, pred_tt double, now_ms long")
    rows = [tuple(o[f.split()[0]] for f in schema.split(", ")) for o in obs]
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("now_ms").cast("timestamp_ntz"))


def _batch(spark, obs):
    return {(r.set_number, r.line_code): r.asDict() for r in trajectory.reconcile(_frame(spark, obs)).collect()}


def _same(got, ever):
    assert set(got) == set(ever)
    for k, t in ever.items():
        for f in SHOWN:
            assert _close(t[f], got[k][f]), (k, f, t[f], got[k][f])
        assert (got[k]["station_name"], got[k]["reanchors"]) == (t["station"], t["moves"]), k


def _random(seed, trains=30, polls=60, hot=None):
    rng, out = random.Random(seed), []
    times = [0.0]
    while len(times) < polls:
        times.append(times[-1] + rng.choice([10, 30, 30, 30, 89.999, 90, 90.001]))
    for n in range(trains):
        key, line = (str(n), rng.choice(["N", "V", None]))
        station, eta = "S0", 60.0
        for t in times:
            if rng.random() < (0.0 if n == hot else 0.25):
                continue
            if n != hot and rng.random() < 0.15:
                station = f"S{rng.randrange(4)}"
            eta = None if n != hot and rng.random() < 0.1 else rng.choice([5.0, 30.0, 60.0, 61.5, 300.0])
            to = (None, None) if rng.random() < 0.1 else (51.6 + rng.random(), -0.2)
            out.append(_obs(key, t, station, eta, lat=51 + rng.random(), to=to, line=line, pred=(51.7, -0.3, rng.choice([None, 90.0]))))
    return out


def test_batch_matches_the_poll_loop(spark):
    ever, _ = replay(OBS)
    got = _batch(spark, OBS)
    _same(got, ever)
    assert got[("A", "N")]["reanchors"] == 0   # the last trajectory starts at the replacement
    assert got[("D", "N")]["reanchors"] == 1   # t=60 keeps (10 s shift), t=90 re-anchors


def test_batch_over_many_partitions(spark):
    """Trains cut by several borders, one without any replacement over all of them."""
    obs = _random(3, trains=6, polls=120, hot=2)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        polls = trajectory.previous_polls(_frame(spark, obs)).orderBy("ts").collect()
        assert [r.prev_poll for r in polls] == [None, *(r.ts for r in polls[:-1])]
        _same(_batch(spark, obs), replay(obs)[0])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_matches_on_random_polls(spark, seed):
    obs = _random(seed)
    _same(_batch(spark, obs), replay(obs)[0])


def test_no_observations(spark):
    assert _batch(spark, []) == {}


def _merge(st, o, prev=None):
    return R.transition(st, o | {"prev_ms": prev})


def test_keep_and_reanchor_thresholds():
    st = _merge(None, _obs("A", 0, "X", 100.0))
    kept = _merge(st, _obs("A", 30, "X", 89.999))   # shift 19.999 s
    assert kept["data_ts_ms"] == T0 and kept["reanchors"] == 0
    moved = _merge(st, _obs("A", 30, "X", 90.0))    # shift 20 s
    assert moved["data_ts_ms"] == T0 + 30_000 and moved["reanchors"] == 1
    # dead-reckoned from 30 % of the way
    assert abs(moved["from_lat"] - (51.5 + 0.1 * 0.3)) < 1e-12


def test_dwell_cap():
    st = _merge(None, _obs("A", 0, "X", None, pred=(52.5, -0.1, 100.0)))
    assert R.dead_reckon(st, T0 + 30_000) == (51.5, -0.1)          # still dwelling
    lat, _ = R.dead_reckon(st, T0 + 30_000 + 1_000_000)             # long after: capped
    assert abs(lat - (51.5 + 1.0 * 0.35)) < 1e-12


# ----------------------------------------------------------------- the stream
def _stream(spark, folder, obs, polls_per_batch=1):
    """All output rows of the stream, in order; each file holds one poll."""
    times = sorted({o["now_ms"] for o in obs})
    before = dict(zip(times[1:], times))
    schema = _frame(spark, obs[:1]).withColumn("prev_ms", F.lit(0).cast("long")).schema
    for i, t in enumerate(times):
        part = _frame(spark, [o for o in obs if o["now_ms"] == t]).withColumn("prev_ms", F.lit(before.get(t)).cast("long"))
        part.coalesce(1).write.parquet(os.path.join(folder, "obs", f"poll={i:03d}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", polls_per_batch).parquet(folder + "/obs/*")
    rows = []
    q = (state.reconcile_stream(src).writeStream.outputMode("update").trigger(availableNow=True)
         .foreachBatch(lambda b, i: rows.extend((i, r.asDict()) for r in b.collect()))
         .option("checkpointLocation", os.path.join(folder, "ck")).start())
    q.awaitTermination(400)
    assert not q.isActive and q.exception() is None
    return rows


@pytest.mark.parametrize("polls_per_batch", [1, 3])
def test_stream_matches_the_poll_loop(spark, tmp_dir, polls_per_batch):
    ever, _ = replay(OBS)
    rows = [r for _, r in _stream(spark, tmp_dir, OBS, polls_per_batch) if not r["removed"]]
    _same({(r["set_number"], r["line_code"]): r for r in rows}, ever)


@pytest.mark.parametrize("gap,gone", [(89.999, False), (90.0, True)])
def test_stream_and_batch_agree_at_the_ttl(spark, tmp_dir, gap, gone):
    # E is absent at the poll ``gap`` seconds after it was seen and comes back 5 s later
    obs = [_obs("E", 0, "X", 200.0), _obs("F", 0, "X", 10.0), _obs("F", gap, "X", 10.0), _obs("E", gap + 5, "X", 100.0), _obs("F", gap + 5, "X", 10.0)]
    ever, dropped = replay(obs)
    assert bool(dropped) == gone
    _same(_batch(spark, obs), ever)
    out = _stream(spark, tmp_dir, obs)
    removed = [(r["set_number"], r["line_code"]) for _, r in out if r["removed"]]
    _same({(r["set_number"], r["line_code"]): r for _, r in out if not r["removed"]}, ever)
    # the poll that finds E absent raises the watermark; E is back in the very next batch, as a new train
    assert ever["E", "N"]["moves"] == (0 if gone else ever["E", "N"]["moves"])
    assert removed == []


@pytest.mark.parametrize("last,gone", [(89.999, False), (90.0, True)])
def test_an_absent_train_is_removed_by_poll_time(spark, tmp_dir, last, gone):
    obs = [_obs("E", 0, "X", 200.0), _obs("F", 0, "X", 10.0), _obs("F", last, "X", 10.0)]
    removed = [(r["set_number"], r["last_seen_ms"]) for _, r in _stream(spark, tmp_dir, obs) if r["removed"]]
    assert removed == ([("E", T0)] if gone else [])
    assert [k[0] for k, _ in replay(obs)[1]] == (["E"] if gone else [])


def test_an_old_poll_changes_nothing(spark, tmp_dir):
    schema = _frame(spark, OBS[:1]).withColumn("prev_ms", F.lit(0).cast("long")).schema
    for i, o in enumerate([_obs("A", 60, "X", 50.0), _obs("A", 0, "Y", 10.0), _obs("A", 90, "X", 20.0)]):
        part = _frame(spark, [o]).withColumn("prev_ms", F.lit(None).cast("long"))
        part.coalesce(1).write.parquet(os.path.join(tmp_dir, "obs", f"n={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(tmp_dir + "/obs/*")
    rows = []
    q = (state.reconcile_stream(src).writeStream.outputMode("update").trigger(availableNow=True)
         .foreachBatch(lambda b, i: rows.extend(r.asDict() for r in b.collect()))
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    q.awaitTermination(400)
    assert [(r["station_name"], r["data_ts_ms"]) for r in rows] == [("X", T0 + 60_000), ("X", T0 + 60_000)]
