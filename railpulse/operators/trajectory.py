"""Positions between polls (C14) and per-train ETA reconciliation (C15, batch).

C14 evaluates the dead-reckoning rule on a time grid: ``explode(sequence)``
per feature row, then arithmetic only.

C15 is a genuine state machine: a new observation either keeps the old
trajectory (same station, ETA moved < 20 s), re-anchors it at the position
reached "now", or replaces it (first sighting, station changed, an ETA
missing, or a poll in between found the key absent for 90 s).

Rows are dealt by ranges of (train, time) and every partition is folded in order, row
by row, with one state in memory: a train of any length lies in as many partitions
as it needs and is never gathered.  A partition also says where its first fold of a
train began and whether that train was replaced later on in it.  Only a train cut by a
partition border is looked at again: if it was replaced behind the border, by the
observations around it or in the partition, the partition's own fold stands; else
that partition's rows of that train are folded once more from the state before the
border, all such trains of one wave in one job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import (DEFAULT_TRAVEL_TIME_SECONDS, PLATFORM_DWELL_S,
                                           PREDICTED_DEPARTURE_CAP, TRAIN_RETENTION_S)
from railpulse.operators.reconciliation import FIELDS, replaces, transition
from railpulse.session import materialize


def _epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


# --------------------------------------------------------------------------- C14
def dead_reckon(from_lat, from_lng, to_lat, to_lng, eta_s, pred_lat, pred_lng, pred_tt,
                elapsed_s: Column) -> tuple[Column, Column]:
    """Position ``elapsed_s`` seconds after the data timestamp."""
    moving = to_lat.isNotNull() & to_lng.isNotNull() & eta_s.isNotNull() & (eta_s > 0)
    f_move = F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed_s) / eta_s)
    dwell = eta_s.isNull() & pred_lat.isNotNull() & pred_lng.isNotNull() & (
        elapsed_s > PLATFORM_DWELL_S)
    tt = F.coalesce(pred_tt.cast("double"), F.lit(float(DEFAULT_TRAVEL_TIME_SECONDS)))
    f_dep = F.least(F.lit(PREDICTED_DEPARTURE_CAP), (elapsed_s - PLATFORM_DWELL_S) / tt)
    lat = (F.when(moving, from_lat + (to_lat - from_lat) * f_move)
           .when(dwell, from_lat + (pred_lat - from_lat) * f_dep).otherwise(from_lat))
    lng = (F.when(moving, from_lng + (to_lng - from_lng) * f_move)
           .when(dwell, from_lng + (pred_lng - from_lng) * f_dep).otherwise(from_lng))
    return lat, lng


def trajectory(features: DataFrame, step_s: int = 10, horizon_s: int = 120) -> DataFrame:
    """One row per feature and grid offset: set_number, line_code, offset_s, lat, lng."""
    g = features.withColumn("offset_s", F.explode(F.sequence(F.lit(0), F.lit(horizon_s),
                                                             F.lit(step_s))))
    lat, lng = dead_reckon(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"),
                           F.col("to_lng"), F.col("time_to_station_seconds").cast("double"),
                           F.col("predicted_next_lat"), F.col("predicted_next_lng"),
                           F.col("predicted_travel_time"), F.col("offset_s").cast("double"))
    return g.select("id", "set_number", "line_code", F.col("offset_s").cast("int"),
                    lat.alias("traj_lat"),
                    lng.alias("traj_lng"))


# --------------------------------------------------------------------------- C15
def observations(positions: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Train positions -> one observation per (train, poll) in the fold's schema."""
    return positions.select(
        "set_number", "line_code", F.col(ts_col).alias("ts"), "station_name",
        F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"), "to_lat", "to_lng",
        F.col("time_to_station_seconds").alias("eta_s"),
        _epoch_ms(F.col(ts_col)).alias("data_ts_ms"),
        F.col("predicted_next_lat").alias("pred_lat"),
        F.col("predicted_next_lng").alias("pred_lng"),
        F.col("predicted_travel_time").alias("pred_tt"),
        _epoch_ms(F.col(ts_col)).alias("now_ms"))


def previous_polls(polls: DataFrame, ts: str = "ts") -> DataFrame:
    """Every distinct poll time with the one before it (null for the first).

    Times are dealt by ranges; a range looks back within itself, and its first time takes
    the greatest time of the ranges before (as many rows as there are ranges).
    """
    dealt = materialize(polls.select(ts).distinct().repartitionByRange(ts).withColumn(
        "_part", F.spark_partition_id()), "polls")
    tops = dealt.groupBy("_part").agg(F.max(ts).alias("top")).orderBy("_part").collect()
    before = [(r["_part"], tops[k - 1]["top"] if k else None) for k, r in enumerate(tops)]
    borders = polls.sparkSession.createDataFrame(
        before, f"_part int, _before {dict(polls.dtypes)[ts]}")
    own = F.lag(ts).over(Window.partitionBy("_part").orderBy(ts))
    return dealt.join(F.broadcast(borders), "_part").select(
        ts, F.coalesce(own, F.col("_before")).alias("prev_poll"))


_STATE_TYPES = ("from_lat double, from_lng double, to_lat double, to_lng double, eta_s double, "
                "data_ts_ms bigint, pred_lat double, pred_lng double, pred_tt double, "
                "station_name string, last_seen_ms bigint, reanchors int")
_PIECE = ("first_ms bigint, last_ms bigint, n_obs bigint, first_station string, first_eta double, "
          "first_prev_ms bigint, replaced boolean, last_station string, last_eta double, " + _STATE_TYPES)
_OBS = ["station_name", "from_lat", "from_lng", "to_lat", "to_lng", "eta_s", "data_ts_ms",
        "pred_lat", "pred_lng", "pred_tt", "now_ms", "prev_ms"]


def _pieces(keys: list[str], key_types: list[str], ttl_s: int, start: dict | None = None):
    """A fold over sorted rows: a piece (``_PIECE``) for each run of equal keys, from ``start``'s state if it has one."""

    def task(batches):
        key, state, piece = None, None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *_OBS)]
            for row in zip(*columns):
                k, o = row[:len(keys)], dict(zip(_OBS, row[len(keys):]))
                if piece is None or k != key:
                    if piece is not None:
                        done.append((*key, *piece.values(), *(state[f] for f in FIELDS)))
                    key, state = k, (start or {}).get(k)
                    piece = {"first_ms": o["now_ms"], "last_ms": None, "n_obs": 0,
                             "first_station": o["station_name"], "first_eta": o["eta_s"],
                             "first_prev_ms": o["prev_ms"], "replaced": False,
                             "last_station": None, "last_eta": None}
                elif replaces(piece["last_ms"], piece["last_station"], piece["last_eta"], o, ttl_s):
                    piece["replaced"] = True
                state = transition(state, o, ttl_s)
                piece["n_obs"] += 1
                piece.update(last_ms=o["now_ms"], last_station=o["station_name"], last_eta=o["eta_s"])
            if done:
                yield _batch(done, batch.schema)
        if piece is not None:
            yield _batch([(*key, *piece.values(), *(state[f] for f in FIELDS))], batch.schema)

    def _batch(rows, like):
        types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
                 "boolean": pa.bool_(), "int": pa.int32()}
        fields = [(c, like.field(c).type) for c in keys]
        fields += [(f.split()[0], types[f.split()[1]]) for f in _PIECE.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return task, ", ".join(f"{c} {t}" for c, t in zip(keys, key_types)) + ", " + _PIECE


def reconcile(obs: DataFrame, keys=("set_number", "line_code"),
              ttl_s: int = TRAIN_RETENTION_S) -> DataFrame:
    """C15 batch: final reconciled state per train key.

    ``obs``: keys, ts, station_name, from/to lat/lng, eta_s, data_ts_ms,
    pred_lat/lng/tt, now_ms — one row per key and poll.  Null keys are keys.
    """
    keys, spark = list(keys), obs.sparkSession
    obs = materialize(obs, "observations")
    known = obs.join(previous_polls(obs), "ts").withColumns({
        "prev_ms": _epoch_ms(F.col("prev_poll")),
        **{c: F.col(c).cast("double") for c in ("from_lat", "from_lng", "to_lat", "to_lng", "eta_s",
                                                "pred_lat", "pred_lng", "pred_tt")},
        **{c: F.col(c).cast("bigint") for c in ("data_ts_ms", "now_ms")}})
    rows = materialize(known.select(*keys, *_OBS), "observed")
    types = [dict(rows.dtypes)[c] for c in keys]
    order = [*[F.col(c).asc_nulls_first() for c in keys], F.col("now_ms")]
    task, schema = _pieces(keys, types, ttl_s)
    pieces = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(task, schema), "reconciled-pieces")

    # at most two trains of a partition lie in others, too: so many rows come to the driver
    sizes = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pieces"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    counted = pieces.alias("p").join(sizes.alias("s"), same("p", "s")).select("p.*", "_pieces")
    whole = counted.where("_pieces = 1").drop("_pieces")
    cut: dict[tuple, list[dict]] = {}
    for r in counted.where("_pieces > 1").drop("_pieces").orderBy("first_ms").toLocalIterator():
        cut.setdefault(tuple(r[c] for c in keys), []).append(r.asDict())
    joined = _join_pieces(spark, rows, cut, keys, types, order, ttl_s)
    out = whole.unionByName(spark.createDataFrame(joined, whole.schema))
    return out.select(*keys, F.timestamp_millis("last_ms").cast("timestamp_ntz").alias("last_seen"),
                      "n_obs", *[f for f in FIELDS if f != "last_seen_ms"])


def _join_pieces(spark, rows: DataFrame, cut: dict[tuple, list[dict]], keys, types, order,
                 ttl_s: int) -> list[tuple]:
    """One piece for each train that lies in several partitions."""
    names = [f.split()[0] for f in _PIECE.split(", ")]
    have = {k: dict(ps[0]) for k, ps in cut.items()}
    rest = {k: ps[1:] for k, ps in cut.items()}
    while any(rest.values()):
        again: dict[tuple, dict] = {}
        for k, ps in rest.items():
            while ps:
                h, p = have[k], ps[0]
                first = {"station_name": p["first_station"], "eta_s": p["first_eta"], "prev_ms": p["first_prev_ms"]}
                if not p["replaced"] and not replaces(h["last_ms"], h["last_station"], h["last_eta"], first, ttl_s):
                    again[k] = p
                    break
                have[k] = {**h, **p, "first_ms": h["first_ms"], "n_obs": h["n_obs"] + p["n_obs"]}
                ps.pop(0)
        if again:  # this wave: these trains' next partition, from the state before it
            ranges = spark.createDataFrame(
                [(*k, p["first_ms"], p["last_ms"]) for k, p in again.items()],
                ", ".join(f"{c} {t}" for c, t in zip(keys, types)) + ", _a bigint, _b bigint")
            on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys]
            on += [F.col("r.now_ms").between(F.col("w._a"), F.col("w._b"))]
            part = rows.alias("r").join(F.broadcast(ranges.alias("w")), on).select("r.*")
            states = {k: {f: have[k][f] for f in FIELDS} for k in again}
            task, schema = _pieces(keys, types, ttl_s, states)
            folded = part.repartition(*keys).sortWithinPartitions(*order).mapInArrow(task, schema)
            for r in folded.collect():
                k = tuple(r[c] for c in keys)
                h, p = have[k], r.asDict()
                have[k] = {**h, **p, "first_ms": h["first_ms"], "n_obs": h["n_obs"] + p["n_obs"]}
                rest[k].pop(0)
    return [(*k, *(p[n] for n in names)) for k, p in have.items()]
