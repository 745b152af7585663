"""Dimension builds: stations, edges, segment travel times and their checks.

All inputs are flat DataFrames carrying explicit input ordinals (document,
sequence and position numbers).  "First occurrence" rules therefore never
depend on DataFrame order: they are ``min`` over an ordinal struct, which
Spark aggregates partially on the map side.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import (ADJACENCY_LINE_CODE_MAP, DEFAULT_TRAVEL_TIME_SECONDS,
                                           MAX_CODE_LEN, MAX_NAME_LEN, STATION_LINE_CODE_MAP)
from railpulse.functions.text import js_trim
from railpulse.operators.fold import halving_fold
from railpulse.session import materialize


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def _truthy_num(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the smallest ``order`` per key (partial aggregate, no window)."""
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in
                                                 enumerate(order)],
                                               *[F.col(c) for c in payload])).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in payload])


# --------------------------------------------------------------------------- C18 / C24
def parse_stop_points(stop_points: DataFrame, line_map=STATION_LINE_CODE_MAP) -> DataFrame:
    """Stop points -> candidate stations (before the first-per-code dedup).

    Keeps ``doc_idx``/``sp_idx`` ordinals.  Drops points with a missing/zero
    coordinate and points that serve no mapped line.
    """
    m = _map(line_map)
    code = F.coalesce(F.when(F.col("stationNaptan") != "", F.col("stationNaptan")),
                      F.col("naptanId"), F.lit(""))
    name = js_trim(F.replace(F.coalesce(F.col("commonName"), F.lit("")),
                             F.lit(" Underground Station"), F.lit("")))
    tube = F.filter(F.coalesce(F.col("lineModeGroups"), F.array()),
                    lambda g: g["modeName"] == "tube")
    from_groups = F.flatten(F.transform(tube, lambda g: F.transform(
        F.filter(F.coalesce(g["lineIdentifier"], F.array()),
                 lambda i: F.map_contains_key(m, i)), lambda i: m[i])))
    from_lines = F.transform(F.filter(F.coalesce(F.col("lines"), F.array()),
                                      lambda x: F.map_contains_key(m, x["id"])),
                             lambda x: m[x["id"]])
    lines = F.concat(from_groups, F.array_except(from_lines, from_groups))
    out = stop_points.select(
        "doc_idx", "sp_idx", code.alias("code"), name.alias("name"),
        F.col("lat"), F.col("lon").alias("lng"), lines.alias("lines"))
    return out.filter(_truthy_num(F.col("lat")) & _truthy_num(F.col("lng"))
                      & (F.size("lines") > 0))


def build_stations(stop_points: DataFrame, line_map=STATION_LINE_CODE_MAP) -> DataFrame:
    """First candidate per code in input order, with WKT location text."""
    cand = parse_stop_points(stop_points, line_map)
    first = first_per_key(cand, ["code"], ["doc_idx", "sp_idx"])
    return first.select(
        "code", "name", "lat", "lng", "lines",
        F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "),
                 F.col("lat").cast("string"), F.lit(")")).alias("location_wkt"))


def station_issues(candidates: DataFrame) -> DataFrame:
    """C24 issue rows: code too long, name too long, missing code."""
    cl = F.length(F.coalesce(F.col("code"), F.lit("")))
    nl = F.length(F.coalesce(F.col("name"), F.lit("")))
    issues = F.array(
        F.when(cl > MAX_CODE_LEN, F.struct(F.lit("code_too_long").alias("issue"),
                                            cl.alias("length"))),
        F.when(nl > MAX_NAME_LEN, F.struct(F.lit("name_too_long").alias("issue"),
                                            nl.alias("length"))),
        F.when(cl == 0, F.struct(F.lit("missing_code").alias("issue"), F.lit(0).alias("length"))),
    )
    return (candidates.select("doc_idx", "sp_idx", "code", "name",
                              F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i"))
            .select("doc_idx", "sp_idx", "code", "name", F.col("i.issue").alias("issue"),
                    F.col("i.length").cast("bigint").alias("length")))


def station_quality(candidates: DataFrame) -> DataFrame:
    """C24 summary: max lengths and issue counts in one aggregate."""
    cl = F.length(F.coalesce(F.col("code"), F.lit("")))
    nl = F.length(F.coalesce(F.col("name"), F.lit("")))
    return candidates.agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.coalesce(F.max(cl), F.lit(0)).cast("bigint").alias("max_code_len"),
        F.coalesce(F.max(nl), F.lit(0)).cast("bigint").alias("max_name_len"),
        F.count_if(cl > MAX_CODE_LEN).alias("n_code_too_long"),
        F.count_if(nl > MAX_NAME_LEN).alias("n_name_too_long"),
        F.count_if(cl == 0).alias("n_missing_code"),
    ).withColumn("valid", (F.col("n_code_too_long") + F.col("n_name_too_long")
                           + F.col("n_missing_code")) == 0)


# --------------------------------------------------------------------------- C19
def build_edges(stops: DataFrame, line_map: DataFrame, paired: bool = False) -> DataFrame:
    """Route stops -> deduplicated edges.

    ``stops``: line_id, seq_no, pos, stationId, id, lat, lon (one row per
    stop of a sequence; lines whose route list is empty have no rows), and
    line_code if they have it.
    ``line_map``: line_id, line_code, line_rank (processing order of ids).

    1. stop code = first non-empty of stationId, id; code-less stops skipped
    2. consecutive pairs per sequence (``lead``), ``i`` = index of the from-stop
    3. first occurrence of each unordered pair per line id (by seq, i)
    4. first occurrence of each directed pair per line code (by line order)
    5. pairs with a missing/zero coordinate are dropped (after the dedup)

    The pairs are dealt once, by line code and unordered pair, which serves both dedups; the
    line map, a small table, is stored first, so that its size decides how it is joined.
    ``paired`` keeps the unordered pair as ``pa`` and ``pb``, so that a join on them and the
    line needs no other dealing.  Keys that tell rows apart by their beginning come first in
    windows and groups, as sorts compare that first.
    """
    code = F.coalesce(F.when(F.col("stationId") != "", F.col("stationId")),
                      F.when(F.col("id") != "", F.col("id")))
    # stops that carry their line's code, which the id implies, are often dealt by it and the
    # sequence already; named here, that dealing serves the window, too
    seq = ["seq_no", "line_id", *(["line_code"] if "line_code" in stops.columns else [])]
    s = stops.select(*seq, "pos", code.alias("code"), "lat", "lon"
                     ).filter(F.col("code").isNotNull())
    w = Window.partitionBy(*seq).orderBy("pos")
    s = s.select(
        "line_id", "seq_no", (F.row_number().over(w) - 1).alias("i"),
        F.col("code").alias("from_code"), F.col("lat").alias("from_lat"),
        F.col("lon").alias("from_lng"),
        F.lead("code").over(w).alias("to_code"), F.lead("lat").over(w).alias("to_lat"),
        F.lead("lon").over(w).alias("to_lng"))
    pairs = s.filter(F.col("to_code").isNotNull()).withColumns({
        "pa": F.least("from_code", "to_code"), "pb": F.greatest("from_code", "to_code")})
    lines = materialize(line_map.select("line_id", "line_code", "line_rank"), "line-map")
    pairs = pairs.join(lines, "line_id").repartition("line_code", "pa", "pb")
    per_id = first_per_key(pairs, ["pa", "pb", "line_id", "line_code", "line_rank"], ["seq_no", "i"])
    per_code = first_per_key(per_id, ["pa", "pb", "from_code", "to_code", "line_code"],
                             ["line_rank", "seq_no", "i"])
    pair = ["pa", "pb"] if paired else []
    geo = (_truthy_num(F.col("from_lat")) & _truthy_num(F.col("from_lng"))
           & _truthy_num(F.col("to_lat")) & _truthy_num(F.col("to_lng")))
    return per_code.filter(geo).select(
        "line_code", "from_code", "to_code", F.col("i").cast("int").alias("sequence_order"),
        "from_lat", "from_lng", "to_lat", "to_lng",
        F.lit(None).cast("int").alias("travel_time_seconds"), *pair)


def adjacency_lines(spark: SparkSession, pairs=ADJACENCY_LINE_CODE_MAP) -> DataFrame:
    """Line ids of the edge build with their codes, in processing order; ``circle`` belongs to H."""
    return spark.createDataFrame([(i, c, k) for k, (i, c) in enumerate(pairs, 1)],
                                 "line_id string, line_code string, line_rank int")


def with_geometry(edges: DataFrame) -> DataFrame:
    """edges with ``segment_geometry``, a LINESTRING in text form (longitude first), null without all four coordinates."""
    corner = lambda e: F.concat_ws(" ", F.col(f"{e}_lng").cast("string"), F.col(f"{e}_lat").cast("string"))
    there = [_truthy_num(F.col(f"{e}_{c}")) for e in ("from", "to") for c in ("lng", "lat")]
    text = F.concat(F.lit("LINESTRING("), corner("from"), F.lit(", "), corner("to"), F.lit(")"))
    return edges.withColumn("segment_geometry", F.when(there[0] & there[1] & there[2] & there[3], text))


def terminals(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Distinct (line, station code, name) starting a route branch."""
    t = edges.filter(F.col("sequence_order") == 0).select("line_code", "from_code")
    return (t.join(stations.select(F.col("code").alias("from_code"), "name"), "from_code")
            .select("line_code", F.col("from_code").alias("code"), "name").distinct())


def terminals_per_line(term: DataFrame) -> DataFrame:
    """A5: terminals per line (count and first/last code; members stay as rows)."""
    return term.groupBy("line_code").agg(
        F.count(F.lit(1)).alias("n_terminals"),
        F.min("code").alias("first_terminal"), F.max("code").alias("last_terminal"))


# --------------------------------------------------------------------------- C20
def segment_times(intervals: DataFrame) -> DataFrame:
    """C20: cumulative timetable minutes -> folded seconds per directed pair and line.

    ``intervals``: line_code, departure, route_idx, set_idx, interval_idx,
    stop_id, time_to_arrival.  One timetable = (line_code, departure).

    Per interval set the previous stop starts at the departure and the
    previous cumulative value at 0.0; both advance even when a segment is
    rejected.  Segments need both stop ids and a positive length; seconds
    are rounded half-to-even.  The fold ``(acc + x) div 2`` runs first per
    timetable (in interval order), then across the line's timetables (in
    departure order).  ``first_seen`` orders pairs by first appearance.
    """
    w = Window.partitionBy("line_code", "departure", "route_idx", "set_idx"
                           ).orderBy("interval_idx")
    stop = F.coalesce(F.col("stop_id"), F.lit(""))
    cum = F.coalesce(F.col("time_to_arrival"), F.lit(0.0))
    seg = intervals.select(
        "line_code", "departure", "route_idx", "set_idx", "interval_idx",
        F.lag(stop, 1, None).over(w).alias("_prev"), stop.alias("to_code"),
        (cum - F.lag(cum, 1, 0.0).over(w)).alias("minutes"))
    seg = seg.withColumn("from_code", F.coalesce(F.col("_prev"), F.coalesce(
        F.col("departure"), F.lit(""))))
    seg = seg.filter((F.col("to_code") != "") & (F.col("from_code") != "")
                     & (F.col("minutes") > 0))
    seg = seg.withColumn("seconds", F.bround(F.col("minutes") * 60, 0).cast("long"))
    per_tt = halving_fold(
        seg, ["line_code", "departure", "from_code", "to_code"],
        ["route_idx", "set_idx", "interval_idx"], "seconds", "tt_seconds",
        extra_aggs=(F.min(F.struct("route_idx", "set_idx", "interval_idx")).alias("tt_first"),))
    per_line = halving_fold(
        per_tt, ["line_code", "from_code", "to_code"], ["departure"], "tt_seconds", "seconds",
        extra_aggs=(F.min(F.struct("departure", "tt_first")).alias("first_seen"),))
    return per_line.select("line_code", "from_code", "to_code",
                           F.col("seconds").cast("int").alias("seconds"), "first_seen")


# --------------------------------------------------------------------------- C21 / C22
def _pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"pa": F.least(a, b), "pb": F.greatest(a, b)})


def apply_times(edges: DataFrame, times: DataFrame) -> DataFrame:
    """C21+C22: set travel times on edges matched in either direction, then default 120.

    When both directions of a pair are timed, the direction seen later wins
    (it is applied last), which is ``max_by(seconds, first_seen)``.
    """
    t = (_pair_key(times, "from_code", "to_code").groupBy("line_code", "pa", "pb")
         .agg(F.max_by("seconds", "first_seen").alias("_tt")))
    e = edges if "pa" in edges.columns else _pair_key(edges, "from_code", "to_code")
    return e.join(t, ["line_code", "pa", "pb"], "left").select(
        "line_code", "from_code", "to_code", "sequence_order", "from_lat", "from_lng",
        "to_lat", "to_lng",
        F.coalesce(F.col("_tt"), F.col("travel_time_seconds"),
                   F.lit(DEFAULT_TRAVEL_TIME_SECONDS)).cast("int").alias("travel_time_seconds"),
        F.col("_tt").isNotNull().alias("timed"))


def apply_times_counted(edges: DataFrame, times: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``apply_times``, stored, and what the writing pass counted on its way.

    ``updated``: rows affected by the updates, one update for each timed direction of a pair, so
    an edge whose pair is timed both ways counts twice; ``defaulted``: rows that got the
    default; ``edges``: all rows.
    """
    both = _pair_key(times, "from_code", "to_code").groupBy("line_code", "pa", "pb").agg(
        F.count(F.lit(1)).alias("_updates"))
    applied = _pair_key(apply_times(edges, times), "from_code", "to_code").join(
        both, ["line_code", "pa", "pb"], "left")
    seen = Observation()
    applied = applied.observe(
        seen, F.coalesce(F.sum("_updates"), F.lit(0)).alias("updated"),
        F.count_if(~F.col("timed")).alias("defaulted"), F.count(F.lit(1)).alias("edges"))
    stored = materialize(applied.drop("pa", "pb", "_updates"), "applied-times")
    return stored, seen.get


def unmatched_times(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Timed pairs with no edge in either direction on their line."""
    e = _pair_key(edges, "from_code", "to_code").select("line_code", "pa", "pb").distinct()
    t = _pair_key(times, "from_code", "to_code")
    return t.join(e, ["line_code", "pa", "pb"], "left_anti").select(
        "line_code", "from_code", "to_code", "seconds", "first_seen")


def unmatched_report(unmatched: DataFrame, n: int = 20) -> DataFrame:
    """O3: the first ``n`` unmatched segments in processing order."""
    return unmatched.orderBy("line_code", "first_seen").limit(n).select(
        "line_code", "from_code", "to_code", "seconds")


def timed_edges(stops: DataFrame, line_map: DataFrame, intervals: DataFrame) -> DataFrame:
    """Edge dimension as served: C19 edges with C20/C21/C22 travel times."""
    return apply_times(build_edges(stops, line_map, paired=True), segment_times(intervals)).drop("timed")


# --------------------------------------------------------------------------- sinks-as-joins
def upsert(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Insert new keys, replace all columns of existing keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Seed rows are added only where the key is absent."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def fk_violations(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges whose line is missing, duplicate keys, NULL required columns."""
    fk = (edges.join(lines.select(F.col("code").alias("line_code")), "line_code", "left_anti")
          .select(F.lit("missing_line").alias("violation"), "line_code", "from_code",
                  "to_code"))
    dup = (edges.groupBy("line_code", "from_code", "to_code").count()
           .filter(F.col("count") > 1)
           .select(F.lit("duplicate_key").alias("violation"), "line_code", "from_code",
                   "to_code"))
    nulls = edges.filter(F.col("line_code").isNull() | F.col("from_code").isNull()
                         | F.col("to_code").isNull() | F.col("sequence_order").isNull()).select(
        F.lit("null_required").alias("violation"), "line_code", "from_code", "to_code")
    return fk.unionByName(dup).unionByName(nulls)
