"""Positions for the latest rows: validation (C5), position (C7), cascade (C8),
next-station prediction (C9) and coverage diagnosis (C13).

Plan shape: names are resolved once per *distinct* string (C3); every row
then does a fixed number of equi-joins against small derived tables (the
resolved-name lookup, the line-station set, first neighbours per station,
facts per pair of stations and per-(station, destination) next-station argmins).  Rows
are never joined to whole neighbour lists, so the row count never grows.
Join strategy is left to Catalyst/AQE, which broadcasts a side only when its
measured size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.constants import (DEFAULT_FRACTION_APPROACHING,
                                           DEFAULT_FRACTION_BETWEEN, DEFAULT_FRACTION_LEFT,
                                           DEFAULT_TRAVEL_TIME_SECONDS)
from railpulse.functions.text import countdown_seconds, js_trim, strip_trailing_dot
from railpulse.operators import graph
from railpulse.operators.location import with_location
from railpulse.operators.names import resolve_names
from railpulse.session import materialize

ST = "struct<code:string,lat:double,lng:double>"


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _st(prefix: str) -> Column:
    return F.when(F.col(f"{prefix}.code").isNotNull(), F.col(prefix))


# --------------------------------------------------------------------------- names
def needed_names(df: DataFrame) -> DataFrame:
    """Every name the request resolves (station, destination, parsed names)."""
    sn = F.when(_truthy(F.col("station_name")), strip_trailing_dot("station_name"))
    dn = F.when(_truthy(F.col("destination")), strip_trailing_dot("destination"))
    arr = F.array(sn, dn, F.col("loc_station1"), F.col("loc_station2"))
    return (df.select(F.explode(arr).alias("name")).filter(F.col("name").isNotNull())
            .distinct())


def _station_struct(prefix: str = "") -> Column:
    return F.when(F.col(f"{prefix}code").isNotNull(), F.struct(
        F.col(f"{prefix}code").alias("code"), F.col(f"{prefix}lat").alias("lat"),
        F.col(f"{prefix}lng").alias("lng")))


def lookup_table(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """raw string -> (direct, resolved) station.

    ``direct`` is the resolution of the string itself when it is one of the
    needed names; ``resolved`` falls back to the dot-trimmed string.
    """
    raw = df.select(F.explode(F.array(
        F.col("loc_station1"), F.col("loc_station2"), F.col("station_name"),
        F.col("destination"), F.coalesce(strip_trailing_dot("station_name"), F.lit(""))
    )).alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    r = resolved.select(F.col("name"), _station_struct().alias("st"))
    direct = raw.join(r.withColumnRenamed("name", "raw").withColumnRenamed("st", "direct"),
                      "raw", "left")
    fb = r.withColumnRenamed("name", "_fk").withColumnRenamed("st", "_fb")
    out = direct.join(fb, strip_trailing_dot("raw") == F.col("_fk"), "left")
    return out.select("raw", "direct", F.coalesce("direct", "_fb").alias("resolved"))


#: What a row asks of the name lookup: the resolved station of its parsed, platform and destination names.
_ASKED = {"r1": "loc_station1", "r2": "loc_station2", "rp": "station_name", "rd": "destination",
          "rv": "_sn_key"}


def _resolve_rows(d: DataFrame, lk: DataFrame, ls: DataFrame | None) -> DataFrame:
    """Add r1, r2, rp, rd, rv, to_st (stations) and on1, on2, onv (whether a station is on the row's line).

    A row's names go to the lookup as rows of their own, so one join answers all of them and
    one more all questions about lines; they come back as one row per ``_rid``.
    """
    asks = F.array(*[F.struct(F.lit(k).alias("role"), F.col(c).alias("raw")) for k, c in _ASKED.items()])
    asked = d.select("_rid", "line_code", F.inline(asks)).where(F.col("raw").isNotNull()).join(lk, "raw")
    if ls is None:
        asked = asked.withColumn("on", F.lit(True))
    else:
        on = ls.select("line_code", F.col("code").alias("_code"), F.lit(True).alias("on"))
        asked = asked.withColumn("_code", F.col("resolved.code")).join(on, ["line_code", "_code"], "left")
    role = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    found = asked.groupBy("_rid").agg(
        *[role(r, "resolved").alias(r) for r in _ASKED], role("rv", "direct").alias("to_st"),
        *[role(r, "on").alias(o) for r, o in (("r1", "on1"), ("r2", "on2"), ("rv", "onv"))])
    out = d.join(found, "_rid", "left").drop("_rid")
    guards = {"r1": _truthy(F.col("loc_station1")), "r2": _truthy(F.col("loc_station2")),
              "rp": F.col("_sn_ok"), "rd": F.col("_dn_ok"), "rv": F.col("_sn_ok")}
    return out.withColumns({
        **{r: F.when(g, F.col(r)) for r, g in guards.items()},
        **{o: F.coalesce(F.col(o), F.lit(False)) | ~F.col("_has_line") for o in ("on1", "on2", "onv")}})


# --------------------------------------------------------------------------- context
def position_context(df: DataFrame, stations: DataFrame, edges: DataFrame,
                     use_line: bool = True, direct_names: bool = False) -> DataFrame:
    """Add parsed location, resolved stations, line flags and neighbour facts.

    ``use_line=False`` ignores the row's line (neighbours of all lines, every
    station counts as on the line) and ``direct_names=True`` resolves every
    string on its own; both together are the diagnostic endpoint's mode.
    """
    spark = df.sparkSession
    d = with_location(df, "current_location")
    d = d.withColumns({
        "_sn_ok": _truthy(F.col("station_name")),
        "_dn_ok": _truthy(F.col("destination")),
        "_sn_key": F.coalesce(strip_trailing_dot("station_name"), F.lit("")),
        "_has_line": _truthy(F.col("line_code")) if use_line else F.lit(False),
        "line_key": graph.line_key("line_code") if use_line else F.lit(graph.ANY_LINE),
        "secs": countdown_seconds("time_to_station"),
        "_rid": F.monotonically_increasing_id(),
    })
    # parsed once; read for the names and for the rows
    d = materialize(d, "located")
    if direct_names:
        raw = d.select(F.explode(F.array("loc_station1", "loc_station2", "station_name",
                                         "destination")).alias("name")
                       ).filter(_truthy(F.col("name"))).distinct()
        res = resolve_names(raw, stations, spark)
        lk = res.select(F.col("name").alias("raw"), _station_struct().alias("direct"),
                        _station_struct().alias("resolved"))
    else:
        res = resolve_names(needed_names(d), stations, spark)
        lk = lookup_table(d, res)
    d = _resolve_rows(d, lk, graph.line_stations(edges) if use_line else None)
    if direct_names:
        d = d.withColumns({"rv": F.col("rp"), "to_st": F.col("rp")})
    fn = graph.first_neighbours(graph.neighbours(edges)).withColumnRenamed("station_code", "_nb_st")
    d = d.join(fn.withColumnRenamed("line_key", "_nb_lk"),
               (F.col("line_key") == F.col("_nb_lk")) & (F.col("r1.code") == F.col("_nb_st")),
               "left").drop("_nb_lk", "_nb_st")
    # a row asks about one pair: "left" about the platform station, all others about their second one
    other = F.when(F.col("loc_type") == "left", F.col("rp.code")).otherwise(F.col("r2.code"))
    d = d.withColumn("_other", F.when(F.col("r1.code").isNotNull(), other))
    d = d.withColumns({"_pa": F.when(F.col("_other").isNotNull(), F.least("r1.code", "_other")),
                       "_pb": F.when(F.col("_other").isNotNull(), F.greatest("r1.code", "_other"))})
    # few pairs are asked for of those that edges join; both are stored, so that sizes decide the joins
    d = materialize(d, "asked-pairs")
    asked = materialize(d.where(F.col("_pa").isNotNull()).select(F.col("_pa").alias("a"), F.col("_pb").alias("b")).distinct(), "pairs")
    facts = graph.pair_facts(edges, asked).toDF("_fa", "_fb", "_lines", "_any")
    d = d.join(facts, (F.col("_pa") == F.col("_fa")) & (F.col("_pb") == F.col("_fb")), "left")
    of_line = F.try_element_at("_lines", F.col("line_code"))
    of_key = F.when(F.col("line_key") == graph.ANY_LINE, F.col("_any")).otherwise(
        F.try_element_at("_lines", F.col("line_key")))
    d = d.withColumns({"_of_line": of_line, "_of_key": of_key})
    d = d.withColumns({
        "nbx": F.when(F.col("loc_type") == "left", F.when(F.col("r1.code") == F.col("_pa"), F.col("_of_key.at_a"))
                      .otherwise(F.col("_of_key.at_b"))),
        "seg": F.when(F.col("loc_type") != "left", F.col("_of_line.seg")),
        "seg_any": F.when(F.col("loc_type") != "left", F.col("_any.seg"))})
    d = d.drop("_fa", "_fb", "_lines", "_any", "_other", "_pa", "_pb", "_of_line", "_of_key")
    # read for the positions and for the next stations
    return materialize(d, "position-context")


# --------------------------------------------------------------------------- C5
def line_valid(d: DataFrame) -> Column:
    """Keep rows whose located station(s) all resolve and lie on the row's line."""
    t = F.col("loc_type")
    s1, s2 = F.col("loc_station1"), F.col("loc_station2")
    r1_ok = F.col("r1").isNotNull() & F.col("on1")
    r2_ok = F.col("r2").isNotNull() & F.col("on2")
    rv_ok = F.col("rv").isNotNull() & F.col("onv")
    sn = F.col("_sn_ok")
    no_names = (((t == "at") & s1.isNull() & ~sn)
                | (t.isin("approaching", "left") & s1.isNull())
                | ((t == "between") & (s1.isNull() | s2.isNull()))
                | ((t == "unknown") & ~sn))
    all_on = (F.when(t == "at", F.when(s1.isNotNull(), r1_ok).otherwise(rv_ok))
              .when(t.isin("approaching", "left"), r1_ok)
              .when(t == "between", r1_ok & r2_ok)
              .otherwise(rv_ok))
    has_line = _truthy(F.col("line_code"))
    return ~has_line | no_names | all_on


# --------------------------------------------------------------------------- C7
def _fraction(secs: Column, seg: Column, default: float) -> Column:
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.try_divide(secs, seg)))
    return F.when(secs.isNull(), F.lit(default)).otherwise(f)


def _interp(a_lat, a_lng, b_lat, b_lng, f):
    return (a_lat + (b_lat - a_lat) * f, a_lng + (b_lng - a_lng) * f)


def _pos(lat: Column, lng: Column, conf: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lng"), conf.alias("confidence"))


_STAGED = ["_prev", "_tow", "_segx", "_f_a", "_f_t", "_f_n", "_f_b"]


def add_calculated_position(d: DataFrame) -> DataFrame:
    """Add ``calc`` (lat, lng, confidence) from the position truth table.

    Neighbour choices and fractions are staged as columns first so every
    sub-expression is generated once (the one-expression form exceeds the
    JVM method size limit of whole-stage code generation).
    """
    rp, nb1, nb2 = F.col("rp"), F.col("nb1"), F.col("nb2")
    secs = F.col("secs")
    d = d.withColumns({
        # approaching: first neighbour that is not the platform station
        "_prev": F.when(rp.isNotNull() & (nb1["code"] == rp["code"]) & nb2.isNotNull(), nb2)
                  .otherwise(nb1),
        # left: toward the platform station if it is a neighbour
        "_tow": F.when(rp.isNotNull(), F.col("nbx")),
        # between: the line's edge, else any line's edge
        "_segx": F.when(F.col("_has_line") & F.col("seg").isNotNull(), F.col("seg"))
                  .otherwise(F.col("seg_any")),
    })
    d = d.withColumns({
        "_f_a": _fraction(secs, F.col("_prev.tt"), DEFAULT_FRACTION_APPROACHING),
        "_f_t": _fraction(secs, F.col("_tow.tt"), DEFAULT_FRACTION_LEFT),
        "_f_n": _fraction(secs, nb1["tt"], DEFAULT_FRACTION_LEFT),
        "_f_b": _fraction(secs, F.coalesce(F.col("_segx.tt"),
                                           F.lit(DEFAULT_TRAVEL_TIME_SECONDS)),
                          DEFAULT_FRACTION_BETWEEN),
    })
    return d.withColumn("calc", _calculated_position()).drop(*_STAGED)


def _calculated_position() -> Column:
    t = F.col("loc_type")
    s1, s2 = F.col("loc_station1"), F.col("loc_station2")
    r1, r2, rp = F.col("r1"), F.col("r2"), F.col("rp")
    secs = F.col("secs")
    conf = F.when(secs.isNull(), F.lit("estimated")).otherwise(F.lit("interpolated"))
    est = F.lit("estimated")
    platform = F.when(F.col("_sn_ok") & rp.isNotNull(), _pos(rp["lat"], rp["lng"], est))

    at_st = F.when(s1.isNotNull(), r1).otherwise(F.when(F.col("_sn_ok"), rp))
    at_pos = F.when(at_st.isNotNull(), _pos(at_st["lat"], at_st["lng"], F.lit("exact")))

    prev, nb1, tow = F.col("_prev"), F.col("nb1"), F.col("_tow")
    la, ga = _interp(prev["lat"], prev["lng"], r1["lat"], r1["lng"], F.col("_f_a"))
    appr_ok = r1.isNotNull() & F.col("on1")
    appr_pos = (F.when(s1.isNull(), None)
                .when(~appr_ok, platform)
                .when(nb1.isNotNull(), _pos(la, ga, conf))
                .otherwise(_pos(r1["lat"], r1["lng"], est)))

    lt, gt = _interp(r1["lat"], r1["lng"], rp["lat"], rp["lng"], F.col("_f_t"))
    ln, gn = _interp(r1["lat"], r1["lng"], nb1["lat"], nb1["lng"], F.col("_f_n"))
    left_pos = (F.when(s1.isNull(), None)
                .when(~appr_ok, platform)
                .when(tow.isNotNull(), _pos(lt, gt, conf))
                .when(nb1.isNotNull(), _pos(ln, gn, conf))
                .otherwise(_pos(r1["lat"], r1["lng"], est)))

    lb, gb = _interp(r1["lat"], r1["lng"], r2["lat"], r2["lng"], F.col("_f_b"))
    betw_ok = r1.isNotNull() & r2.isNotNull() & F.col("on1") & F.col("on2")
    betw_pos = (F.when(s1.isNull() | s2.isNull(), None)
                .when(~betw_ok, platform)
                .otherwise(_pos(lb, gb, conf)))

    return (F.when(t == "at", at_pos).when(t == "approaching", appr_pos)
            .when(t == "left", left_pos).when(t == "between", betw_pos)
            .otherwise(platform))


# --------------------------------------------------------------------------- C9
def next_station_table(d: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (line_key, current, destination): the neighbour nearest the destination."""
    trip = (d.filter(F.col("_want_next"))
            .select("line_key", F.col("rp.code").alias("cur"), F.col("rd.code").alias("dst"),
                    F.col("rd.lat").alias("dlat"), F.col("rd.lng").alias("dlng")).distinct())
    # a trip without a line looks at the neighbours of every line
    nb = graph.neighbours(edges).withColumn("line_code", F.coalesce("line_code", F.lit(graph.NO_LINE)))
    every = nb.select("line_code").distinct().agg(F.collect_list("line_code").alias("_all"))
    trip = trip.crossJoin(F.broadcast(every)).withColumn("line_code", F.explode(
        F.when(F.col("line_key") == graph.ANY_LINE, F.col("_all")).otherwise(F.array("line_key"))))
    j = trip.drop("_all").join(nb.select("line_code", F.col("station_code").alias("cur"), "nb_lat", "nb_lng",
                                         "travel_time", "ord"), ["line_code", "cur"])
    dist = ((F.col("nb_lat") - F.col("dlat")) * (F.col("nb_lat") - F.col("dlat"))
            + (F.col("nb_lng") - F.col("dlng")) * (F.col("nb_lng") - F.col("dlng")))
    return j.groupBy("line_key", "cur", "dst").agg(F.min(F.struct(
        dist.alias("dist"), F.col("ord"), F.col("nb_lat").alias("lat"),
        F.col("nb_lng").alias("lng"), F.col("travel_time").alias("tt"))).alias("nxt"))


def _norm(c: Column) -> Column:
    return F.lower(js_trim(F.regexp_replace(c, r"\.", "")))


def with_positions(latest_rows: DataFrame, stations: DataFrame, edges: DataFrame,
                   validate: bool = True) -> DataFrame:
    """C5 + C7 + C8 + C9 over latest rows; adds position and prediction columns."""
    d = position_context(latest_rows, stations, edges)
    if validate:
        d = d.filter(line_valid(d))
    d = add_calculated_position(d)
    precalc = (F.col("calculated_lat").isNotNull() & (F.col("calculated_lat") != 0)
               & F.col("calculated_lng").isNotNull() & (F.col("calculated_lng") != 0))
    ts = F.col("to_st")
    d = d.withColumns({
        "lat": F.when(precalc, F.col("calculated_lat")).when(F.col("calc").isNotNull(),
                                                             F.col("calc.lat"))
                .when(ts.isNotNull(), ts["lat"]),
        "lng": F.when(precalc, F.col("calculated_lng")).when(F.col("calc").isNotNull(),
                                                             F.col("calc.lng"))
                .when(ts.isNotNull(), ts["lng"]),
        "position_confidence": F.when(precalc, "precalculated")
                .when(F.col("calc").isNotNull(), F.col("calc.confidence"))
                .when(ts.isNotNull(), "station_fallback").otherwise("none"),
        "_want_next": (F.col("secs").isNull() & F.col("_sn_ok") & F.col("_dn_ok")
                       & (_norm(F.col("station_name")) != _norm(F.col("destination")))
                       & F.col("rp").isNotNull() & F.col("rd").isNotNull()
                       & (F.col("rp.code") != F.col("rd.code"))),
    })
    nxt = next_station_table(d, edges)
    d = d.join(nxt.select(F.col("line_key").alias("_n_lk"), F.col("cur").alias("_n_c"),
                          F.col("dst").alias("_n_d"), "nxt"),
               F.col("_want_next") & (F.col("line_key") == F.col("_n_lk"))
               & (F.col("rp.code") == F.col("_n_c")) & (F.col("rd.code") == F.col("_n_d")),
               "left").drop("_n_lk", "_n_c", "_n_d")
    return d.withColumns({
        "to_lat": ts["lat"], "to_lng": ts["lng"],
        "time_to_station_seconds": F.col("secs"),
        "predicted_next_lat": F.col("nxt.lat"), "predicted_next_lng": F.col("nxt.lng"),
        "predicted_travel_time": F.col("nxt.tt"),
    })


def position_stats(positioned: DataFrame) -> DataFrame:
    """Positioned / fallback / missing counters and shown rows."""
    c = F.col("position_confidence")
    return positioned.agg(
        F.count(F.lit(1)).alias("filtered_trains"),
        F.count_if(~c.isin("station_fallback", "none")).alias("positioned"),
        F.count_if(c == "station_fallback").alias("fallback_used"),
        F.count_if(c == "none").alias("missing"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("shown"),
    )


# --------------------------------------------------------------------------- C13
def coverage(latest_rows: DataFrame, stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Per-train diagnosis; runs without line code (neighbours span all lines)."""
    d = position_context(latest_rows, stations, edges, use_line=False, direct_names=True)
    d = add_calculated_position(d)
    has_pre = (F.col("calculated_lat").isNotNull() & (F.col("calculated_lat") != 0)
               & F.col("calculated_lng").isNotNull() & (F.col("calculated_lng") != 0))
    loc = F.coalesce(F.col("current_location"), F.lit("null"))
    reason = F.when(
        F.col("calc").isNull() & ~(F.col("calculated_lat").isNotNull()
                                   & (F.col("calculated_lat") != 0)),
        F.when(F.col("loc_type") == "unknown",
               F.concat(F.lit('Location text "'), loc, F.lit("\" doesn't match any pattern")))
        .otherwise(F.concat(F.lit('Could not find station(s) in database for "'), loc,
                            F.lit('"'))))
    return d.select(
        "set_number", "trip_number", "line_code", "station_name", "current_location",
        "time_to_station", "destination", "loc_type",
        has_pre.alias("has_precalculated_position"),
        (has_pre | F.col("calc").isNotNull()).alias("will_show_on_map"),
        F.col("calc.lat").alias("calc_lat"), F.col("calc.lng").alias("calc_lng"),
        F.col("calc.confidence").alias("calc_confidence"),
        reason.alias("reason_if_missing"))


def coverage_summary(diag: DataFrame, line: str | None = None) -> DataFrame:
    """Total, visible, missing, duplicate set numbers, of one line or of all."""
    if line:
        diag = diag.filter(F.col("line_code") == line)
    return diag.agg(
        F.count(F.lit(1)).alias("total_trains_in_db"),
        F.count_if("will_show_on_map").alias("visible_on_map"),
        F.count_if(~F.col("will_show_on_map")).alias("missing_from_map"),
        (F.count(F.lit(1)) - F.count_distinct("set_number")).alias("duplicate_set_numbers"),
    ).withColumn("line_filter", F.lit(line or "all"))


def missing_by_reason(diag: DataFrame) -> DataFrame:
    """Missing trains per reason (counts; members are ``missing_trains`` rows)."""
    m = diag.filter(~F.col("will_show_on_map"))
    return m.groupBy(F.coalesce(F.col("reason_if_missing"), F.lit("unknown")).alias("reason")
                     ).agg(F.count(F.lit(1)).alias("n_trains"),
                           F.min("set_number").alias("first_set_number"),
                           F.max("set_number").alias("last_set_number"))


def missing_trains(diag: DataFrame) -> DataFrame:
    """Missing trains with their reason, one row each (the grouped report's members)."""
    return diag.filter(~F.col("will_show_on_map")).select(
        F.coalesce(F.col("reason_if_missing"), F.lit("unknown")).alias("reason"),
        "set_number", "line_code", "current_location", "loc_type")
