"""Map-ready features: trains (C10, C25), stations (C11), lines (C12), overlaps (C17).

Features are flat rows (one per GeoJSON feature, or one per segment for
line geometry); ``to_geojson`` turns a row into its JSON text for the sink.
Wrapping rows into one FeatureCollection document is left to the caller.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import (DEFAULT_LINE_COLOR, LINE_COLORS, LINE_SPLITS,
                                           OVERLAP_OFFSET_DEG)
from railpulse.operators.latest import latest_positions
from railpulse.operators.location import next_station_label
from railpulse.operators.position import with_positions
from railpulse.session import materialize

TRAIN_FEATURE_COLUMNS = [
    "id", "set_number", "trip_number", "line_code", "station_name", "current_location",
    "location_type", "next_station", "time_to_station", "destination", "timestamp", "lat", "lng",
    "position_confidence", "from_lat", "from_lng", "to_lat", "to_lng",
    "time_to_station_seconds", "data_timestamp", "predicted_next_lat", "predicted_next_lng",
    "predicted_travel_time", "eta_label", "line_color"]


def line_color(code: Column) -> Column:
    """Marker colour per line code, grey for anything else."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(LINE_COLORS)])
    return F.coalesce(F.try_element_at(m, code), F.lit(DEFAULT_LINE_COLOR))


def labels(d: DataFrame) -> DataFrame:
    """Location type, next station, display location, ETA label, colour."""
    label = F.regexp_replace(F.col("station_name"), r"\.\z", "")
    label_ok = label.isNotNull() & (label != "")
    nxt = next_station_label(F.col("loc_type"), F.col("loc_station1"), F.col("loc_station2"),
                             label)
    display = F.when((F.col("loc_type") == "at") & F.col("loc_station1").isNull() & label_ok,
                     F.concat(F.lit("At "), label)).otherwise(F.col("current_location"))
    tts = F.col("time_to_station")
    tts_ok = tts.isNotNull() & (tts != "") & (tts != "-")
    nxt_ok = nxt.isNotNull() & (nxt != "")
    at_label = F.coalesce(F.when(nxt_ok, nxt),
                          F.when(F.col("station_name") != "", F.col("station_name")),
                          F.lit("station"))
    eta = (F.when(F.col("loc_type") == "at", F.concat(F.lit("At "), at_label))
           .when(nxt_ok & tts_ok, F.concat(F.lit("Next: "), nxt, F.lit(" in "), tts))
           .when(tts_ok, F.concat(F.lit("ETA: "), tts))
           .otherwise(F.concat(F.lit("Status: "), F.col("loc_type"))))
    return d.withColumns({"location_type": F.col("loc_type"), "next_station": nxt,
                          "display_location": display, "eta_label": eta,
                          "line_color": line_color(F.col("line_code"))})


def train_features(predictions: DataFrame, stations: DataFrame, edges: DataFrame,
                   window: str = "2 minutes", line: str | None = None) -> DataFrame:
    """Latest rows -> validated, positioned, predicted, labelled features."""
    latest = latest_positions(predictions, window=window, line=line)
    d = with_positions(latest, stations, edges)
    d = d.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    d = labels(d)
    return d.select(
        "id", "set_number", "trip_number", "line_code", "station_name",
        F.col("display_location").alias("current_location"), "location_type", "next_station",
        "time_to_station", "destination", "timestamp", "lat", "lng", "position_confidence",
        F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"), "to_lat", "to_lng",
        "time_to_station_seconds", F.col("timestamp").alias("data_timestamp"),
        "predicted_next_lat", "predicted_next_lng", "predicted_travel_time", "eta_label",
        "line_color")


def to_geojson(features: DataFrame, lng: str = "lng", lat: str = "lat",
               props: list[str] | None = None) -> DataFrame:
    """One GeoJSON Point feature per row as JSON text; null properties stay as nulls."""
    props = props or [c for c in features.columns if c not in (lng, lat)]
    return _feature(features, "Point", F.array(F.col(lng), F.col(lat)), props)


def segments_to_geojson(segments: DataFrame, start: tuple[str, str] = ("from_lng", "from_lat"),
                        end: tuple[str, str] = ("to_lng", "to_lat"),
                        props: list[str] | None = None) -> DataFrame:
    """One GeoJSON LineString feature per line segment as JSON text."""
    props = props or [c for c in segments.columns if c not in (*start, *end)]
    return _feature(segments, "LineString", F.array(F.array(*start), F.array(*end)), props)


def _feature(df: DataFrame, kind: str, coordinates, props: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*[F.col(c) for c in props]).alias("properties")),
        {"ignoreNullFields": "false"}).alias("feature"))


# --------------------------------------------------------------------------- C11
def station_features(stations: DataFrame, line: str | None = None) -> DataFrame:
    """C11: stations with a location, optionally those serving ``line``."""
    s = stations.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if line:
        s = s.filter(F.array_contains(F.col("lines"), line))
    return s.select("code", "name", "lat", "lng", "lines")


# --------------------------------------------------------------------------- C12
def line_variants(lines: DataFrame, spark: SparkSession) -> DataFrame:
    """Feature variants per line: a split line is emitted once per split row."""
    splits = spark.createDataFrame(
        LINE_SPLITS, "code string, v_name string, v_color string, line_offset int")
    j = lines.join(F.broadcast(splits), "code", "left")
    return j.select(
        "code", F.coalesce("v_name", "name").alias("name"),
        F.coalesce("v_color", "color").alias("color"),
        F.coalesce("line_offset", F.lit(0)).alias("line_offset"))


def line_segments(lines: DataFrame, edges: DataFrame, spark: SparkSession) -> DataFrame:
    """C12 geometry in long form: one row per (feature, segment); lines without
    segments keep one row with NULL coordinates (an empty MultiLineString).

    A few lines hold all segments, so segments aren't dealt by line: the stored variants' size
    lets them go to the segments."""
    v = materialize(line_variants(lines, spark), "line-variants")
    seg = edges.select(F.col("line_code").alias("code"), "from_code", "to_code",
                       "from_lng", "from_lat", "to_lng", "to_lat")
    bare = v.join(seg.select("code").distinct(), "code", "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in seg.schema if f.name != "code"]
    return v.join(seg, "code").unionByName(bare.select("*", *nulls))


def line_features(lines: DataFrame, edges: DataFrame, spark: SparkSession) -> DataFrame:
    """C12 summary: one row per feature with its segment count."""
    v = line_variants(lines, spark)
    counts = edges.groupBy(F.col("line_code").alias("code")).agg(
        F.count(F.lit(1)).alias("n_segments"))
    return v.join(counts, "code", "left").select(
        "code", "name", "color", "line_offset",
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"))


# --------------------------------------------------------------------------- C17
def fixed4(x: Column) -> Column:
    """4-decimal text key of a coordinate; small negatives keep their sign ('-0.0000').

    Rounds half-up on the shortest decimal form of the double (via decimal
    arithmetic, so every engine reading the same digits agrees).
    """
    dec = F.abs(x).cast("string").cast("decimal(38,18)")
    txt = F.round(dec, 4).cast("decimal(38,4)").cast("string")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), txt)


def spread_overlaps(df: DataFrame, lat: str = "lat", lng: str = "lng",
                    order=("set_number", "line_code")) -> DataFrame:
    """Trains on the same 4-decimal point are spread on a small circle.

    Group size is a partial aggregate joined back (no per-group collect); the
    index within the group comes from a window ordered by ``order``.
    """
    key = F.concat(fixed4(F.col(lng)), F.lit(","), fixed4(F.col(lat)))
    d = df.withColumn("_key", key)
    counts = d.groupBy("_key").agg(F.count(F.lit(1)).alias("overlap_count"))
    d = d.join(counts, "_key")
    w = Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    d = d.withColumn("_i", F.row_number().over(w) - 1)
    ang = F.lit(2 * 3.141592653589793) / F.col("overlap_count") * F.col("_i") - F.lit(
        3.141592653589793 / 2)
    multi = F.col("overlap_count") > 1
    return d.withColumns({
        "display_lng": F.when(multi, F.col(lng) + F.cos(ang) * F.lit(OVERLAP_OFFSET_DEG))
        .otherwise(F.col(lng)),
        "display_lat": F.when(multi, F.col(lat) + F.sin(ang) * F.lit(OVERLAP_OFFSET_DEG))
        .otherwise(F.col(lat)),
    }).drop("_key", "_i")
