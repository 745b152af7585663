"""Adapters that shape the driver's tables into the domain schemas.

Each adapter exists twice: as a Spark DataFrame function and as DuckDB CTE
text (``ADAPTER_SQL``) so the oracle can rebuild the same input.  Adapters
only produce rows in the schema a job expects; the jobs themselves never use
how these rows were made.

Rules (see FIXTURES.md §B):
* stations     <- supplier: code 'ST'||key, coordinates from the key, two of
                  three fixture lines per station.
* predictions  <- events joined to supplier names (station, destination, a
                  second station for "Between" texts).
* route stops  <- lineitem: one route sequence per (returnflag, orderkey).
* timetables   <- route stops: one timetable per (line, first stop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import SEED_LINES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Total order over lineitem rows of one order (l_orderkey, l_linenumber repeats).
TOT = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
       "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_suppliers(spark: SparkSession, sf_dir: str) -> int:
    # One scalar.
    return table(spark, sf_dir, "supplier").count()


def _lat(key):
    return F.lit(51.25) + ((key * 37) % 128) / F.lit(256.0)


def _lng(key):
    return F.lit(-0.5) + ((key * 53) % 128) / F.lit(128.0)


def _line_idx(flag):
    return (F.when(flag == "A", 0).when(flag == "N", 1).when(flag == "R", 2))


# --------------------------------------------------------------------------- stations
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    lines = F.filter(F.array(F.lit("A"), F.lit("N"), F.lit("R")),
                     lambda c, i: (k + i) % 3 != 0)
    return s.select(
        F.concat(F.lit("ST"), k.cast("string")).alias("code"),
        F.col("s_name").alias("name"),
        _lat(k).alias("lat"),
        _lng(k).alias("lng"),
        lines.alias("lines"),
    )


# --------------------------------------------------------------------------- lines
def seed_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_LINES, "code string, name string, color string")


def fixture_line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line codes used by the fixture routes (distinct return flags)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_returnflag").alias("code")).distinct()
            .select("code", F.concat(F.lit("Line "), F.col("code")).alias("name"),
                    F.lit("#888888").alias("color")))


# --------------------------------------------------------------------------- predictions
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_suppliers(spark, sf_dir)
    ev = table(spark, sf_dir, "events")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.regexp_extract("props", r'"k"\s*:\s*(-?[0-9]+)', 1).cast("int")
    ev = ev.select(
        "event_id", "user_id", "event_type", "ts", k.alias("k"),
    ).select(
        "*",
        ((F.col("user_id") * 7 + F.col("k")) % n).alias("x_key"),
        ((F.col("user_id") * 11) % n).alias("d_key"),
        ((F.col("user_id") * 13 + F.col("k") * 3) % n).alias("y_key"),
    )
    x = sup.select(F.col("s_suppkey").alias("x_key"), F.col("s_name").alias("x_name"))
    d = sup.select(F.col("s_suppkey").alias("d_key"), F.col("s_name").alias("d_name"))
    y = sup.select(F.col("s_suppkey").alias("y_key"), F.col("s_name").alias("y_name"))
    j = ev.join(x, "x_key", "left").join(d, "d_key", "left").join(y, "y_key", "left")
    kk = F.col("k")
    ttl = (F.when(kk < 10, "-").when(kk < 20, "due").when(kk < 25, "").when(kk < 27, "bogus")
           .otherwise(F.concat((kk / 20).cast("int").cast("string"), F.lit(":"),
                               F.lpad(((kk * 7) % 60).cast("string"), 2, "0"))))
    X, Y = F.col("x_name"), F.col("y_name")
    m = F.col("event_id") % 10
    loc = (F.when(m == 0, F.concat(F.lit("At "), X, F.lit(" Platform 1")))
           .when(m == 1, F.concat(F.lit("Approaching "), X))
           .when(m == 2, F.concat(F.lit("Left "), X))
           .when(m == 3, F.concat(F.lit("Between "), X, F.lit(" and "), Y))
           .when(m == 4, F.concat(F.lit("Departed "), X))
           .when(m == 5, F.concat(F.lit("Held at "), X))
           .when(m == 6, F.lit("At Platform"))
           .when(m == 7, F.concat(F.lit("Leaving "), X))
           .when(m == 8, F.lit("In transit"))
           .otherwise(F.lit("")))
    et = F.col("event_type")
    line = (F.when(et.isin("click", "signup"), "A").when(et == "view", "N")
            .when(et == "purchase", "R"))
    return j.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("set_number"),
        (F.col("event_id") % 1000).cast("string").alias("trip_number"),
        line.alias("line_code"),
        F.concat(F.lit("ST"), F.col("x_key").cast("string")).alias("station_code"),
        F.when(kk % 13 == 0, F.concat(F.lit("Depot "), F.col("user_id").cast("string")))
         .otherwise(F.concat(X, F.when(kk % 2 == 0, ".").otherwise(""))).alias("station_name"),
        F.concat(F.lit("Platform "), (kk % 4 + 1).cast("string")).alias("platform_name"),
        (kk % 4 + 1).cast("string").alias("platform_code"),
        loc.alias("current_location"),
        ttl.alias("time_to_station"),
        F.col("d_name").alias("destination"),
        F.lit(None).cast("double").alias("calculated_lat"),
        F.lit(None).cast("double").alias("calculated_lng"),
        F.lit(None).cast("string").alias("heading"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("timestamp"),
    )


# --------------------------------------------------------------------------- routes
def _on_line(li: DataFrame) -> DataFrame:
    """``lineitem`` with a supplier off its line (see ``stations``) replaced by a neighbouring one on it."""
    k = F.col("l_suppkey")
    off = (k + _line_idx(F.col("l_returnflag"))) % 3 == 0
    return li.withColumn("l_suppkey", F.when(off, F.when(k > 1, k - 1).otherwise(k + 1)).otherwise(k))


def route_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat route stops: line_id, line_code, seq_no, pos, stationId, id, name, lat, lon."""
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    kept = _on_line(li)
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*TOT)  # the order's key first: sorts compare its beginning
    kept = kept.withColumn("pos", F.row_number().over(w))
    k = F.col("l_suppkey")
    j = kept.join(sup, kept.l_suppkey == sup.s_suppkey, "left")
    return j.select(
        F.concat(F.col("l_returnflag"), ((F.col("l_orderkey") / 10).cast("long") % 2)
                 .cast("string")).alias("line_id"),
        F.col("l_returnflag").alias("line_code"),
        F.col("l_orderkey").alias("seq_no"),
        F.col("pos"),
        F.when(F.col("l_linenumber") == 7, F.lit(""))
         .otherwise(F.concat(F.lit("ST"), k.cast("string"))).alias("stationId"),
        F.concat(F.lit("ST"), k.cast("string")).alias("id"),
        F.concat(F.col("s_name"), F.lit(" Underground Station")).alias("name"),
        _lat(k).alias("lat"),
        _lng(k).alias("lon"),
    )


def route_line_map(stops: DataFrame) -> DataFrame:
    """Line id -> code with the processing order of line ids (the fixture's id order)."""
    # the fixture processes line ids in id order, so the id itself is the rank
    return stops.select("line_id", "line_code", F.col("line_id").alias("line_rank")).distinct()


def timetable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat timetable intervals: one timetable per (line_code, first stop of a route).

    Columns: line_code, departure, route_idx, set_idx, interval_idx, stop_id,
    time_to_arrival (cumulative minutes).  Step minutes are 0 when
    l_quantity % 7 = 0 else l_quantity / 10; sums are kept in tenths so the
    cumulative value is exact before the final division.
    """
    li = table(spark, sf_dir, "lineitem")
    kept = _on_line(li)
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*TOT)  # the order's key first: sorts compare its beginning
    tenths = F.when(F.col("l_quantity") % 7 == 0, F.lit(0)).otherwise(
        (F.col("l_quantity") * 10).cast("long"))
    kept = (kept.withColumn("pos", F.row_number().over(w))
            .withColumn("step", F.when(F.col("pos") == 1, F.lit(0)).otherwise(tenths)))
    kept = kept.withColumn(
        "cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = kept.withColumn(
        "departure", F.first(F.concat(F.lit("ST"), F.col("l_suppkey").cast("string")))
        .over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return kept.filter(F.col("pos") >= 2).select(
        F.col("l_returnflag").alias("line_code"),
        "departure",
        F.lit(0).alias("route_idx"),
        F.col("l_orderkey").alias("set_idx"),
        F.col("pos").alias("interval_idx"),
        F.concat(F.lit("ST"), F.col("l_suppkey").cast("string")).alias("stop_id"),
        (F.col("cum") / F.lit(10.0)).alias("time_to_arrival"),
    )


# --------------------------------------------------------------------------- stop points
# Reference line ids cycled by supplier key (fixed ids, listed in natural order).
REF_LINE_IDS = ["bakerloo", "central", "circle", "district", "hammersmith-city", "jubilee",
                "metropolitan", "northern", "piccadilly", "victoria", "waterloo-city"]


def stop_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat stop points (doc = nation, order = supplier key) with input variation:
    empty stationNaptan, over-long codes and names, bus-only points, zero
    longitude, and a later copy of every tenth station under the same code."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    ids = F.array(*[F.lit(x) for x in REF_LINE_IDS])
    nid = F.lit(len(REF_LINE_IDS))
    base = s.select(
        F.col("s_nationkey").alias("doc_idx"), k.alias("key"), F.col("s_name"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("ST"), k.cast("string")))
         .alias("stationNaptan"),
        F.when(k % 40 == 0, F.concat(F.lit("940GZZLU"), F.lpad(k.cast("string"), 16, "0")))
         .otherwise(F.concat(F.lit("ST"), k.cast("string"))).alias("naptanId"),
        F.when(k % 50 == 0, F.concat(F.col("s_name"), F.lit(" Underground Station"),
                                     F.repeat(F.lit(" Extension"), 9)))
         .otherwise(F.concat(F.col("s_name"), F.lit(" Underground Station"))).alias("commonName"),
        _lat(k).alias("lat"), _lng(k).alias("lon"),
        F.array(F.lit("tube")).alias("modes"),
        F.when(k % 9 == 0, F.array(F.struct(F.lit("bus").alias("modeName"),
                                           F.array(F.lit("x1")).alias("lineIdentifier"))))
         .otherwise(F.array(
             F.struct(F.lit("tube").alias("modeName"),
                      F.array(F.element_at(ids, (k % nid + 1).cast("int")),
                              F.element_at(ids, ((k + 4) % nid + 1).cast("int")))
                      .alias("lineIdentifier")),
             F.struct(F.lit("bus").alias("modeName"),
                      F.array(F.lit("x1")).alias("lineIdentifier")))).alias("lineModeGroups"),
        F.when(k % 9 == 0, F.array().cast("array<struct<id:string>>")).otherwise(F.array(
            F.struct(F.element_at(ids, ((k + 4) % nid + 1).cast("int")).alias("id")),
            F.struct(F.element_at(ids, ((k + 7) % nid + 1).cast("int")).alias("id")),
            F.struct(F.element_at(ids, ((k + 7) % nid + 1).cast("int")).alias("id")))
        ).alias("lines"),
    )
    copies = base.filter(F.col("key") % 10 == 3).withColumns({
        "commonName": F.concat(F.col("commonName"), F.lit(" (copy)")),
        "key": F.col("key") + F.lit(1_000_000_000)})
    both = base.unionByName(copies)
    return both.select(
        "doc_idx", F.col("key").alias("sp_idx"), "naptanId", "stationNaptan", "commonName",
        "lat", "lon", "modes", "lineModeGroups", "lines")


# --------------------------------------------------------------------------- name variants
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to resolve: decorated, lower-cased, platform, parenthesised, prefix,
    contained and unknown variants of every supplier name, plus alias keys."""
    from railpulse.functions.constants import STATION_NAME_ALIASES
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_name")
    variants = F.array(
        F.concat(n, F.lit(" Underground Station")), F.lower(n),
        F.concat(n, F.lit(" Platform 2")), F.concat(n, F.lit(" (Main)")),
        F.substring(n, 1, 17), F.substring(n, 10, 9),
        F.concat(F.lit("Nowhere "), F.col("s_suppkey").cast("string")),
        F.concat(n, F.lit(".")))
    v = s.select(F.explode(variants).alias("name"))
    al = spark.createDataFrame([(a,) for a, _ in STATION_NAME_ALIASES], "name string")
    return v.unionByName(al).distinct()


# --------------------------------------------------------------------------- XML messages
def _esc(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.regexp_replace(c, a, b)
    return c


def _attr(name, c):
    return F.concat(F.lit(f' {name}="'), _esc(c), F.lit('"'))


def xml_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages (value + headers) assembled from predictions.

    One document per (line, poll, station): ROOT/S/P/T with the rows'
    attributes, plus a truncated copy of every tenth document and one empty
    and one NULL document per line, which must give no rows.
    """
    p = predictions(spark, sf_dir)
    t = p.select("line_code", "timestamp", "station_code", "station_name", "platform_name",
                 "platform_code", "id", F.concat(
                     F.lit("<T"), _attr("S", F.col("set_number")),
                     _attr("T", F.col("trip_number")), _attr("C", F.col("time_to_station")),
                     _attr("DE", F.col("destination")), _attr("L", F.col("current_location")),
                     F.lit("/>")).alias("x"))
    pk = ["line_code", "timestamp", "station_code", "station_name", "platform_name",
          "platform_code"]
    plat = t.groupBy(*pk).agg(F.min("id").alias("id"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("id", "x"))), lambda e: e["x"]), "").alias("b"))
    plat = plat.select(*pk[:4], "id", F.concat(
        F.lit("<P"), _attr("N", F.col("platform_name")), _attr("Code", F.col("platform_code")),
        F.lit(">"), F.col("b"), F.lit("</P>")).alias("x"))
    st = plat.groupBy(*pk[:4]).agg(F.min("id").alias("id"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("id", "x"))), lambda e: e["x"]), "").alias("b"))
    doc = st.select("line_code", "timestamp", "id", F.concat(
        F.lit("<ROOT><S"), _attr("Code", F.col("station_code")), _attr("N", F.col("station_name")),
        F.lit(">"), F.col("b"), F.lit("</S></ROOT>")).alias("xml"))
    bad = doc.filter(F.col("id") % 10 == 0).select(
        "line_code", "timestamp", "id", F.substring("xml", 1, 30).alias("xml"))
    lines = doc.select("line_code").distinct()
    empty = lines.select("line_code", F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                         F.lit(-1).cast("long").alias("id"), F.lit("").alias("xml"))
    null = lines.select("line_code", F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                        F.lit(-2).cast("long").alias("id"), F.lit(None).cast("string").alias("xml"))
    allx = doc.unionByName(bad).unionByName(empty).unionByName(null)
    hdr = F.array(
        F.struct(F.lit("source").alias("key"), F.lit("fixture").cast("binary").alias("value")),
        F.struct(F.lit("line_code").alias("key"), F.col("line_code").cast("binary").alias("value")),
        F.struct(F.lit("timestamp").alias("key"),
                 F.col("timestamp").cast("string").cast("binary").alias("value")),
        F.struct(F.lit("content-type").alias("key"),
                 F.lit("application/xml").cast("binary").alias("value")))
    return allx.select(F.lit(None).cast("binary").alias("key"),
                       F.col("xml").cast("binary").alias("value"), hdr.alias("headers"),
                       F.col("timestamp").cast("timestamp").alias("timestamp"))


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction row per (train, poll): the C2 order applied within each poll."""
    from railpulse.functions.text import countdown_rank
    p = predictions(spark, sf_dir)
    w = Window.partitionBy("set_number", "line_code", "timestamp").orderBy(
        countdown_rank("time_to_station"), "id")
    return p.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# =========================================================================== SQL side
# name -> (dependencies, CTE body).  ``{n}`` is the supplier count subquery.
ADAPTER_SQL: dict[str, tuple[list[str], str]] = {}
_IDS = "[" + ", ".join(f"'{x}'" for x in REF_LINE_IDS) + "]"

ADAPTER_SQL["stations"] = ([], """
SELECT 'ST' || CAST(s_suppkey AS VARCHAR) AS code, s_name AS name,
       51.25 + ((s_suppkey * 37) % 128) / 256.0 AS lat,
       -0.5 + ((s_suppkey * 53) % 128) / 128.0 AS lng,
       list_filter(['A', 'N', 'R'], lambda c, i: (s_suppkey + i - 1) % 3 <> 0) AS lines
FROM supplier""")

ADAPTER_SQL["seed_lines"] = ([], "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{n}', '{col}')" for c, n, col in SEED_LINES) + ") t(code, name, color)")

ADAPTER_SQL["fixture_line_codes"] = ([], """
SELECT DISTINCT l_returnflag AS code, 'Line ' || l_returnflag AS name, '#888888' AS color
FROM lineitem""")

ADAPTER_SQL["predictions"] = ([], r"""
SELECT e.event_id AS id,
       CAST(e.user_id AS VARCHAR) AS set_number,
       CAST(e.event_id % 1000 AS VARCHAR) AS trip_number,
       CASE WHEN e.event_type IN ('click', 'signup') THEN 'A' WHEN e.event_type = 'view' THEN 'N'
            WHEN e.event_type = 'purchase' THEN 'R' END AS line_code,
       'ST' || CAST(e.x_key AS VARCHAR) AS station_code,
       CASE WHEN e.k % 13 = 0 THEN 'Depot ' || CAST(e.user_id AS VARCHAR)
            ELSE x.s_name || CASE WHEN e.k % 2 = 0 THEN '.' ELSE '' END END AS station_name,
       'Platform ' || CAST(e.k % 4 + 1 AS VARCHAR) AS platform_name,
       CAST(e.k % 4 + 1 AS VARCHAR) AS platform_code,
       CASE e.event_id % 10
         WHEN 0 THEN 'At ' || x.s_name || ' Platform 1'
         WHEN 1 THEN 'Approaching ' || x.s_name
         WHEN 2 THEN 'Left ' || x.s_name
         WHEN 3 THEN 'Between ' || x.s_name || ' and ' || y.s_name
         WHEN 4 THEN 'Departed ' || x.s_name
         WHEN 5 THEN 'Held at ' || x.s_name
         WHEN 6 THEN 'At Platform'
         WHEN 7 THEN 'Leaving ' || x.s_name
         WHEN 8 THEN 'In transit'
         ELSE '' END AS current_location,
       CASE WHEN e.k < 10 THEN '-' WHEN e.k < 20 THEN 'due' WHEN e.k < 25 THEN ''
            WHEN e.k < 27 THEN 'bogus'
            ELSE CAST(e.k // 20 AS VARCHAR) || ':' || lpad(CAST((e.k * 7) % 60 AS VARCHAR), 2, '0')
       END AS time_to_station,
       d.s_name AS destination,
       CAST(NULL AS DOUBLE) AS calculated_lat,
       CAST(NULL AS DOUBLE) AS calculated_lng,
       CAST(NULL AS VARCHAR) AS heading,
       CAST(CAST(e.ts AS DATE) AS TIMESTAMP) AS timestamp
FROM (SELECT event_id, user_id, event_type, ts, k,
             (user_id * 7 + k) % n AS x_key, (user_id * 11) % n AS d_key,
             (user_id * 13 + k * 3) % n AS y_key
      FROM (SELECT *, CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS INTEGER) AS k,
                   (SELECT count(*) FROM supplier) AS n
            FROM events)) e
LEFT JOIN supplier x ON x.s_suppkey = e.x_key
LEFT JOIN supplier d ON d.s_suppkey = e.d_key
LEFT JOIN supplier y ON y.s_suppkey = e.y_key""")

_KEPT_SQL = """
SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos
FROM (SELECT * REPLACE (CASE WHEN (l_suppkey + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END) % 3 <> 0
                             THEN l_suppkey WHEN l_suppkey > 1 THEN l_suppkey - 1 ELSE l_suppkey + 1 END AS l_suppkey)
      FROM lineitem)"""

ADAPTER_SQL["route_stops"] = ([], f"""
SELECT l_returnflag || CAST((l_orderkey // 10) % 2 AS VARCHAR) AS line_id,
       l_returnflag AS line_code, l_orderkey AS seq_no, pos,
       CASE WHEN l_linenumber = 7 THEN '' ELSE 'ST' || CAST(l_suppkey AS VARCHAR) END AS stationId,
       'ST' || CAST(l_suppkey AS VARCHAR) AS id,
       s.s_name || ' Underground Station' AS name,
       51.25 + ((l_suppkey * 37) % 128) / 256.0 AS lat,
       -0.5 + ((l_suppkey * 53) % 128) / 128.0 AS lon
FROM ({_KEPT_SQL}) k LEFT JOIN supplier s ON s.s_suppkey = k.l_suppkey""")

ADAPTER_SQL["route_line_map"] = (["route_stops"], """
SELECT line_id, line_code, dense_rank() OVER (ORDER BY line_id) AS line_rank
FROM (SELECT DISTINCT line_id, line_code FROM route_stops)""")

ADAPTER_SQL["timetable_intervals"] = ([], f"""
SELECT l_returnflag AS line_code, departure, 0 AS route_idx, l_orderkey AS set_idx,
       pos AS interval_idx, 'ST' || CAST(l_suppkey AS VARCHAR) AS stop_id,
       cum / 10.0 AS time_to_arrival
FROM (
  SELECT *, sum(step) OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY pos
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         first_value('ST' || CAST(l_suppkey AS VARCHAR)) OVER (PARTITION BY l_returnflag, l_orderkey
                            ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
           AS departure
  FROM (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN l_quantity % 7 = 0 THEN 0
                       ELSE CAST(l_quantity * 10 AS BIGINT) END AS step
        FROM ({_KEPT_SQL}))
) WHERE pos >= 2""")

ADAPTER_SQL["stop_points"] = ([], f"""
WITH base AS (
  SELECT s_nationkey AS doc_idx, s_suppkey AS key, s_name,
         CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'ST' || CAST(s_suppkey AS VARCHAR) END AS stationNaptan,
         CASE WHEN s_suppkey % 40 = 0 THEN '940GZZLU' || lpad(CAST(s_suppkey AS VARCHAR), 16, '0')
              ELSE 'ST' || CAST(s_suppkey AS VARCHAR) END AS naptanId,
         CASE WHEN s_suppkey % 50 = 0 THEN s_name || ' Underground Station' || repeat(' Extension', 9)
              ELSE s_name || ' Underground Station' END AS commonName,
         51.25 + ((s_suppkey * 37) % 128) / 256.0 AS lat,
         -0.5 + ((s_suppkey * 53) % 128) / 128.0 AS lon,
         ['tube'] AS modes,
         CASE WHEN s_suppkey % 9 = 0 THEN [{{'modeName': 'bus', 'lineIdentifier': ['x1']}}]
              ELSE [{{'modeName': 'tube', 'lineIdentifier': [{_IDS}[s_suppkey % {len(REF_LINE_IDS)} + 1],
                                                            {_IDS}[(s_suppkey + 4) % {len(REF_LINE_IDS)} + 1]]}},
                    {{'modeName': 'bus', 'lineIdentifier': ['x1']}}] END AS lineModeGroups,
         CASE WHEN s_suppkey % 9 = 0 THEN CAST([] AS STRUCT(id VARCHAR)[])
              ELSE [{{'id': {_IDS}[(s_suppkey + 4) % {len(REF_LINE_IDS)} + 1]}},
                    {{'id': {_IDS}[(s_suppkey + 7) % {len(REF_LINE_IDS)} + 1]}},
                    {{'id': {_IDS}[(s_suppkey + 7) % {len(REF_LINE_IDS)} + 1]}}] END AS lines
  FROM supplier)
SELECT doc_idx, key AS sp_idx, naptanId, stationNaptan, commonName, lat, lon, modes,
       lineModeGroups, lines FROM base
UNION ALL
SELECT doc_idx, key + 1000000000, naptanId, stationNaptan, commonName || ' (copy)', lat, lon,
       modes, lineModeGroups, lines FROM base WHERE key % 10 = 3""")

ADAPTER_SQL["name_variants"] = ([], """
SELECT DISTINCT name FROM (
  SELECT unnest([s_name || ' Underground Station', lower(s_name), s_name || ' Platform 2',
                 s_name || ' (Main)', substring(s_name, 1, 17), substring(s_name, 10, 9),
                 'Nowhere ' || CAST(s_suppkey AS VARCHAR), s_name || '.']) AS name
  FROM supplier
  UNION ALL
  SELECT * FROM (VALUES """ + ", ".join(f"('{a}')" for a, _ in __import__(
    "railpulse.functions.constants", fromlist=["x"]).STATION_NAME_ALIASES) + """) t(name)
)""")


def with_ctes(needed: list[str], body: str, extra: dict[str, tuple[list[str], str]] | None = None
              ) -> str:
    """Assemble ``WITH`` clauses for ``needed`` (and their dependencies) before ``body``."""
    registry = dict(ADAPTER_SQL)
    registry.update(extra or {})
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        deps, _ = registry[name]
        for d in deps:
            visit(d)
        order.append(name)

    for n in needed:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({registry[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
