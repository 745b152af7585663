"""Undirected station graph views over the stored (one-direction) edges.

* ``line_stations`` (U1): distinct (line_code, code) from both edge ends.
* ``neighbours`` (C6): every edge seen from each end, normalised so the
  station in question is the "from" side; travel time defaults to 120 s.
  The reference takes neighbours in storage order; here that order is made
  explicit as ``ord = (sequence_order, line_code, from_code, to_code)``.
  A row without a line code sees the neighbours of all lines (``ANY_LINE``).
* ``first_neighbours``: per (line_key, station) the first neighbour and the
  first neighbour with a different code (enough to answer "first neighbour
  that is not station P" for any P without joining rows to all neighbours).
* ``pair_facts`` (J3): per unordered pair (``least/greatest``; an OR join condition
  would become a nested loop) the first edge and the neighbour entries at both
  ends, per line and across lines, from one pass over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import DEFAULT_TRAVEL_TIME_SECONDS
from railpulse.session import materialize

ANY_LINE = "<any line>"
#: Stands for the line of an edge without one, whose neighbours only the all-lines view shows.
NO_LINE = "<no line>"
#: Entries of a station that are looked at first; two edges join a pair of one line as a rule.
FIRST = 4


def line_key(line_code) -> Column:
    """Join key for neighbour tables: the line, or ANY_LINE when it is NULL/empty."""
    c = F.col(line_code) if isinstance(line_code, str) else line_code
    return F.when(c.isNull() | (c == ""), F.lit(ANY_LINE)).otherwise(c)


def line_stations(edges: DataFrame) -> DataFrame:
    a = edges.select("line_code", F.col("from_code").alias("code"))
    b = edges.select("line_code", F.col("to_code").alias("code"))
    return a.union(b).distinct()


def _edge_ord() -> Column:
    return F.struct(F.col("sequence_order"), F.col("line_code"), F.col("from_code"),
                    F.col("to_code"))


def neighbours(edges: DataFrame) -> DataFrame:
    """line_code, station_code, nb_code, nb_lat, nb_lng, travel_time, ord."""
    tt = F.coalesce(F.col("travel_time_seconds"), F.lit(DEFAULT_TRAVEL_TIME_SECONDS))
    fwd = edges.select(
        "line_code", F.col("from_code").alias("station_code"), F.col("to_code").alias("nb_code"),
        F.col("to_lat").alias("nb_lat"), F.col("to_lng").alias("nb_lng"),
        tt.alias("travel_time"), _edge_ord().alias("ord"))
    # a self loop yields one neighbour only (the "from" branch wins)
    back = edges.filter(F.col("from_code") != F.col("to_code")).select(
        "line_code", F.col("to_code").alias("station_code"), F.col("from_code").alias("nb_code"),
        F.col("from_lat").alias("nb_lat"), F.col("from_lng").alias("nb_lng"),
        tt.alias("travel_time"), _edge_ord().alias("ord"))
    return fwd.unionByName(back)


def _nb_struct(prefix: str = "") -> Column:
    return F.struct(F.col("ord"), F.col("nb_code").alias("code"), F.col("nb_lat").alias("lat"),
                    F.col("nb_lng").alias("lng"), F.col("travel_time").alias("tt"))


def first_neighbours(nb: DataFrame) -> DataFrame:
    """line_key, station_code, nb1 (first), nb2 (first whose code differs from nb1).

    The all-lines view (``ANY_LINE``) is taken from the lines' own first two: a line's first
    neighbour that is not ``c`` is its nb1, or its nb2 where nb1 is ``c``.

    Only the first ``FIRST`` entries of a station leave a task.  A station whose first
    entries all name one neighbour, as there may be many edges between two stations, is looked
    up again among all entries.
    """
    key = ["station_code", "line_key"]
    nb = nb.select("station_code", F.coalesce("line_code", F.lit(NO_LINE)).alias("line_key"), _nb_struct().alias("e"))
    few = nb.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("e"))).where(F.col("_n") <= FIRST)
    few = few.groupBy(*key).agg(F.sort_array(F.collect_list("e")).alias("es")).withColumn("nb1", F.col("es")[0])
    other = F.get(F.filter("es", lambda x: x["code"] != F.col("nb1.code")), F.lit(0))
    # few rows; read for the lines and twice for all lines
    per_line = materialize(few.select(*key, "nb1", other.alias("nb2"), F.size("es").alias("_n")), "first-neighbours")
    left = per_line.where(F.col("nb2").isNull() & (F.col("_n") == FIRST)).select(*key, F.col("nb1.code").alias("_c"))
    if not left.isEmpty():
        second = (nb.join(left, key).where(F.col("e.code") != F.col("_c"))
                  .groupBy(*key).agg(F.min("e").alias("_nb2")))
        per_line = materialize(per_line.join(second, key, "left").withColumn("nb2", F.coalesce("nb2", "_nb2")), "first-neighbours")
    per_line = per_line.select("line_key", "station_code", "nb1", "nb2")
    first = per_line.groupBy("station_code").agg(F.min("nb1").alias("_nb1"))
    other = F.when(F.col("nb1.code") != F.col("_nb1.code"), F.col("nb1")).otherwise(F.col("nb2"))
    any_line = (per_line.join(first, "station_code").groupBy("station_code")
                .agg(F.min("_nb1").alias("nb1"), F.min(other).alias("nb2")))
    return per_line.where(F.col("line_key") != NO_LINE).unionByName(
        any_line.withColumn("line_key", F.lit(ANY_LINE)))


def pair_facts(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """What is known of each unordered pair a <= b of stations, one row per pair.

    ``lines`` maps a line to its facts, ``any`` holds those of all lines: ``seg``, the first edge
    that joins the two, and ``at_a`` and ``at_b``, the first neighbour entry of a for b and of b
    for a.  All three come from the same edge, the first of the pair, so only that is
    aggregated.  ``wanted`` (a, b) names the pairs asked for, if not all.
    """
    e = edges.withColumns({"a": F.least("from_code", "to_code"), "b": F.greatest("from_code", "to_code")})
    e = e.where(F.col("from_code").isNotNull() & F.col("to_code").isNotNull())
    if wanted is None:
        e = e.repartition("a", "b")
    else:
        e = e.join(wanted.select("a", "b"), ["a", "b"], "left_semi")
    edge = F.struct(_edge_ord().alias("ord"), F.col("travel_time_seconds").alias("tt"),
                    "from_lat", "from_lng", "to_lat", "to_lng")
    per_line = e.groupBy("a", "b", "line_code").agg(F.min(edge).alias("e"))
    pairs = per_line.groupBy("a", "b").agg(
        F.collect_list(F.when(F.col("line_code").isNotNull(), F.struct("line_code", "e"))).alias("of"),
        F.min("e").alias("first"))

    def facts(x: Column) -> Column:
        tt = F.coalesce(x["tt"], F.lit(DEFAULT_TRAVEL_TIME_SECONDS))
        end = lambda e: F.struct(x["ord"].alias("ord"), x["ord"][f"{e}_code"].alias("code"),
                                 x[f"{e}_lat"].alias("lat"), x[f"{e}_lng"].alias("lng"), tt.alias("tt"))
        there = x["ord"]["from_code"] <= x["ord"]["to_code"]
        loop = x["ord"]["from_code"] == x["ord"]["to_code"]  # of a self loop only the "to" end is a neighbour
        return F.struct(F.struct(x["ord"].alias("ord"), x["tt"].alias("tt")).alias("seg"),
                        F.when(there, end("to")).otherwise(end("from")).alias("at_a"),
                        F.when(there & ~loop, end("from")).otherwise(end("to")).alias("at_b"))

    of_lines = F.map_from_entries(F.transform("of", lambda o: F.struct(o["line_code"].alias("key"), facts(o["e"]).alias("value"))))
    return pairs.select("a", "b", of_lines.alias("lines"), facts(F.col("first")).alias("any"))


def neighbour_table(edges: DataFrame) -> DataFrame:
    """C6 job output: the both-directions view with default travel time, ranked."""
    nb = neighbours(edges)
    w = Window.partitionBy("line_code", "station_code").orderBy("ord")
    return nb.select("line_code", "station_code", "nb_code", "nb_lat", "nb_lng", "travel_time",
                     F.row_number().over(w).cast("bigint").alias("nb_rank"))
