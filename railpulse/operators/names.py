"""Fuzzy station-name resolution (C3) as equi-joins on derived match keys.

Priorities for a query ``q`` (alias applied, lower-cased) against a station
name ``d`` (dots removed, lower-cased):

0 ``d == q``                      3 apostrophe-free equality
1 ``d == and->& of paren-free q`` 4 paren-free equality on both sides
2 ``d`` starts with ``q``          5 ``d`` contains ``q``

Ties: shorter station name, then name order, then code.

Instead of a names x stations theta join, every station emits its match keys for the
first five tiers (the exact forms and all prefixes of its name).  Keys are semi-joined
with the keys the queries actually use, then reduced to the best station per (key,
tier) with a partial aggregate, so hot keys never fan out.

Containment is asked for names that the first five tiers leave open, through an inverted
index of the stations' grams (runs of three characters; one or two for names so short):
a station that contains a name has all its grams, so the name meets the stations of its
rarest gram only, and those that really contain it are kept.  A name with a gram that no
station has meets none.  Index and keys are linear in stations x name length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.constants import STATION_NAME_ALIASES
from railpulse.functions.text import (and_to_amp, clean_lookup_name, drop_apostrophes,
                                      drop_parens, js_trim)
from railpulse.session import materialize

STATION_COLS = ["code", "st_name", "lat", "lng"]
#: The tier of containment, and the length of a gram.
CONTAINS, GRAM = 5, 3


def aliases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATION_NAME_ALIASES, "alias_key string, alias_name string")


def query_keys(names: DataFrame, spark: SparkSession) -> DataFrame:
    """(name, key, tier) for each distinct query name."""
    q = names.select("name").distinct()
    clean = clean_lookup_name("name")
    q = q.withColumn("_clean", clean)
    q = q.join(F.broadcast(aliases_df(spark)), F.lower(F.col("_clean")) == F.col("alias_key"),
               "left")
    search = F.coalesce(F.col("alias_name"), F.col("_clean"))
    q = q.select("name", search.alias("_s"))
    low = F.lower(F.col("_s"))
    no_apos = F.lower(drop_apostrophes(F.col("_s")))
    no_par = F.lower(js_trim(drop_parens(F.col("_s"))))
    amp = and_to_amp(no_par)
    keys = F.array(
        F.struct(low.alias("key"), F.lit(0).alias("tier")),
        F.struct(amp.alias("key"), F.lit(1).alias("tier")),
        F.struct(low.alias("key"), F.lit(2).alias("tier")),
        F.struct(no_apos.alias("key"), F.lit(3).alias("tier")),
        F.struct(no_par.alias("key"), F.lit(4).alias("tier")),
        F.struct(low.alias("key"), F.lit(CONTAINS).alias("tier")),
    )
    return q.select("name", F.inline(keys))


def _best() -> Column:
    return F.struct(F.length("st_name").alias("len"), F.col("st_name"), F.col("code"),
                    F.col("lat"), F.col("lng"))


def _station_names(stations: DataFrame) -> DataFrame:
    """Stations with the forms of their names that queries are compared with."""
    return stations.select(
        F.col("code"), F.col("name").alias("st_name"), "lat", "lng",
        F.lower(F.regexp_replace(F.col("name"), r"\.", "")).alias("_d"),
        F.lower(js_trim(F.regexp_replace(drop_parens(F.col("name")), r"\.", ""))).alias("_np"))


def station_keys(stations: DataFrame) -> DataFrame:
    """(key, tier, best) rows for every station: exact forms and prefixes."""
    s = _station_names(stations)
    prefixes = F.transform(F.sequence(F.lit(0), F.length("_d")),
                           lambda i: F.col("_d").substr(F.lit(1), i))
    exact = F.array(
        F.struct(F.col("_d").alias("key"), F.lit(0).alias("tier")),
        F.struct(F.col("_d").alias("key"), F.lit(1).alias("tier")),
        F.struct(drop_apostrophes(F.col("_d")).alias("key"), F.lit(3).alias("tier")),
        F.struct(F.col("_np").alias("key"), F.lit(4).alias("tier")),
    )
    tiered = F.concat(
        exact, F.transform(prefixes, lambda p: F.struct(p.alias("key"), F.lit(2).alias("tier"))))
    return s.select(_best().alias("best"), F.inline(tiered))


def _runs(c: str, n: int) -> Column:
    """All runs of ``n`` characters of a text; none if it is shorter."""
    return F.when(F.length(c) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))),
        lambda i: F.col(c).substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_index(stations: DataFrame) -> DataFrame:
    """(gram, _d, best) for every station and each of its different grams."""
    grams = F.array_distinct(F.concat(*[_runs("_d", n) for n in range(1, GRAM + 1)]))
    return _station_names(stations).select("_d", _best().alias("best"), F.explode(grams).alias("gram"))


def _containing(open_keys: DataFrame, stations: DataFrame) -> DataFrame:
    """(name, best) of the best station that contains a name's key, for names (name, key)."""
    keys = open_keys.where(F.col("key") != "").select("key").distinct()
    asked = keys.select("key", F.explode(F.when(F.length("key") < GRAM, F.array("key")).otherwise(
        F.array_distinct(_runs("key", GRAM)))).alias("gram"))
    index = gram_index(stations).join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (asked.join(sizes, "gram", "left").groupBy("key")
              .agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"),
                   F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0"))
    best = (rarest.join(index, "gram").where(F.col("_d").contains(F.col("key")))
            .groupBy("key").agg(F.min("best").alias("best")))
    return open_keys.join(best, "key").select("name", "best")


def resolve_names(names: DataFrame, stations: DataFrame, spark: SparkSession | None = None
                  ) -> DataFrame:
    """Best station per distinct ``name``: name, code, st_name, lat, lng, match_priority.

    Unresolved names are kept with NULL station columns.
    """
    spark = spark or names.sparkSession
    qk = materialize(query_keys(names, spark), "name-keys")
    used = qk.where(F.col("tier") < CONTAINS).select("key", "tier").distinct()
    sk = (station_keys(stations).join(used, ["key", "tier"], "left_semi")
          .groupBy("key", "tier").agg(F.min("best").alias("best")))
    cand = qk.join(sk, ["key", "tier"], "inner")
    ranked = materialize(cand.groupBy("name").agg(
        F.min(F.struct("tier", "best")).alias("m")), "names-by-key")
    still = qk.where(F.col("tier") == CONTAINS).join(ranked, "name", "left_anti").select("name", "key")
    inside = _containing(still, stations).select(
        "name", F.struct(F.lit(CONTAINS).alias("tier"), "best").alias("m"))
    allq = qk.where(F.col("tier") == CONTAINS).select("name")
    return allq.join(ranked.unionByName(inside), "name", "left").select(
        "name", F.col("m.best.code").alias("code"), F.col("m.best.st_name").alias("st_name"),
        F.col("m.best.lat").alias("lat"), F.col("m.best.lng").alias("lng"),
        F.col("m.tier").alias("match_priority"))
