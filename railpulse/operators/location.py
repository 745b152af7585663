"""Free-text location parsing (C4, F3, F5) as one ordered ``when`` chain.

First match wins, case-insensitive:

0 blank -> unknown
1 ``Between X and Y`` (split at the first " and ") -> between
2 ``At Platform`` -> at, no station
3 ``At X [Platform n] [Siding(s)]`` -> at
4 ``Approaching X [Platform n]`` -> approaching
5 ``Left X`` / ``Departed X`` -> left
6 ``Leaving X`` -> left
7 ``Held [at] X`` -> at
8 anything else -> unknown

Station names are cleaned (``clean_location_name``); a name that cleans to
the empty string counts as no station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.text import blank_to_null, clean_location_name, js_trim

RE_BETWEEN = r"(?i)^Between\s+(.+?)\s+and\s+(.+)\z"
RE_AT_PLATFORM = r"(?i)^At\s+Platform\z"
RE_AT = r"(?i)^At\s+(.+?)(?:\s+Platform\s+[\d\s\w]+)?(?:\s+Sidings?)?\z"
RE_APPROACHING = r"(?i)^Approaching\s+(.+?)(?:\s+Platform\s+[\d\s\w]+)?\z"
RE_LEFT = r"(?i)^(?:Left|Departed)\s+(.+)\z"
RE_LEAVING = r"(?i)^Leaving\s+(.+)\z"
RE_HELD = r"(?i)^Held\s+(?:at\s+)?(.+)\z"


def _name(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(clean_location_name(F.regexp_extract(text, pattern, group)))


_PATTERNS = [("between", RE_BETWEEN), ("at_platform", RE_AT_PLATFORM), ("at", RE_AT),
             ("appr", RE_APPROACHING), ("left", RE_LEFT), ("leaving", RE_LEAVING),
             ("held", RE_HELD)]


def location_columns(text) -> dict[str, Column]:
    """``loc_type``, ``loc_station1``, ``loc_station2`` for a location text column.

    Single-expression form (each regex may be evaluated more than once);
    ``with_location`` evaluates every pattern once in a projection of its own.
    """
    t = F.col(text) if isinstance(text, str) else text
    flags = {f"_m_{k}": t.rlike(p) for k, p in _PATTERNS}
    flags["_m_blank"] = t.isNull() | (js_trim(t) == "")
    return _typed(t, flags)


def _typed(t: Column, m) -> dict[str, Column]:
    blank = m["_m_blank"]
    loc_type = (F.when(blank, "unknown").when(m["_m_between"], "between")
                .when(m["_m_at_platform"], "at").when(m["_m_at"], "at")
                .when(m["_m_appr"], "approaching").when(m["_m_left"], "left")
                .when(m["_m_leaving"], "left").when(m["_m_held"], "at").otherwise("unknown"))
    s1 = (F.when(blank, None).when(m["_m_between"], _name(t, RE_BETWEEN, 1))
          .when(m["_m_at_platform"], None)
          .when(m["_m_at"], _name(t, RE_AT)).when(m["_m_appr"], _name(t, RE_APPROACHING))
          .when(m["_m_left"], _name(t, RE_LEFT)).when(m["_m_leaving"], _name(t, RE_LEAVING))
          .when(m["_m_held"], _name(t, RE_HELD)))
    s2 = F.when(~blank & m["_m_between"], _name(t, RE_BETWEEN, 2))
    return {"loc_type": loc_type, "loc_station1": s1, "loc_station2": s2}


def with_location(df: DataFrame, text: str = "current_location") -> DataFrame:
    """Add the parsed location; match flags are computed once, then dropped."""
    t = F.col(text)
    flags = {f"_m_{k}": t.rlike(p) for k, p in _PATTERNS}
    flags["_m_blank"] = t.isNull() | (js_trim(t) == "")
    d = df.withColumns(flags)
    d = d.withColumns(_typed(t, {k: F.col(k) for k in flags}))
    return d.drop(*flags)


def next_station_label(loc_type: Column, s1: Column, s2: Column, fallback: Column) -> Column:
    """Display label of the next station."""
    return (F.when(loc_type == "at", F.coalesce(s1, blank_to_null(fallback)))
            .when(loc_type == "approaching", s1)
            .when(loc_type == "between", s2))


def parse_locations(df: DataFrame, text: str = "current_location",
                    station_col: str = "station_name") -> DataFrame:
    """C4 job: parsed location plus the next-station label."""
    out = with_location(df, text)
    label_fallback = F.regexp_replace(F.col(station_col), r"\.\z", "")
    return out.withColumn("next_station", next_station_label(
        F.col("loc_type"), F.col("loc_station1"), F.col("loc_station2"), label_fallback))
