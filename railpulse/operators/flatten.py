"""Flatten raw XML snapshot messages into one row per train prediction.

The same function serves batch DataFrames and streaming DataFrames: it is a
stateless projection (``from_xml`` + three ``inline`` levels), so in a
streaming query it runs in append mode inside each micro-batch.

* value (binary or string) is parsed with the declared snapshot schema; a
  malformed, empty or NULL document yields no rows (``S`` is NULL).
* surrounding spaces in attribute values are kept, as written;
* a missing attribute becomes '' (never NULL);
* the line code is taken from the ``line_code`` header by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.schemas import SNAPSHOT_XML

XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}

OUTPUT_COLUMNS = ["station_code", "station_name", "platform_name", "platform_code",
                  "trip_number", "set_number", "time_to_station", "destination",
                  "current_location", "line_code"]


def header_value(headers: str | Column, key: str) -> Column:
    """Value of the first header named ``key`` as a string (NULL if absent)."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.get(F.filter(h, lambda x: x["key"] == key), 0)["value"].cast("string")


def flatten_predictions(raw: DataFrame, value: str = "value", headers: str = "headers",
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw messages -> flat prediction rows (plus any ``keep`` columns)."""
    doc = F.from_xml(F.col(value).cast("string"), SNAPSHOT_XML, XML_OPTIONS)
    lvl0 = raw.select(*keep, header_value(headers, "line_code").alias("line_code"),
                      F.explode(doc["S"]).alias("s"))
    lvl1 = lvl0.select(*keep, "line_code", F.col("s._Code").alias("sc"),
                       F.col("s._N").alias("sn"), F.explode("s.P").alias("p"))
    lvl2 = lvl1.select(*keep, "line_code", "sc", "sn", F.col("p._N").alias("pn"),
                       F.col("p._Code").alias("pc"), F.explode("p.T").alias("t"))

    def attr(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return lvl2.select(
        *keep,
        attr("sc").alias("station_code"), attr("sn").alias("station_name"),
        attr("pn").alias("platform_name"), attr("pc").alias("platform_code"),
        attr("t._T").alias("trip_number"), attr("t._S").alias("set_number"),
        attr("t._C").alias("time_to_station"), attr("t._DE").alias("destination"),
        attr("t._L").alias("current_location"), "line_code")
