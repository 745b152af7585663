"""Column expressions for the text rules (all JVM built-ins, codegen-friendly).

Regexes use Java syntax.  ``\\z`` replaces ``$`` where the source rule means
"end of input" (Java's ``$`` also matches before a final line break).  Trimming
uses an explicit class: Spark's ``trim`` strips spaces only and Java's ``\\s`` no
blanks beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse.functions.constants import UNKNOWN_COUNTDOWN_RANK


# Fixed value: the blanks of Unicode that the source's trim removes.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Strip leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), rf"^{BLANK}+|{BLANK}+\z", "")


def strip_trailing_dot(c) -> Column:
    """Key trim: one trailing dot removed, then whitespace trimmed."""
    return js_trim(F.regexp_replace(_c(c), r"\.\z", ""))


def blank_to_null(c) -> Column:
    c = _c(c)
    return F.when(c != "", c)


def countdown_rank(c) -> Column:
    """Ordering rank of a countdown: '-' 0, 'due' 1, 'm:ss' 2+seconds, else 999999."""
    c = _c(c)
    mins = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("bigint")
    secs = F.split_part(c, F.lit(":"), F.lit(2)).try_cast("bigint")
    return (F.when(c == "-", F.lit(0).cast("bigint"))
            .when(F.lower(c) == "due", F.lit(1).cast("bigint"))
            .when(c.rlike(r"^[0-9]+:[0-9]+\z"), F.coalesce(  # digits beyond a bigint: as unreadable
                F.try_add(F.try_add(F.try_multiply(mins, F.lit(60)), secs), F.lit(2)),
                F.lit(UNKNOWN_COUNTDOWN_RANK).cast("bigint")))
            .otherwise(F.lit(UNKNOWN_COUNTDOWN_RANK).cast("bigint")))


def countdown_seconds(c) -> Column:
    """Seconds of an 'm:ss' countdown; anything else (incl. 'due', '-', '') is NULL."""
    c = _c(c)
    m = F.regexp_extract(c, r"^([0-9]+):([0-9]+)\z", 1).try_cast("bigint")
    s = F.regexp_extract(c, r"^([0-9]+):([0-9]+)\z", 2).try_cast("bigint")
    return F.when(c.rlike(r"^[0-9]+:[0-9]+\z"), F.try_add(F.try_multiply(m, F.lit(60)), s))


def clean_location_name(c) -> Column:
    """Station name found inside location text, cleaned in the fixed order."""
    c = _c(c)
    c = F.regexp_replace(c, r"(?i)\s+Platform\s+[\d\s\w]+\z", "")
    c = F.regexp_replace(c, r"(?i)\s+Sidings?", "")
    c = F.regexp_replace(c, r"(?i)\s+Depot", "")
    c = F.regexp_replace(c, r"(?i)\s+Yard", "")
    c = F.regexp_replace(c, r"(?i)\s+Junction", "")
    c = F.regexp_replace(c, r"\s*\(.*?\)", "")
    c = F.regexp_replace(c, r"\.+\z", "")
    return js_trim(c)


def clean_lookup_name(c) -> Column:
    """Name cleaning before station matching."""
    c = _c(c)
    c = F.regexp_replace(c, r"(?i) Underground Station", "")
    c = F.regexp_replace(c, r"(?i) Station", "")
    c = F.regexp_replace(c, r"(?i) Platform\s*[\d\w\s]+\z", "")
    c = F.regexp_replace(c, r"\.", "")
    return js_trim(c)


def drop_parens(c) -> Column:
    return F.regexp_replace(_c(c), r"\s*\(.*?\)", "")


def drop_apostrophes(c) -> Column:
    return F.regexp_replace(_c(c), "'", "")


def and_to_amp(c) -> Column:
    return F.regexp_replace(_c(c), r"(?i) and ", " & ")
