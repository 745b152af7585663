"""Golden cases lifted from the reference's comments and docs."""

import pytest
from pyspark.sql import functions as F

from railpulse.functions import text
from railpulse.operators import location, names, refdata
from railpulse.operators.fold import halving_fold

LOCATIONS = [
    ("At Chiswick Park Platform 1", "at", "Chiswick Park", None),
    ("Approaching Mile End", "approaching", "Mile End", None),
    ("Left St James's Park", "left", "St James's Park", None),
    ("Between Acton Town and Ealing Common", "between", "Acton Town", "Ealing Common"),
    ("At Northfields Sidings", "at", "Northfields", None),
    ("Departed Morden", "left", "Morden", None),
    ("Between Elephant and Castle and Lambeth North", "between", "Elephant",
     "Castle and Lambeth North"),
    ("At Platform", "at", None, None),
    ("At Platform 2", "at", "Platform 2", None),
    ("Held at Oval", "at", "Oval", None),
    ("Held Oval", "at", "Oval", None),
    ("Leaving Bank (Northern Line)", "left", "Bank", None),
    ("Approaching Bank Platform 1 and 2", "approaching", "Bank", None),
    ("In transit", "unknown", None, None),
    ("   ", "unknown", None, None),
    (None, "unknown", None, None),
    ("At Ealing Depot", "at", "Ealing", None),
    ("At Foo...", "at", "Foo", None),
]


def test_location_grammar(spark):
    df = spark.createDataFrame([(t,) for t, *_ in LOCATIONS], "t string")
    out = df.withColumns(location.location_columns("t")).collect()
    for row, (t, typ, s1, s2) in zip(out, LOCATIONS):
        assert (row.loc_type, row.loc_station1, row.loc_station2) == (typ, s1, s2), t


def test_countdown_rank_and_seconds(spark):
    vals = ["2:30", "0:30", "-", "due", "DUE", "", None, "bogus", "1:5", "2:30\n"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    rows = df.select(text.countdown_rank("c").alias("r"),
                     text.countdown_seconds("c").alias("s")).collect()
    assert [r.r for r in rows] == [152, 32, 0, 1, 1, 999999, 999999, 999999, 67, 999999]
    assert [r.s for r in rows] == [150, 30, None, None, None, None, None, None, 65, None]


def test_aliases_and_priorities(spark):
    stations = spark.createDataFrame([
        ("E1", "Edgware Road (Circle Line)", 1.0, 1.0, ["H"]),
        ("E2", "Edgware Road (Bakerloo)", 2.0, 2.0, ["B"]),
        ("H1", "Heathrow Terminals 2 & 3", 3.0, 3.0, ["P"]),
        ("S1", "St. James's Park", 4.0, 4.0, ["D"]),
        ("K1", "King's Cross St. Pancras", 5.0, 5.0, ["N"]),
        ("B1", "Bank", 6.0, 6.0, ["N"]),
        ("B2", "Bankside Long", 7.0, 7.0, ["N"]),
        ("A1", "Elephant & Castle", 8.0, 8.0, ["N"]),
    ], "code string, name string, lat double, lng double, lines array<string>")
    queries = {
        "Edgware Road (H & C).": ("E1", 0),
        "Heathrow Terminals 123": ("H1", 0),
        "St James's Park": ("S1", 0),
        "Kings Cross St Pancras": ("K1", 3),
        "Bank Underground Station": ("B1", 0),
        "Ban": ("B1", 2),
        "Elephant and Castle": ("A1", 1),
        "Cross": ("K1", 5),
        "Nowhere": (None, None),
        ".": ("B1", 2),
    }
    n = spark.createDataFrame([(q,) for q in queries], "name string")
    got = {r.name: (r.code, r.match_priority)
           for r in names.resolve_names(n, stations).collect()}
    assert got == queries


def test_folded_average_not_mean(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([100, 120, 90])],
                               "k string, i int, v int")
    r = halving_fold(df, ["k"], ["i"], "v").collect()[0]
    assert r.folded == 100 and r.n == 3


def test_half_even_minutes(spark):
    # minute values whose double product with 60 is exactly x.5: 2.5 s -> 2, 4.5 s -> 4,
    # 1.5 s -> 2 (Python round() semantics, half to even)
    cum = [0.041666666666666664, 0.041666666666666664 + 0.075]
    df = spark.createDataFrame([
        ("L", "A", 0, 0, 1, "B", cum[0]), ("L", "A", 0, 0, 2, "C", cum[1]),
        ("L", "A", 0, 1, 1, "D", 0.025)],
        "line_code string, departure string, route_idx int, set_idx int, interval_idx int, "
        "stop_id string, time_to_arrival double")
    got = {(r.from_code, r.to_code): r.seconds for r in refdata.segment_times(df).collect()}
    assert got == {("A", "B"): round(cum[0] * 60), ("B", "C"): round((cum[1] - cum[0]) * 60),
                   ("A", "D"): 2}
    assert got[("A", "B")] == 2


def test_between_fraction_example():
    # "Between Acton Town and Ealing Common", 0:30 left, default 120 s -> 75 % along
    secs, seg = 30, 120
    assert max(0, min(1, 1 - secs / seg)) == 0.75
