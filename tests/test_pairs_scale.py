"""Facts are made of the pairs asked for, and first neighbours of few entries."""

import re

import pytest
from railpulse.operators import graph

EDGE = ("line_code string, from_code string, to_code string, sequence_order int, from_lat double, from_lng double, "
        "to_lat double, to_lng double, travel_time_seconds int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """No join is broadcast because of an estimate, so the dealing shows in the plan."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pair_facts_of_the_pairs_asked_for(shuffled):
    rows = [("L", f"s{i % 7}", f"s{i % 5}", i, 1.0 + i % 7, 2.0, 1.0 + i % 5, 2.0, i) for i in range(35)]
    edges = shuffled.createDataFrame(rows, EDGE)
    wanted = shuffled.createDataFrame([("s1", "s2"), ("s3", "s3"), ("s8", "s9")], "a string, b string")
    every = {(r["a"], r["b"]): r for r in graph.pair_facts(edges).collect()}
    some = graph.pair_facts(edges, wanted)
    assert len(re.findall(r"Exchange hashpartitioning", plan(some))) == 2  # the edges and the pairs
    assert {(r["a"], r["b"]): r for r in some.collect()} == {k: every[k] for k in (("s1", "s2"), ("s3", "s3"))}


def test_many_edges_to_the_first_neighbour_hide_no_second(spark):
    rows = [("L", "a", "b", i, 1.0, 1.0, 2.0, 2.0, i) for i in range(9)] + [("L", "c", "a", 20, 3.0, 3.0, 1.0, 1.0, 7)]
    got = {(r["line_key"], r["station_code"]): r for r in graph.first_neighbours(graph.neighbours(spark.createDataFrame(rows, EDGE))).collect()}
    assert set(got) == {(k, s) for k in ("L", graph.ANY_LINE) for s in "abc"}
    for k in ("L", graph.ANY_LINE):
        assert (got[k, "a"]["nb1"]["code"], got[k, "a"]["nb2"]["code"]) == ("b", "c")
        assert got[k, "b"]["nb1"]["tt"] == 0 and got[k, "b"]["nb2"] is None
