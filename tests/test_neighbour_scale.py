"""First neighbours and facts of station pairs against plain Python."""

from railpulse.operators import graph

SCHEMA = ("line_code string, from_code string, to_code string, sequence_order int, from_lat double, from_lng double, "
          "to_lat double, to_lng double, travel_time_seconds int")


def edge(line, a, b, seq, tt=None):
    at = {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}
    return line, a, b, seq, at[a], -at[a], at[b], -at[b], tt


ROWS = [edge("L", "a", "b", 1, 60), edge("L", "b", "a", 0), edge("L", "a", "a", 2), edge("L", "c", "a", 3, 9),
        edge("M", "a", "b", 0, 70), edge("M", "d", "a", 1, 5), edge(None, "a", "d", 7, 3)]


def entries(line, station):
    """Neighbour entries of a station, first one first."""
    out = []
    for ln, a, b, seq, alat, alng, blat, blng, tt in ROWS:
        if line is not None and ln != line:
            continue
        order = (seq, ln or "", a, b)
        if a == station:
            out.append((order, b, blat, 120 if tt is None else tt))
        elif b == station:
            out.append((order, a, alat, 120 if tt is None else tt))
    return sorted(out)


def flat(n):
    return n and (n["code"], n["lat"], n["tt"])


def test_first_neighbours_of_lines_and_of_all(spark):
    got = {(r["line_key"], r["station_code"]): r for r in
           graph.first_neighbours(graph.neighbours(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    keys = {(k, s) for k in ("L", "M", graph.ANY_LINE) for s in "abcd" if entries(None if k == graph.ANY_LINE else k, s)}
    assert set(got) == keys
    for k, s in keys:
        es = entries(None if k == graph.ANY_LINE else k, s)
        second = next((e for e in es if e[1] != es[0][1]), None)
        assert flat(got[k, s]["nb1"]) == es[0][1:]
        assert flat(got[k, s]["nb2"]) == (second and second[1:])


def test_pair_facts_in_one_row_and_one_pass(spark):
    facts = graph.pair_facts(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r["a"], r["b"]): r for r in facts.collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")}
    for (a, b), r in got.items():
        for line, f in [*r["lines"].items(), (None, r["any"])]:
            for station, other, e in ((a, b, f["at_a"]), (b, a, f["at_b"])):
                assert flat(e) == next(x[1:] for x in entries(line, station) if x[1] == other)
    assert got["a", "b"]["lines"]["L"]["seg"]["tt"] is None and got["a", "b"]["any"]["seg"]["tt"] is None
    assert got["a", "d"]["lines"]["M"]["seg"]["tt"] == 5 and "L" not in got["a", "d"]["lines"]
