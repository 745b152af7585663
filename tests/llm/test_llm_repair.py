"""Conversation repair: the grammar's shortest path against all edit sequences, and Spark against a plain walk."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from railpulse.llm import conversation_repair, queries
from railpulse.llm import repair_grammar as rg

GOAL = re.compile("(s?(ua)+)?")


def try_all(symbols):
    """The cheapest edits and of these the ASCII-least, from every sequence of edits."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
        for edits in itertools.product("DKR", repeat=len(symbols)):
            for roles in itertools.product("ua", repeat=sum(inserts) + edits.count("R")):
                cost, audit, out, role = 0, "", "", iter(roles)
                for k, symbol in enumerate([*symbols, None]):
                    cost, audit = cost + 3 * inserts[k], audit + "I" * inserts[k]
                    out += "".join(next(role) for _ in range(inserts[k]))
                    if symbol is None:
                        break
                    fault = rg.FAULTS[symbol % 4]
                    audit += edits[k]
                    if edits[k] == "D":
                        cost += 4
                        continue
                    if fault in ("blank", "duplicate"):
                        cost += 1 << 20
                    cost += 3 * (fault == "truncated") + 3 * (edits[k] == "R")
                    out += rg.ROLES[symbol // 4] if edits[k] == "K" else next(role)
                if GOAL.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def walk(symbols):
    """The same by a walk over states, row by row, without grammar or matrices."""

    def put(new, out, value):
        # all that matters of what was put out: nothing, a leading s, or the last role
        if out not in new or value < new[out]:
            new[out] = value

    def may(last, role):
        return {"": role in "su", "s": role == "u", "u": role == "a", "a": role == "u"}[last] if role in "sua" else False

    def inserted(layer):
        todo = list(layer.items())
        for _ in range(3):
            for last, (cost, audit) in todo:
                for role in "ua":
                    if may(last, role):
                        put(layer, role, (cost + 3, audit + "I"))
            todo = list(layer.items())
        return layer

    layer = inserted({"": (0, "")})
    for symbol in symbols:
        role, fault, new = rg.ROLES[symbol // 4], rg.FAULTS[symbol % 4], {}
        for last, (cost, audit) in layer.items():
            put(new, last, (cost + 4, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            if may(last, role):
                put(new, role, (cost, audit + "K"))
            for other in "ua":
                if may(last, other):
                    put(new, other, (cost + 3, audit + "R"))
        layer = inserted(new)
    return min(layer[x] for x in ("", "a") if x in layer)


def fold(symbols, grammar):
    f = rg.Fold(grammar)
    for c in grammar.compress("".join(chr(rg.BASE + s) for s in symbols)):
        f.push(ord(c) - rg.BASE)
    return f


def learnt(sequences, rounds=10, per_round=6):
    grammar, texts = rg.Grammar(), ["".join(chr(rg.BASE + s) for s in q) for q in sequences]
    for _ in range(rounds):
        for pair, n in sorted(rg.pairs(((t, 1) for t in texts), grammar).items(), key=lambda x: (-x[1], x[0]))[:per_round]:
            if n > 1:
                grammar.add(*(ord(c) - rg.BASE for c in pair))
    return grammar


# ----------------------------------------------------------------- the grammar
@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_sequence_against_all_edits(n):
    for symbols in itertools.product(range(16), repeat=n):
        expected = try_all(symbols)
        assert walk(symbols) == expected and fold(symbols, rg.Grammar()).end() == expected, symbols


def test_some_of_three_against_all_edits():
    rng = random.Random(3)
    for _ in range(25):
        symbols = [rng.randrange(16) for _ in range(3)]
        assert walk(symbols) == try_all(symbols) == fold(symbols, rg.Grammar()).end()


def test_rules_change_nothing():
    rng = random.Random(7)
    sequences = [[rng.choice([4, 8, 4, 8, 0, 5, 9, 6, 7, 11, rng.randrange(16)]) for _ in range(rng.choice([0, 1, 3, 8, 8, 40, 300]))] for _ in range(150)]
    grammar = learnt(sequences)
    assert len(grammar.rules) > 30 and any(left >= rg.TERMINALS for left, _ in grammar.rules)
    for q in sequences:
        f = fold(q, grammar)
        assert f.end() == walk(q)
        assert f.rows == len(q) and f.faults == tuple(sum(rg.FAULTS[s % 4] == k for s in q) for k in ("blank", "duplicate", "truncated"))
        r = "".join(rg.ROLES[s // 4] for s in q)
        assert f.unlawful == sum(r[k:k + 2] not in rg.LAWFUL for k in range(len(r) - 1))


def test_long_runs_are_short_in_the_grammar():
    grammar = learnt([[7] * 4096, [4, 8] * 2048], rounds=14, per_round=2)
    assert len(grammar.compress(chr(rg.BASE + 7) * 4096)) < 64
    assert fold([7] * 4096, grammar).end() == (4 * 4096, "D" * 4096)
    assert fold([4, 8] * 2048, grammar).end() == (0, "K" * 4096)


def test_output_follows_the_audit():
    assert list(rg.output("KIKD", "saa")) == [("", "K", None), ("u", "K", None), ("", "D", None), ("", "", None)]
    assert list(rg.output("RRI", "xx")) == [("", "R", "u"), ("", "R", "a"), ("u", "", None)]


# ----------------------------------------------------------------- Spark
def digest(text):
    return hashlib.sha256(text.encode()).digest()


def brute(rows):
    """conv_id -> the contract's columns, from original rows."""
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        damaged += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    result = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[3])))
        turns = {r[1] for r in own if r[1] is not None}
        symbols, seen, counts = [], set(), dict.fromkeys(rg.FAULTS, 0)
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append("suao".index(role[:1] if role[:1] in ("s", "u", "a") else "o") * 4 + rg.FAULTS.index(fault))
        initials = [r[2][:1] for r in own]
        cost, audit = walk(symbols)
        lines, row, last = [], 0, ""
        for e in audit:
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if e == "I":
                lines.append(role + ":")
            else:
                if e != "D":
                    role = own[row][2] if e == "K" else role
                    lines.append(f"{role}:{own[row][3]}")
                row += 1
            last = role[:1] if e != "D" else last
        result[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                        sum((a + b) not in rg.LAWFUL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def made(rng, conv, n):
    rows, role = [], "user"
    for turn in range(n):
        text = rng.choice(["A b.", "Ça va?", "No end", "", " \t\n", "So!  ", "x.y", "é" * 3 + ".", f"own {turn}."])
        role = rng.choice(["user", "assistant", "assistant" if role == "user" else "user", "system", "tool", "uhu", ""]) if rng.random() < 0.3 else ("assistant" if role == "user" else "user")
        rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice([role] * 9 + [None]), rng.choice([text] * 9 + [None])))
    return rows


def check(spark, folder, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        for c in ("pos", "sha", "blank", "symbol", "audit", "cost", "part", "first", "copy", "fault"):
            df = df.withColumn(c, F.lit("other"))
    df.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    out = queries.op13_repair_grammar(spark, folder)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == brute(rows) and out.count() == len(got)


def test_query(spark, tmp_dir):
    rng = random.Random(5)
    rows = [r for conv in [*range(60), None] for r in made(rng, conv, rng.choice([1, 2, 4, 8, 8, 30]))]
    check(spark, tmp_dir, rows + rows[:40], extra=True)


def test_one_long_conversation_over_many_blocks(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 7)
    monkeypatch.setattr(conversation_repair, "SLICE", 5)
    rng = random.Random(6)
    check(spark, tmp_dir, made(rng, 1, 400) + made(rng, 2, 3) + [(3, 5, "user", "Same.")] * 40)


def test_all_rows_dropped_and_odd_keys(spark, tmp_dir):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check(spark, tmp_dir, [(gone, 0, "user", "Hi."), (None, None, None, None), (-1, 1 << 62, "user", "a."), (-1, -(1 << 62), "assistant", "b." * 50_000)])


def test_empty_table(spark, tmp_dir):
    check(spark, tmp_dir, [])


def test_repaired_rows(spark):
    rows = [("x", 1, "assistant", "Second."), ("x", 0, "system", "First."), ("y", 0, "user", "Alone?"), ("z", 0, "user", " ")]
    out = conversation_repair.repair(spark.createDataFrame(rows, "chat string, n int, who string, said string"), "chat", "n", "who", "said")
    assert {r["conv_id"]: (r["n_rows"], r["cost"], r["audit"]) for r in out.conversations.collect()} == {"x": (2, 3, "KIK"), "y": (1, 3, "KI"), "z": (1, 4, "D")}
    assert [tuple(r)[0::3] + (r["text"],) for r in out.rows.orderBy("conv_id", "pos", "part").collect()] == [("x", "system", "First."), ("x", "user", ""), ("x", "assistant", "Second."), ("y", "user", "Alone?"), ("y", "assistant", "")]
