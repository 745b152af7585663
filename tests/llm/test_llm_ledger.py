"""Secret scan against the patterns as they are stated, and what the ledger scans again."""

import dataclasses
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from railpulse.llm import blob_ledger, queries

KINDS = {
    "assign": (re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
}
HEX = "0123456789abcdef01234567"
TEXTS = [
    "", None, "nothing here", "é token = \"" + HEX + "\" ü", "PassWord:abcdef passwd=abc secret='k.k.k.k' api_key= 12345 APIKEY:=x123456",
    "token=token: abcdefgh", "tokentoken = abcdef token:token=token=abcdef", "AKIA" + "A" * 16, "AKIAAKIA" + "0" * 11, "xAKIA" + "Z" * 15 + " AKIA" + "9" * 40,
    HEX, HEX[:-1], "g" + HEX * 3 + "G" + HEX, "ſecret=abcdefgh toKen=abcdefgh", "𝄞𝄞 secret: abc+/_.=-def 𝄞 " + HEX + "\n\npassword   =   zzzzzz",
    "-----BEGIN RSA PRIVATE KEY-----\nMIIE", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "ghp_" + "A" * 36 + " ghp_" + "A" * 35, "xoxb-1234567890-abc", "AIza" + "x" * 35,
    "https://user:pa55@example.com/ http://example.com:80/@", "secret=" + "a" * 5, "secret=" + "a" * 6,
]


def base(text):
    text = text or ""
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(text) if ok(m))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in found]


def all_spans(text):
    return [f"{k}:{s}:{e}" for _, k, s, e in blob_ledger.find((text or "").encode(), blob_ledger.compiled(blob_ledger.RULES))]


@pytest.mark.parametrize("text", TEXTS)
def test_base_rules_are_the_stated_ones(text):
    found = [f for f in all_spans(text) if f.split(":")[0] in KINDS]
    assert sorted(found) == sorted(base(text))


def test_further_rules():
    kinds = [sorted({f.split(":")[0] for f in all_spans(t)} - set(KINDS)) for t in TEXTS[15:21]]
    assert kinds == [["private_key"], ["jwt"], ["github"], ["slack"], ["google"], ["login"]]


@pytest.mark.parametrize("unit", ["eyJ-", "gh", "ghp_", "xoxb-", "AKIA", "token=", "token", "0a", "://a", "://a:", "-----BEGIN A ", "password   ", "secret = "])
def test_long_texts_take_linear_time(unit):
    text = (unit * (2_000_000 // len(unit))).encode()
    began = time.perf_counter()
    blob_ledger.find(text, blob_ledger.compiled(blob_ledger.RULES))
    assert time.perf_counter() - began < 20


def run_query(spark, folder, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("blob", "spans", "rules", "missing", "batch", "seen"):
            df = df.withColumn(c, F.lit("other"))
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return queries.op12_blob_ledger(spark, folder)


@pytest.mark.parametrize("limit", [blob_ledger.BROADCAST_BLOBS, 0])
def test_query(spark, tmp_dir, monkeypatch, limit):
    monkeypatch.setattr(blob_ledger, "BROADCAST_BLOBS", limit)
    rows = [*enumerate(TEXTS), *[(100 + k, t) for k, t in enumerate(TEXTS)], (3, TEXTS[3]), (None, TEXTS[4]), (None, None), *[(1000, TEXTS[10])] * 30]
    out = run_query(spark, tmp_dir, rows, extra=True)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    expected = []
    for i, t in rows:
        b = base(t)
        count = [sum(x.startswith(k + ":") for x in b) for k in KINDS]
        expected.append((i, *count, hashlib.sha256(",".join(b).encode()).hexdigest(), ",".join(sorted(all_spans(t), key=lambda f: (int(f.split(":")[1]), [r.kind for r in blob_ledger.RULES].index(f.split(":")[0]))))))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)


def test_empty_table(spark, tmp_dir):
    assert run_query(spark, tmp_dir, []).collect() == []


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, text string")


def test_only_unseen_pairs_are_scanned(spark, tmp_dir):
    ledger = blob_ledger.Ledger(spark, tmp_dir + "/ledger")
    one = versions(spark, [("a", 1, "token=abcdefg"), ("a", 2, "clean"), ("b", 1, "token=abcdefg"), ("c", 1, None)])
    keys = ["path", "version"]
    assert ledger.scan(one, "1", keys) == 3
    two = versions(spark, [("a", 3, "clean"), ("d", 1, "token=abcdefg"), ("e", 1, HEX)])
    assert ledger.scan(two, "2", keys) == 1
    assert ledger.scan(two, "2", keys) == 1  # the same batch again ends in the same state
    assert ledger.scan(one, "3", keys) == 0
    hit = {(r["path"], r["version"], r["batch"]): [s["kind"] for s in r["spans"]] for r in ledger.report().collect()}
    assert len(hit) == 11 and {k: v for k, v in hit.items() if v} == {("a", 1, "1"): ["assign"], ("b", 1, "1"): ["assign"], ("d", 1, "2"): ["assign"], ("e", 1, "2"): ["hex"], ("a", 1, "3"): ["assign"], ("b", 1, "3"): ["assign"]}
    assert ledger.scans().where("batch = '2'").count() == 1


def test_a_changed_rule_alone_scans_old_blobs(spark, tmp_dir):
    ledger = blob_ledger.Ledger(spark, tmp_dir + "/ledger")
    rows = versions(spark, [("a", 1, "token=abcdefg " + HEX), ("b", 1, "pin 1234")])
    keys = ["path", "version"]
    assert ledger.scan(rows, "1", keys) == 2
    changed = (*blob_ledger.RULES[:2], dataclasses.replace(blob_ledger.RULES[2], pattern="[0-9a-f]{4,}"), *blob_ledger.RULES[3:])
    assert ledger.scan(rows, "2", keys, rules=changed) == 2
    assert {tuple(r["rules"]) for r in ledger.scans().where("batch = '2'").collect()} == {(changed[2].version,)}
    kinds = lambda rules: {r["path"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in ledger.report("1", rules).collect()}
    assert kinds(blob_ledger.RULES) == {"a": [("assign", 0), ("hex", 14)], "b": []}
    assert kinds(changed) == {"a": [("assign", 0), ("hex", 6), ("hex", 14)], "b": [("hex", 4)]}
    assert ledger.scan(rows, "3", keys, rules=changed) == 0
