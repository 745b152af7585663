"""Text operators against brute force, with nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railpulse.llm import byte_bpe, compress_quality, histogram_packing, license_dice, pii_bootstrap, subword_langid
from railpulse.llm.common import held_out, parse_ranks, read_small_file

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "É 漢字 😀", "x" * 30_000, " " * 50_000 + "end", "same text here", "same text here"]


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(read_small_file(MULTI)), special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, IDS string")


# ------------------------------------------------------------------- byte-level BPE
def test_cutting_changes_no_ids(encoder, monkeypatch):
    import regex

    monkeypatch.setattr(byte_bpe, "_BLANKS", regex.compile(r"\s{3,}"))
    rng = random.Random(1)
    parts = ["a", "B", "é", "1", "٣", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "!", "漢", "\x1c", "́", "😀", "\x85"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        pieces = list(byte_bpe.cut(text, 2))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def test_transcode_is_a_round_trip(spark, encoder, odd):
    rows = byte_bpe.transcode(odd, MULTI).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "ids", "decoded"]
    for r in rows:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        if len(r["text"] or "") < 40_000:  # the library cannot take the long blanks whole
            assert r["ids"] == encoder.encode_ordinary(r["text"] or "")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(byte_bpe.encode(odd, MULTI), MULTI).orderBy("doc_id").collect()] == [(t or "").encode() for t in ODD]
    assert byte_bpe.transcode(odd.where("false"), MULTI).count() == 0


# ------------------------------------------------------------------- packing
def test_plain_characters_tokenise_alike():
    tok = histogram_packing.JsonTokenizer(read_small_file(JSON))
    plain = [chr(c) for c in range(0x3000) if histogram_packing._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 600
    for c in plain:
        for text in (c, f"a{c}b", f"1{c} {c}'s", f" {c}{c} x"):
            assert tok.exact.encode(text, add_special_tokens=False).ids == tok.fast.encode_ordinary(text), repr(text)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randint(1, 64): rng.randint(1, 200) for _ in range(rng.randint(0, 30))}
        placed = {}
        for lengths, n in histogram_packing.plan(histogram, 64):
            assert 0 < sum(lengths) <= 64 and n > 0
            for length in lengths:
                placed[length] = placed.get(length, 0) + n
        assert placed == histogram


def test_packing_is_whole_and_gapless(spark):
    texts = [*ODD[:5], "word " * 3000, "<|endoftext|> is text", *["same text here"] * 40]
    docs = spark.createDataFrame([(k // 2, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, offset int")
    packed = histogram_packing.pack_documents(docs, JSON, seq_len=128)
    rows = packed.collect()
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = []
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k // 2, s, ids[s:s + 128].tobytes(), len(ids)) for s in range(0, len(ids), 128)]
    assert sorted((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in rows) == sorted(want)
    upto = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == upto.get(r["sequence_id"], 0)
        upto[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(upto.values()) <= 128 and sorted(upto) == list(range(len(upto)))
    whole = histogram_packing.sequences(packed).collect()
    assert {r["sequence_id"]: r["length"] for r in whole} == upto
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(upto.values())
    assert histogram_packing.pack_documents(docs.where("false"), JSON).count() == 0


# ------------------------------------------------------------------- personal data
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "phone":
            return 10 <= len(digits) <= 15
        if kind == "card":
            terms = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(t - 9 if t > 9 else t for t in terms) % 10 == 0
        return True

    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if passes(kind, m.group()))


def test_base_spans_and_redaction_match_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "B", "1", "22", "255", "256", "4", "@", ".", "-", "+", " ", "  ", "(", ")", "_", "é", "\n", "😀", "4539 1488 0343 6467", "1.2.3.4", "x@y.z", "+1 (234) 555-1234", "%", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "same 1.2.3.4", "same 1.2.3.4", "a@b.c " * 3000]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, kind int").repartition(3)
    base = F.filter("spans", lambda s: s["base"])
    got = {r["doc_id"]: r["b"] for r in pii_bootstrap.extract(docs).select("doc_id", pii_bootstrap.joined(base).alias("b")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(docs, min_score=2.0).collect()}
    for k, text in enumerate(texts):
        spans = plain_spans(text)
        assert got[k] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans), repr(text)
        if text is None:
            assert clean[k] is None
            continue
        out, upto = "", 0
        for a, _, kind, b in spans:
            if b > upto:
                out, upto = out + text[upto:max(a, upto)] + f"[{kind.upper()}]", b
        assert clean[k] == out + text[upto:]
    assert pii_bootstrap.extract(docs.where("false")).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please write to mailbox: user{k}@host{k}.org thanks" for k in range(12)]
    texts = [*seeds, "please write to mailbox: user7(at)host.org thanks", "chapter 12 of the book", "mailbox: none thanks"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in pii_bootstrap.extract(docs).collect()}
    at = texts[12].index("user7")
    assert got[12] == [("email", at, at + len("user7(at)host.org"), False)]
    assert got[13] == [] and got[14] == []
    assert all(len(got[k]) == 1 and got[k][0][3] for k in range(12))


# ------------------------------------------------------------------- quality
def test_quality_separates_held_out_documents(spark):
    rng = random.Random(4)
    words = ["river", "stone", "garden", "paper", "window", "morning", "slowly", "under", "bright", "letter"]
    texts = {k: (" ".join(rng.choice(words) for _ in range(60)) if k % 2 else "BUY!! " + " | ".join(rng.choice(words).upper() + "!!" for _ in range(60))) for k in range(400)}
    docs = spark.createDataFrame([*texts.items(), (900, None), (901, ""), (902, "same"), (902, "same")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in texts] + [(0, 1), (1, None)], "doc_id long, quality int")
    settings = compress_quality.Settings(dict_docs=60, curve_docs=80)
    model = compress_quality.fit(docs, labels, ~held_out(), settings)
    rows = compress_quality.predict(docs, model).withColumn("held", held_out()).collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 for r in rows)
    fold = [r for r in rows if r["held"] and r["doc_id"] < 400]
    assert len(fold) > 50 and all(r["predicted"] == r["doc_id"] % 2 for r in fold)
    assert len({r["score"] for r in rows if r["doc_id"] == 902}) == 1
    assert {r["score"] for r in rows if r["doc_id"] == 900} == {r["score"] for r in rows if r["doc_id"] == 901}
    one = compress_quality.fit(docs, labels.where("quality = 1"), ~held_out(), settings)
    assert min(r["score"] for r in compress_quality.predict(docs, one).collect()) > 0.99
    none = compress_quality.fit(docs, labels.where("false"), ~held_out(), settings)
    assert {round(r["score"], 6) for r in compress_quality.predict(docs, none).collect()} == {0.5}


# ------------------------------------------------------------------- language
def test_language_of_held_out_documents(spark):
    rng = random.Random(5)
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["krzt", "wvyk", "plmq", "zzt"], "zz": ["αβγ", "δεζ", "ηθι"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "123 !? _", None), (903, "lorem " * 40_000, None), (904, "amet", "xx"), (904, "amet", "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("rejected", F.lit(1))
    model = subword_langid.fit(docs, ~held_out())
    got = subword_langid.predict(docs, model).withColumn("held", held_out()).collect()
    fold = [r for r in got if r["held"] and r["doc_id"] < 300]
    assert len(fold) > 40 and all(r["lang_pred"] == r["lang"] for r in fold)
    for r in got:
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (903, 904)] == ["xx"] * 3
    empty = subword_langid.fit(docs.where("false"), ~held_out())
    assert {r["lang_pred"] for r in subword_langid.predict(docs, empty).collect()} == {"und"}


def test_blocks_lose_no_subword_but_those_across_a_cut():
    settings = subword_langid.Settings()
    text = "abc def " * 20_000
    whole = subword_langid.subwords(subword_langid._letters(text), settings)
    assert subword_langid.histogram(text, settings).sum() == len(whole)


# ------------------------------------------------------------------- licences
def test_license_scan_matches_brute_force(spark):
    mit = license_dice.TEMPLATES["MIT"]
    texts = ["Released under the MIT License.", "intro\nReleased under the  MIT-License!\nend", mit, mit.replace("Software", "Program", 3).upper(), "Licensed under CC BY-SA 4.0", "nothing of the kind here", "license", None, "", "All rights reserved. All rights reserved.", "Released under the MIT License.", "x " * 30_000 + "\nAll rights reserved."]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, n string")
    got = sorted((r["doc_id"], r["line"], r["license"], r["dice"], r["n_bigrams"]) for r in license_dice.scan(docs).collect())

    def grams(text):
        words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text)).split()
        return {" ".join(words[k:k + 2]) for k in range(len(words) - 1)} if len(words) > 1 else set(words)

    want = []
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        for line, unit in enumerate([text or "", *lines] if len(lines) > 1 else [text or ""]):
            u = grams(unit)
            for name, template in license_dice.TEMPLATES.items():
                t = grams(template)
                if u and 2 * len(u & t) / (len(u) + len(t)) >= 0.8:
                    want.append((k, line, name, round(2 * len(u & t) / (len(u) + len(t)), 6), len(u)))
    assert got == sorted(want) and len(got) >= 7
    assert license_dice.scan(docs.where("false")).count() == 0


def test_a_licence_many_times_over_takes_no_longer_than_its_length(spark):
    import time

    mit, took = license_dice.TEMPLATES["MIT"], []
    for n in (2, 2, 60):
        began = time.perf_counter()
        found = license_dice.scan(spark.createDataFrame([(1, "\n".join([mit] * n))], "doc_id long, text string")).collect()
        took.append(time.perf_counter() - began)
        assert [(r["line"], r["license"], r["dice"]) for r in sorted(found, key=lambda r: r["line"])][1:] == [(k, "MIT", 1.0) for k in range(1, n + 1)]
    assert took[2] < 5 * took[1] + 20


def test_license_windows_within_longer_texts(spark):
    mit, bsd = license_dice.TEMPLATES["MIT"], license_dice.TEMPLATES["BSD-2-Clause"]
    wrap = lambda text, mark, k=9: "\n".join(mark + " ".join(text.split()[i:i + k]) for i in range(0, len(text.split()), k))
    code = "\n".join(f"value{k} = compute{k}(argument{k}, other{k})" for k in range(400))
    texts = [
        f"# Copyright 2020 Acme\n#\n{wrap(mit, '# ')}\n{code}",
        f"{code}\n{wrap(bsd.replace('CONTRIBUTORS', 'AUTHORS'), ' * rem ')}\n{code}\n{wrap(mit, '// ')}",
        "This project is licensed under the Apache License, Version 2.0. See the file named so for what that says.",
        "first\nCopyright 2020 Acme Inc. All rights reserved.\nCopyright 2021 Other Inc. All rights reserved. Call us or write for any question.",
        "license of the software, all of the rights are granted and the copyright is reserved " * 200,
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[2])], "doc_id long, text string")
    got = license_dice.scan(docs, license_dice.TEMPLATES).collect()

    def best(text, name):
        split = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).split()
        grams = lambda t: [" ".join(p) for p in zip(split(t), split(t)[1:])]
        u, t = grams(text), grams(license_dice.TEMPLATES[name])
        hit, b, top = set(t), len(set(t)), (0, 0)
        for i in (k for k, g in enumerate(u) if g in hit):
            seen = set()
            for g in u[i:i + len(t) * 3 // 2]:
                seen.add(g)
                top = max(top, (2 * len(seen & hit) / (len(seen) + b), -len(seen))) if g in hit else top
        return round(top[0], 6), -top[1]

    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["line"], r["license"], r["dice"], r["n_bigrams"]) for r in got)
    want = [(0, 3, "MIT"), (1, 401, "BSD-2-Clause"), (1, 401 + len(wrap(bsd, "").split("\n")) + 400, "MIT"), (2, 1, "Apache-2.0 statement"), (3, 2, "All rights reserved"), (3, 3, "All rights reserved")]
    assert rows == [((False, k), line, name, *best(texts[k], name)) for k, line, name in want] + [((True, 0), 1, "Apache-2.0 statement", *best(texts[2], "Apache-2.0 statement"))]


def test_license_names_of_versions_and_wordings(spark):
    from railpulse.llm.license_texts import TEXTS

    lines = {
        "Licensed under the MIT License.": "MIT statement",
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0 statement",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0 statement",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 statement",
        "This work is licensed under the GNU General Public License.": "GPL statement",
        "// SPDX-License-Identifier: GPL-2.0-only": "SPDX GPL-2.0-only",
        "# SPDX-License-Identifier: Apache-2.0": "SPDX Apache-2.0",
        "int main() { SPDX-License-Identifier: MIT and much more of other words }": "SPDX MIT",
        "Distributed under the BSD 3-Clause License": "BSD-3-Clause statement",
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0 statement",
        "You may use it under the terms of the sea.": None,
    }
    texts = dict(license_dice.MORE)
    bsd = texts["BSD-3-Clause"]
    whole = {bsd: "BSD-3-Clause", license_dice.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause", **{v: k for k, v in TEXTS.items()}}
    other = lambda word: " ".join(f"{word}{k}" for k in range(4000))
    inner = {other("before") + "\n" + "\n".join(TEXTS[k].split(". ")) + "\n" + other("after"): k for k in ("GPL-2.0", "Apache-2.0")}
    want = [*lines.items(), *whole.items(), *inner.items()]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(want)], "doc_id long, text string")
    got = license_dice.scan(docs).collect()
    for k, (text, name) in enumerate(want):
        found = [(r["line"], r["license"]) for r in got if r["doc_id"] == k]
        if text in inner:
            assert (2, name) in found, (name, found)
        elif text in whole:
            assert [f[1] for f in found if f[0] == 0] == [name], (name, found)
        else:
            assert [f[1] for f in found] == ([name] if name else []), (text, found)


def test_a_line_that_matches_gives_no_window_across_it(spark):
    text = "some words before that say what it is\nLicensed under the Apache License, Version 2.0.\nand many other words behind it"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["line"], r["license"], r["dice"]) for r in license_dice.scan(docs).collect()] == [(2, "Apache-2.0 statement", 1.0)]


# ------------------------------------------------------------------- registered queries
def test_op3_and_op9_digests(spark, encoder):
    from railpulse.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    tok = Tokenizer.from_file(JSON)
    for r in QUERIES["op9_histogram_packing"](spark, sf).collect():
        ids = np.array([*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()))
