"""Joins, searches, urls and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from railpulse.llm import permutation_index, segment_topk, trie_join, url_templates
from railpulse.llm.shingles import shingle_set, word_hashes


# ------------------------------------------------------------------- n-gram Jaccard join
def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    size = min(n, len(words))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def families(rng, groups, words=60):
    """Texts in families of near copies, some near the threshold."""
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(rng.choice([1, 1, 2, 3, 9, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.5 else "\t").join(w.upper() if rng.random() < 0.1 else w for w in own))
    return texts


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_word_hashes_follow_words():
    assert len(word_hashes(b"")) == len(word_hashes(b" \t\n\x0b\x0c\r")) == 0
    a, b = word_hashes("Ab  é x\x1cy\n".encode()), word_hashes("aB é\x0bx\x1cy".encode())
    assert len(a) == 3 and (a == b).all() and len(set(a.tolist())) == 3
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1
    assert shingle_set("a b").tolist() != shingle_set("b a").tolist()


def test_tree_links_are_all_links():
    rng = random.Random(6)
    for _ in range(30):
        sets = [shingle_set(t) for t in families(rng, 4)][:60]
        sets.append(np.empty(0, np.uint64))
        want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert trie_join.tree_links(sets) == want
        side = np.array([rng.randint(0, 1) for _ in sets])
        assert trie_join.tree_links(sets, side=side) == [(i, j) for i, j in want if side[i] != side[j]]


@pytest.mark.parametrize("block", [4, 128])
def test_components_match_brute_force(spark, monkeypatch, block):
    """With small blocks every family takes the way of large ones."""
    monkeypatch.setattr(trie_join, "BLOCK", block)
    texts = [None, "", " \n", "one", "one", "one two", *families(random.Random(block), 25), "w1 " * 20_000]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(6, texts[6], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").repartition(5)
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = brute_components(sets)
    got = trie_join.near_copies(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = trie_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_one_of_each_by_id_and_text(spark):
    """Ids that several texts share, none at all, and equal rows: every component keeps one row, no text is lost."""
    rng = random.Random(9)
    texts = families(rng, 25)
    rows = [(rng.choice([None, *range(40)]), t) for t in texts]
    rows += [(1, "a b c d e"), (2, "a b c d e"), (2, "f g h i j"), (3, "f g h i j"), (None, "n o p"), (None, "n o p"), (4, None), (4, ""), (None, None)] + rows[:5]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _own string").repartition(3)
    kept = trie_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    component = brute_components(sets)
    members = {}
    for k, c in component.items():
        members.setdefault(c if sets[k] else ("empty", k), []).append(rows[k])
    assert len(got) == len(members)
    rest = list(got)
    for own in members.values():
        smallest = min((i is None, i or 0) for i, _ in own)
        match = next(r for r in rest if r in own)
        assert (match[0] is None, match[0] or 0) == smallest
        rest.remove(match)
    assert rest == [] and {(1, "a b c d e"), (2, "f g h i j")} <= set(got) and got.count((None, "n o p")) == 1


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert trie_join.near_copies(empty).count() == 0


# ------------------------------------------------------------------- vectors
def vector_rows(rng, n=700, d=12):
    x = rng.normal(size=(n, d))
    x[n // 2:] = x[0] + 0.05 * rng.normal(size=(n - n // 2, d))  # half of all rows in one place
    x[5], x[6] = x[7], x[7]  # ties
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    return x, rows + [(5000, None), (5001, []), (5002, [float("nan")] * d), (5003, [float("inf")] + [0.0] * (d - 1)), (5004, [None] + [0.0] * (d - 1)), (5005, [1.0]), (None, [1.0] * d)]


def test_exact_products(spark, monkeypatch):
    from railpulse.llm import vector_blocks

    monkeypatch.setattr(vector_blocks, "BLOCK", 32)
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 8)
    x, rows = vector_rows(np.random.default_rng(7))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("c"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in segment_topk.top_products(table, F.col("vec_id") % 20 == 0, k=7).collect()}
    own = np.floor(64 * x).astype(np.int64)
    for q in range(0, len(x), 20):
        scores = own @ own[q]
        order = [int(j) for j in np.lexsort((np.arange(len(x)), -scores)) if j != q][:7]
        assert [got[q, k + 1] for k in range(7)] == [(j, int(scores[j])) for j in order]
    assert len(got) == 7 * len(range(0, len(x), 20))
    few = table.where("vec_id < 3 OR vec_id >= 5000")
    assert sorted((r["query_id"], r["rank"]) for r in segment_topk.top_products(few, F.col("vec_id") == 0, k=7).collect()) == [(0, 1), (0, 2)]
    assert segment_topk.top_products(table.where("false"), F.col("vec_id") % 20 == 0, k=7).count() == 0


def test_statistics_bound_products():
    x = np.random.default_rng(8).normal(size=(40, 13))
    for length in segment_topk.LEVELS:
        s = segment_topk.statistics(x, length)
        assert (s @ s.T >= x @ x.T - 1e-9).all()
        assert np.allclose((s * s).sum(axis=1), (x * x).sum(axis=1))


def test_recall_of_the_permutation_index(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = spark.createDataFrame([(90_000, [0.0] * 64), (90_050, None)], "vec_id long, embedding array<float>")
    got = permutation_index.neighbours(table.select("vec_id", "embedding").union(odd), F.col("vec_id") % 50 == 0, k=5).collect()
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    unit = permutation_index.unit(x)
    found = hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        best = [int(ids[j]) for j in np.argsort(-cosine) if j != q][:5]
        own = sorted((r for r in got if r["query_id"] == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - cosine[list(ids).index(r["vec_id"])]) < 1e-12 for r in own)
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        hits += len({r["vec_id"] for r in own} & set(best))
        found += 5
    assert hits / found >= 0.9
    assert not {r["query_id"] for r in got} & {90_000, 90_050}


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(9)
    x, pivots, length = rng.normal(size=(50, 6)), permutation_index.unit(rng.normal(size=(20, 6))), 7
    near = permutation_index.nearest_pivots(x, pivots, length)
    index = permutation_index.Index(x, pivots, length)
    place = np.full((50, 20), length)
    np.put_along_axis(place, near, np.tile(np.arange(length), (50, 1)), 1)
    for i in range(50):
        assert (index.footrule(near[i]) == np.abs(place - place[i]).sum(axis=1)).all()


# ------------------------------------------------------------------- urls
def test_rules_hosts_and_paths(spark):
    from railpulse.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1?x#y", "http://a.www.example.com/en/", "http://xexample.com/en/2", "http://a.net/es/1", "http://net/fr/", "http://a.net/es", "http://a.com", "http://a.com?/x", "http://a.org/b#c", "ftp://H.ORG:80/p q/ü?", "x://y://z/", "http://a.net/es/1", "http://com/" + "a/" * 5000]
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_templates.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3:], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(r), r, v) for v, r in URL_RULES for name, slash, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith(slash + rest)]
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        assert got[k]["rule"] == (max(fits)[1] if fits else None)
        assert got[k]["verdict"] == (max(fits)[2] if fits else "allow")
    assert url_templates.judge(pages.where("false"), URL_RULES).count() == 0


def test_templates_of_blocked_branches_reject(spark):
    """Urls of a labelled branch and an unlabelled one that looks the same stay apart by their purity."""
    rows = [("h", ["ads", "{n}"], "block")] * 60 + [("h", ["news", "{n}"], "allow")] * 60 + [("h", ["ads", "{n}"], None)] * 5 + [("h", ["new", "{n}"], None)] * 5
    rows += [("h", ["t", f"slug-{k}x"], "block") for k in range(60)] + [("h", ["t", "slug-new"], None)]
    learnt = {(r["host"], tuple(r["key"])): (r["template"], r["purity"]) for r in url_templates.templates(spark.createDataFrame(rows, "host string, key array<string>, verdict string")).collect()}
    assert learnt["h", ("ads", "{n}")][1] >= url_templates.REJECT
    assert learnt["h", ("news", "{n}")][1] < 0.3
    assert learnt["h", ("new", "{n}")][1] < url_templates.REJECT
    assert learnt["h", ("t", "slug-new")] == learnt["h", ("t", "slug-1x")] and learnt["h", ("t", "slug-new")][1] >= url_templates.REJECT


def test_small_and_deep_sections_keep_their_labels(spark):
    """Clean sections of a wide host, and those next to a blocked one far down, are not blocked with it."""
    rules = [("block", "a.net/es/"), ("block", "a.net/fr/"), ("block", "d.net/1/2x/3x/4x/5x/ads/"), ("allow", "ok.com/")]
    urls = [f"http://a.net/{s}/p{k}" for s in ("es", "fr") for k in range(20)] + [f"http://a.net/s{c}x/p{k}" for c in "abcdefghijklmnopqrstuvwxyz" for k in range(20)]
    urls += [f"http://d.net/1/2x/3x/4x/5x/{s}/p{k}" for s in ("ads", "news") for k in range(40)] + [f"http://ok.com/p{k}" for k in range(700)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        blocked = any(x in url for x in ("/es/", "/fr/", "/ads/"))
        assert got[k]["verdict"] == ("block" if blocked else "allow"), (url, got[k])


# ------------------------------------------------------------------- pipeline
def test_stages_of_the_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    one = pipeline.copies(spark, docs, sf)
    want = brute_components({i: shingles(t) for i, t in texts.items()})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in want if want[i] == i)
    clean = pipeline.personal(spark, docs, sf)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
    assert pipeline.packing(spark, docs.limit(0), sf).count() == 0
