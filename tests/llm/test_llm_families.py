"""Families hold what can link: a shingle or two shared by chance connect nothing, and no shuffle file outlives its step."""

import random

import numpy as np
import pytest

from railpulse.llm import trie_join
from railpulse.llm.shingles import shingle_set


def brute(texts):
    sets = [set(shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("few, block", [(1, 4), (2, 3), (3, 128)])
def test_sets_that_share_just_enough(spark, monkeypatch, few, block):
    """Short sets, sets of about 80 percent, and passages that many or few texts share, through few and many posts of a shingle."""
    monkeypatch.setattr(trie_join, "FEW", few, raising=False)
    monkeypatch.setattr(trie_join, "BLOCK", block)
    rnd = random.Random(few)
    word = lambda: f"w{rnd.randrange(60)}"
    passage = [word() for _ in range(9)]
    texts = []
    for n in [*range(1, 14), 20, 28, 40]:
        base = [word() for _ in range(n)]
        texts.append(base)
        for _ in range(3):
            own = list(base)
            at = rnd.randrange(len(own) + 1)
            own[at:at] = rnd.choice([[], [word()], [word()]])
            texts.append(own if rnd.random() < 0.7 else own[: -1 - n // 12])
        texts += [base + passage, base * 2] if n > 5 else []
    texts = [" ".join(t) for t in texts]
    rnd.shuffle(texts)
    want = brute(texts)
    got = trie_join.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if texts[r["doc_id"]]} == {i: c for i, c in enumerate(want) if texts[i]}


def test_chance_connects_nothing_and_shuffles_go(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "_levels", lambda *_: np.zeros(trie_join.SLOTS, np.uint8))  # as in a crowded table
    rnd = random.Random(2)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, last = [], words(6)
    for _ in range(30):  # each shares two shingles with the next
        own = words(6)
        texts.append(" ".join(last + words(30) + own))
        last = own
    near = words(60)
    texts += [" ".join(near), " ".join(near[:-1] + ["x"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stored, keep = {}, trie_join.materialize
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def spy(df, name):
        assert spark.conf.get(key) == "true"
        out = keep(df, name)
        stored.setdefault(name, out.count())
        return out

    monkeypatch.setattr(trie_join, "materialize", spy)
    found = trie_join.near_copies(docs)
    assert stored["sources"] == stored["sets"] == 2
    assert sorted(r["doc_id"] for r in found.where("component_id <> doc_id").collect()) == [31]
    assert spark.conf.get(key) == "false"
