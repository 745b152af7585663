"""Prefixes of texts that share a passage hold none of it where enough else is in them."""

import random

import numpy as np
from pyspark.sql import functions as F

from railpulse.llm import trie_join
from railpulse.llm.shingles import WORDS, shingle_set


def test_a_common_passage_leaves_the_prefixes(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    passage = words(100)
    texts = [f"{passage} {words(100)}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    level = trie_join._levels(docs, WORDS, 64)
    common = shingle_set(passage)
    for text in texts:
        own = shingle_set(text)
        prefix = trie_join.in_order(own, level)[:trie_join.prefix_length(len(own))]
        assert not np.isin(prefix, common).any()


def test_classes_that_can_link_no_more_are_taken_away(spark):
    rows = [(1, 10, True, 0, 100, 1), (1, 11, True, 0, 100, 1), (1, 12, False, 19, 100, 2), (1, 13, False, 21, 100, 3),
            (2, 10, True, 5, 100, 1), (2, 11, True, 5, 100, 1)]
    placed = spark.createDataFrame(rows, "token long, sig long, core boolean, place int, size long, label long")
    able = trie_join._able(placed, 80).select("token", "sig", F.col("widest").cast("long")).collect()
    assert sorted(map(tuple, able)) == [(1, 10, 125), (1, 11, 125), (1, 12, 82)]
