"""The ordered fold by composed blocks equals the plain sequential fold."""

import random

import pytest

from railpulse.operators import fold


def brute(xs):
    acc = xs[0]
    for x in xs[1:]:
        acc = (acc + x) // 2
    return acc


@pytest.mark.parametrize("block", [16, 64])
def test_fold_matches_bruteforce(spark, monkeypatch, block):
    """Short keys, full blocks, many levels, constant tails after a smaller head."""
    monkeypatch.setattr(fold, "BLOCK", block)
    rnd = random.Random(block)
    lists = [[rnd.randint(-5_000, 10_000) for _ in range(n)] for n in (1, 2, 15, 16, 17, 63, 64, 65, 200, 5000)]
    lists += [[119] + [120] * 99, [119] + [120] * 2999, [120] * 300 + [119], [7, 8] * 400]
    lists += [[rnd.randint(1, 300)] * rnd.randint(1, 40) + [rnd.randint(1, 300)] * 200 for _ in range(10)]
    rows = [(f"k{k}", i, x) for k, xs in enumerate(lists) for i, x in enumerate(xs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.k: (r.folded, r.n) for r in fold.halving_fold(df, ["k"], ["i"], "v").collect()}
    assert got == {f"k{k}": (brute(xs), len(xs)) for k, xs in enumerate(lists)}
