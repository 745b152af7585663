"""What passes the driver in the searches over vectors: chunks of a fixed size, and no plan that could broadcast more."""

import numpy as np
from pyspark.core.context import SparkContext
from pyspark.sql import functions as F

from railpulse.llm import permutation_index, segment_topk, vector_blocks


def test_queries_are_sent_in_chunks_and_never_copied(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 32)
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector_blocks, "CHUNK", 1000, raising=False)
    sent = []
    send = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(sum(len(x[3]) for x in value)) or send(self, value))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 10)).astype(np.float32)
    x[200:] = x[:200]  # ties
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = segment_topk.top_products(table, F.col("vec_id") % 4 == 0, k=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    own = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 4):
        scores = own @ own[q]
        order = [int(j) for j in np.lexsort((np.arange(400), -scores)) if j != q][:6]
        assert [got[q, k + 1] for k in range(6)] == [(j, int(scores[j])) for j in order]
    assert len(got) == 6 * 100
    assert len(sent) > 4 and max(sent) < 100 * 10 * 4  # a chunk at a time, for each of two passes; never all


def test_rows_of_one_query_id_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 1)
    rows = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0])] * 3 + [(k, [float(k), float(10 - k)]) for k in range(1, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ask = lambda: sorted(map(tuple, segment_topk.top_products(table, F.col("vec_id") == 0, k=9, scale=1.0).collect()))
    whole = ask()
    monkeypatch.setattr(vector_blocks, "CHUNK", 16, raising=False)
    assert ask() == whole
    products = sorted(((-v, k) for k in range(1, 10) for v in [k] * 3 + [10 - k] * 3))[:9]  # every row of the id ranks in one list
    assert [(r[2], r[3]) for r in whole] == [(k, -v) for v, k in products]


def test_doubles_that_floats_cannot_hold(spark):
    rows = [(k, [1.0 + k * 2.0**-25, 1.0]) for k in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = segment_topk.top_products(table, F.col("vec_id") == 0, k=4, scale=2.0**25).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [4, 3, 2, 1]


def test_the_pivots_sample_alone_reaches_the_driver(spark, monkeypatch):
    """Neither the best rows of every partition nor rows beyond the sample; the same rows as by a plain order."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    table = spark.createDataFrame([(k // 3, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, v array<double>").repartition(6)
    ids = {r["vec_id"] for r in table.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(90).collect()}
    frame, seen = type(table), []
    collect = frame.collect

    def spy(self):
        if "v" in self.columns:
            assert "TakeOrderedAndProject" not in self._jdf.queryExecution().executedPlan().toString()
        seen.append(collect(self))
        return seen[-1]

    monkeypatch.setattr(frame, "collect", spy)
    chosen = permutation_index.choose_pivots(table, 16, 90)
    assert chosen.shape == (16, 4)
    rows = next(s for s in seen if s and "v" in s[0].asDict())
    assert len(rows) == 90 and {r["vec_id"] for r in rows} == ids
    assert permutation_index.choose_pivots(table.where("false"), 16, 90).shape[0] == 0
