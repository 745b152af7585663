"""Jacobi-Davidson against a full eigendecomposition, and whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from railpulse.llm import queries, whitening
from railpulse.llm.jacobi_davidson import largest, minres

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# ----------------------------------------------------------------- the solver
def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    b = rng.standard_normal((40, 3))
    b[:, 1] = 0
    x = minres(lambda z: a @ z, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-6 and not x[:, 1].any()


@pytest.mark.parametrize("dims", [1, 5, 64, 200])
@pytest.mark.parametrize("spectrum", ["falling", "flat", "multiple", "deficient"])
def test_largest_pairs(dims, spectrum):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    e = {"falling": np.arange(1, dims + 1) ** -1.0, "flat": np.linspace(1, 1.5, dims), "multiple": np.r_[np.full(dims // 3, 5.0), np.ones(dims - dims // 3)], "deficient": np.r_[np.exp(-np.arange(dims - dims // 2)), np.zeros(dims // 2)]}[spectrum]
    v = (q * e) @ q.T
    passes = []
    values, vectors = largest(lambda u: (passes.append(u.shape[1]), v @ u)[1], dims, 12)
    k = min(12, dims)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() < 1e-13 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * e.max()
    assert max(passes) <= 2 * k + 8  # never the whole matrix beyond the small cases


def test_a_short_search_space_is_cut_back():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    v = (q * np.linspace(1, 2, 150)) @ q.T
    values, _ = largest(lambda u: v @ u, 150, 5, max_basis=18)
    assert np.abs(values - np.linspace(2, 1, 150)[:5]).max() < 1e-13


def test_no_end_is_an_error():
    rng = np.random.default_rng(0)
    with pytest.raises(ArithmeticError):
        largest(lambda u: rng.standard_normal(u.shape), 30, 3, max_outer=5)


# ----------------------------------------------------------------- on Spark
def brute(vectors, components=32):
    """vec_id -> whitened values (signs free), deviation; shares of the trace."""
    x = np.array([np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for _, v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = np.array((n * x - s) / n, float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-10 * e[0]).sum()))
    return c @ (u[:, :k] / np.sqrt(e[:k])), [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], e[:k] / e.sum()


def run_query(spark, tmp_dir, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    if extra:
        for c in ("id", "x", "n", "component", "whitened", "data"):
            df = df.withColumn(c, F.lit("other"))
    df.write.parquet(f"{tmp_dir}/embeddings.parquet")
    out = queries.op11_jacobi_davidson(spark, tmp_dir)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def test_query_against_numpy(spark, tmp_dir):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(c)) for c in rng.standard_normal(40) * np.linspace(2, 0.1, 40)]) for i in range(300)]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39)]
    got = run_query(spark, tmp_dir, vectors + odd, extra=True)
    whitened, deviation, shares = brute(vectors)
    assert len(got) == 300 * 32
    table = np.array([r[4] for r in got]).reshape(300, 32)
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * signs - whitened).max() < 1e-9
    assert [r[3] for r in got[::32]] == deviation and {r[2] for r in got} == {300}
    assert np.abs(np.array([r[5] for r in got[:32]]) - shares).max() < 1e-12
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10


def test_repeated_rows_null_ids_and_short_vectors(spark, tmp_dir):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [5.0]), (3, []), (3, [0.5, 0.25])]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got.write.parquet(f"{tmp_dir}/embeddings.parquet")
    got = queries.op11_jacobi_davidson(spark, tmp_dir).orderBy(F.col("vec_id").asc_nulls_first(), "component", "whitened").collect()
    padded = [(i, (v + [0.0, 0.0])[:2]) for i, v in rows]
    whitened, deviation, _ = brute(padded)
    assert len(got) == 12
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for k in (1, 2):
        assert np.allclose(sorted(abs(r["whitened"]) for r in got if r["component"] == k), sorted(np.abs(whitened[:, k - 1])))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, tmp_dir, rows):
    assert run_query(spark, tmp_dir, rows) == []


def test_deficient_rank_has_fewer_components(spark, tmp_dir):
    got = run_query(spark, tmp_dir, [(k, [float(k % 7), 2.0 * (k % 7), float(k % 3), 4.0]) for k in range(50)])
    assert {r[1] for r in got} == {1, 2} and got[0][6] < 1e-10


def test_huge_entries(spark, tmp_dir):
    got = run_query(spark, tmp_dir, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])
    assert {r[3] for r in got if r[0] != 3} == {None} and all(np.isfinite(r[4]) for r in got)


def test_blocks_of_one_row_and_the_same_bits_again(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 3)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, rng.integers(-50, 50, 3).tolist()) for k in range(40)], "vec_id long, x array<long>").repartition(3)
    a, m = whitening.whiten(rows, components=2)
    assert m.n == 40 and len(m.values) == 2 and a.count() == 40
    blocks = whitening.materialize(whitening._blocks(rows.withColumnRenamed("vec_id", "id"), 3, 0), "again")
    one, two = (whitening.fit(b, 40, 3, 2) for b in (blocks, blocks.repartition(7)))
    assert one.sums == two.sums and np.allclose(one.values, two.values, rtol=1e-14)
