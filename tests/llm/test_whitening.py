"""Whitening against numpy on all vectors at once."""

import numpy as np
import pytest

from pactum.llm import whitening as W

ROW = "vec_id long, embedding array<float>"


def brute(vectors, components=W.COMPONENTS):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    n = len(x)
    y = n * x.astype(object) - x.sum(0).astype(object)
    dev = [int(sum(v * v for v in r)) for r in y]
    c = y.astype(float) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-12 * e.max()).sum()))
    return dev, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def check(rows, vectors, ids):
    dev, white, share = brute(vectors)
    n, k = white.shape
    assert len(rows) == n * k
    table = {(r.vec_id, r.component): r for r in rows}
    sign = np.sign([table[ids[0], j + 1].whitened * white[0, j] for j in range(k)])
    for i, vec_id in enumerate(ids):
        for j in range(k):
            r = table[vec_id, j + 1]
            assert (r.n, r.deviation) == (n, dev[i])
            assert r.whitened == pytest.approx(sign[j] * white[i, j], abs=1e-8) and r.explained == pytest.approx(share[j], rel=1e-8)
            assert 0 <= r.identity_error < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (500, 40)) @ rng.normal(0, 0.4, (40, 40)) + rng.normal(0, 3, 40)
    vectors[100:260] = vectors[100]  # a common vector
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], ROW).repartition(7)
    check(W.whiten(rows).collect(), vectors, list(range(500)))


def test_broken_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(0, 1, (30, 3)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROW + ", vector string, n int, component int")
    check(W.whiten(df).collect(), good, list(range(30)))


def test_ids_keep_their_rows(spark):
    rows = [(None, [0.0, 1.0]), (None, [3.0, 1.5]), (5, [1.0, 7.0]), (5, [1.0, 7.0])]
    got = W.whiten(spark.createDataFrame(rows, ROW)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1), (5, 1), (5, 2), (5, 2)]
    assert len({r.whitened for r in got if r.vec_id == 5 and r.component == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = W.whiten(spark.createDataFrame(rows, ROW))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_a_direction_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = W.whiten(spark.createDataFrame(rows, ROW)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9


def test_merge_of_far_means():
    rng = np.random.default_rng(5)
    parts = [rng.normal(m, 1, (n, 4)) for m, n in ((1e6, 3), (1e6 + 5, 50), (0, 0), (1e6 - 9, 1))]
    total = W.moments(parts[0])
    for p in parts[1:]:
        total = W.merged(total, W.moments(p))
    want = W.moments(np.concatenate(parts))
    assert total[0] == want[0] and np.allclose(total[1], want[1], rtol=1e-14) and np.allclose(total[2], want[2], rtol=1e-9)


def test_exact_numbers_beyond_a_long():
    m = W.Whitening(10**10, [10**19, 0], np.ones(1), np.eye(2)[:1], 1.0)
    assert m.deviation(np.array([[10**9, 1]])) == [10**20] or m.deviation(np.array([[10**9, 1]])) == [None]
    assert m.centred(np.array([[10**9 + 1, 0]])).tolist() == [[10**10, 0]]


def test_query(spark, tmp_path):
    vectors = np.random.default_rng(6).normal(0, 1, (60, 35)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], ROW + ", label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(W.op13_whitening(spark, str(tmp_path)).collect(), vectors, list(range(60)))
