import math

import numpy as np
import pytest

from tablewright.llm import whitening as f


def close(a, v, x):
    """Residual, orthogonality and the values themselves against the dense solver."""
    assert np.abs(a @ x - x * v).max() <= 1e-13 * max(1, np.abs(a).max())
    assert np.abs(x.T @ x - np.eye(len(a))).max() <= 1e-13
    assert np.abs(v - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * max(1, np.abs(a).max()) * len(a)


@pytest.mark.parametrize("values", [
    list(range(1, 33)),
    [5.0, 5.0, 5.0, 1.0, 1.0, 0.5],  # equal eigenvalues
    [1.0 + i * 1e-9 for i in range(12)] + [7.0, 0.1],  # closer than float32 can tell
    [3.0, 3.0 + 1e-12, 2.0, 1e-12, 0.0, 0.0],
    [1e6, 1.0, 1e-6],
])
def test_eigen(values):
    random = np.random.default_rng(1)
    q = np.linalg.qr(random.normal(size=(len(values), len(values))))[0]
    a = q * np.array(values) @ q.T
    a = (a + a.T) / 2
    close(a, *f.eigen(a))


def test_close_vectors_are_told_apart():
    random = np.random.default_rng(3)
    q = np.linalg.qr(random.normal(size=(20, 20)))[0]
    values = np.array([9.0 + 1e-7 * i for i in range(5)] + list(range(20, 35)), float)
    a = q * values @ q.T
    got = f.eigen((a + a.T) / 2)[1]
    for place, i in enumerate(np.argsort(-values)):
        assert abs(abs(got[:, place] @ q[:, i]) - 1) < 1e-12


def test_float32_alone_would_not_do():
    random = np.random.default_rng(2)
    a = random.normal(size=(64, 200))
    a = a @ a.T
    plain = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(plain.T @ plain - np.eye(64)).max() > 1e-8
    close(a, *f.eigen(a))


def test_given_rows(spark, given):
    rows = given("embeddings").collect()
    good = [(r.vec_id, [math.floor(1024 * c) + 100000 for c in r.embedding]) for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n = len(good)
    sums = [sum(c) for c in zip(*(x for _, x in good))]
    y = np.array([x for _, x in good], float) - np.array(sums) / n
    v = y.T @ y / n
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    out = f.whiten(given("embeddings")).collect()
    assert len(out) == 8 * n
    got = {(r.vec_id, r.component): r for r in out}
    for (i, x), centred in zip(good, y):
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(1, 9):
            r = got[i, k]
            assert (r.n, r.deviation, r.deviation_text) == (n, exact, str(exact))
            assert abs(abs(r.whitened) - abs(centred @ vectors[:, k - 1]) / math.sqrt(values[k - 1])) < 1e-6
            assert abs(r.explained - values[k - 1] / np.trace(v)) < 1e-10 and r.identity_error < 1e-9
    w = np.array([[got[i, k].whitened for k in range(1, 9)] for i, _ in good])
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 0.5) for r in rows], "vec_id long, embedding array<float>, component int, dim string, whitened double")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [3.0, -1.0]), (6, [3.0, -1.0]), (None, [0.5]), (8, [])]
    out = f.whiten(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((i, k) for i in ("1", "6", "6", "8", "None") for k in (1, 2))
    assert {r.n for r in out} == {5} and all(r.identity_error < 1e-9 for r in out)
    x = [[1024, 2048], [3072, -1024], [3072, -1024], [512, 0], [0, 0]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((5 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in zip((1, 6, 6, None, 8), x)}
    assert all(r.deviation == want[r.vec_id] for r in out)


def test_no_variance_gives_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]):
        assert f.whiten(frame(spark, rows)).collect() == []


def test_beyond_a_long(spark):
    rows = [(i, [1e9 * i, float(-i)]) for i in range(40)] + [(99, [3e38, 1.0])]
    out = f.whiten(frame(spark, rows)).collect()
    assert len(out) >= 41 and all(r.deviation is None or str(r.deviation) == r.deviation_text for r in out)
    assert any(r.deviation is None and int(r.deviation_text) > 2**63 for r in out)
