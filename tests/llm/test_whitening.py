import numpy as np
import pytest

from larkspur.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string"


def brute(rows, most=4):
    """(vec_id, component) -> n, deviation, |whitened|, explained, by a library's eigenvalues."""
    x = {}
    for k, v, _ in rows:
        if v and None not in v and np.isfinite(v).all():
            x.setdefault(k, []).append(np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int))
    fit = np.unique(np.array([v for many in x.values() for v in many]), axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    out = []
    for k, many in x.items():
        for v in many:
            for c in range(min(most, len(mean))):
                e = values[::-1][c]
                if e > 1e-9:
                    deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, fit.sum(axis=0), strict=True))
                    out.append((k, c + 1, n, deviation, abs((v - mean) @ vectors[:, ::-1][:, c]) / np.sqrt(e), e / values.sum()))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-8, atol=1e-9)


def rows_of(seed, n=120, dim=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(2, 0.2, dim) + 3
    rows = [(k, v.astype(np.float32).tolist(), "x") for k, v in enumerate(x)]
    rows += [(500 + k, rows[1][1], "copy") for k in range(60)] + [(None, rows[2][1], ""), (7, rows[3][1], "")]
    return rows + [(600, None, ""), (601, [], ""), (602, [float("nan")] * dim, ""), (603, [1.0, None] + [1.0] * (dim - 2), ""), (604, [float("inf")] * dim, "")]


def test_query_equals_a_library(spark, sf):
    got = whitening.query(spark, sf).collect()
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(got, brute(rows))
    assert len(got) == 4 * len(rows) and {r.identity_error for r in got}.pop() < 1e-10


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    same(got, brute(rows))
    assert max(r.identity_error for r in got) < 1e-10


def test_lengths_stand_alone(spark):
    rows, short = rows_of(3), [(900 + k, [float(k % 5), float(k * k % 7)], "") for k in range(20)]
    got = whitening.whitened(spark.createDataFrame(rows + short, SCHEMA)).collect()
    same([r for r in got if r.vec_id is None or r.vec_id < 900], brute(rows))
    same([r for r in got if r.vec_id and r.vec_id >= 900], brute(short))


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0], "") for k in range(5)], SCHEMA)
    assert whitening.whitened(df).count() == 0
    assert whitening.whitened(df.limit(0)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0], "") for k in range(6)], SCHEMA)
    got = whitening.whitened(line).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(k, 1) for k in range(6)]
    assert got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9


def test_values_that_a_long_does_not_hold(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], ""), (2, [-1.0, 1.0], ""), (3, [0.5, 2.0], "")], "vec_id bigint, embedding array<double>, x string")
    got = whitening.whitened(df, 1).collect()
    assert len(got) == 3 and all(r.deviation is None for r in got) and got[0].explained == pytest.approx(1)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_counts_are_those_of_a_library(n):
    rng = np.random.default_rng(n)
    for trial in range(40):
        a = rng.normal(size=(n, n))
        a = a + a.T
        if trial % 3 == 0:
            a = np.round(a)
        if trial % 5 == 0:
            np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        for shift in rng.normal(size=5) * 3:
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [4, 4, 4, 1, 0.5], [1, 1 - 1e-12, 1e-3, 1e-6, 1e-9], [1, 1 + 1e-7, 1 + 2e-7, 1 + 3e-7, 0.1], [3, 0, 0, 0, 0], [1e8, 1, 1, 1e-2, 1e-2]])
def test_leading_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(5, 5)))
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    got, axes = whitening.leading(a, 4)
    want = np.sort(np.array(values, dtype=float))[::-1][:4]
    want = want[want > 1e-12 * sum(values)]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-15 * sum(values))
    np.testing.assert_allclose(axes @ axes.T, np.eye(len(got)), atol=1e-9)
    np.testing.assert_allclose(a @ axes.T, axes.T * got, atol=1e-13 * sum(values))
