import numpy as np
import pytest

from larkspur.llm import embeddings
from tests.compare import duck_rows, spark_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string"


def rows_of(seed=0, n=150, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(10, dim))
    rows = []
    for k in range(n):
        v = base[k % 10] + rng.normal(0, [0.02, 0.15, 0.4][k % 3], dim)
        rows.append((k, v.astype(np.float32).tolist(), None if k % 11 == 0 else int(k % 10) % 3, "x"))
    rows += [(500 + k, rows[1][1], rows[1][2], "copy") for k in range(30)]
    rows += [(600, None, 1, ""), (601, [0.0] * dim, 1, ""), (602, [float("nan")] * dim, 1, ""), (603, [1.0, None] * (dim // 2), 1, ""), (604, [float("inf")] * dim, 1, ""), (605, [], 1, ""), (606, [1.0] * (dim - 1), 1, "")]
    return rows


def brute(rows):
    good = [(k, np.array(v, dtype=float), lab) for k, v, lab, _ in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[:i]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((k, n[k], find(k), k == find(k)) for k in n)


def test_equals_sql(spark, duck, sf):
    df = embeddings.query(spark, sf)
    assert spark_rows(df) == duck_rows(duck, embeddings.SQL, df.columns)


def test_equals_brute_force(spark):
    rows = rows_of()
    assert sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    rows = rows_of(3)
    assert sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_at_the_limits_of_a_double(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [5e-324, 1e-323], 1), (4, [-1.0, 2.0], 1), (5, [0.0, -0.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (None, 3, 1, False)]


@pytest.mark.parametrize("dim", [3, 16, 64, 100, 384])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, dim))
    noise = rng.normal(size=x.shape)
    y = x + np.linspace(0, 0.6, 400)[:, None] * noise
    a, b = embeddings.Codes.of(x), embeddings.Codes.of(y)
    cosine = x @ y.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
    estimate = a.estimates(b)
    factor, rest = a.factors[:, 0, None], b.factors[None, :, 1]
    assert (np.abs(estimate - cosine) <= (np.sqrt(np.maximum(1 - factor**2, 0)) * np.sqrt(np.maximum(1 - cosine**2, 0)) + rest) / factor + 1e-9).all()
    if dim >= 16:
        assert abs((estimate - cosine).mean()) < 0.02
    near = a.near(b, 0.98)
    assert (near | (cosine < 0.98)).all()
    # what the bound leaves of the pairs that do not link
    print(f"{dim} components: {(near & (cosine < 0.98)).mean():.4f} of all pairs recomputed for nothing")
    assert dim < 64 or near.mean() < 0.05
    assert (a.near(b, 0.98, 6.0) <= near).all() or dim < 37
