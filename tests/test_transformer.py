"""The encoder against loops over single positions, its gradients against differences, its training on a planted table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import encoding as en
from larkspur.operators import transformer as tr

S = tr.Shape(items=7, genres=3, width=8, heads=2, layers=2, length=6, dropout=0.0)
FLAGS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 0, 0], [1, 0, 1], [0, 1, 1]], dtype=float)
IDS = np.array([[1, 2, 3, 0, 0], [4, 5, 6, 7, 1], [2, 0, 3, 1, 0]])
LABELS = np.array([[2, 3, 4, 0, 0], [5, 6, 7, 1, 2], [0, 3, 1, 2, 0]])


def shaken(seed=0):
    w = tr.drawn(S, seed)
    rng = np.random.default_rng(9)
    for k in w:
        w[k] = w[k] + rng.normal(0, 0.1, w[k].shape)
    w["item"][0] = 0
    return w


def one_by_one(w, ids):
    """(length, width): each position by loops, from the definitions."""
    d, heads = S.width, S.heads
    norm = lambda v, g, b: (v - v.mean()) / np.sqrt(v.var() + 1e-5) * g + b
    x = []
    for t, i in enumerate(ids):
        both = np.concatenate([w["item"][i], FLAGS[i] @ w["genre"] + w["genre_b"]])
        x.append(both @ w["into"] + w["into_b"] + w["place"][t])
    for k in range(S.layers):
        y = []
        for t in range(len(x)):
            out = np.zeros(d)
            for h in range(heads):
                c = slice(h * d // heads, (h + 1) * d // heads)
                part = lambda v, n: (v @ w[f"{k}.qkv"] + w[f"{k}.qkv_b"])[n * d : (n + 1) * d][c]
                seen = [u for u in range(t + 1) if ids[u] != 0 or u == t]
                e = np.exp([part(x[t], 0) @ part(x[u], 1) / np.sqrt(d / heads) for u in seen])
                out[c] = sum(a * part(x[u], 2) for a, u in zip(e / e.sum(), seen, strict=True))
            y.append(norm(x[t] + out @ w[f"{k}.out"] + w[f"{k}.out_b"], w[f"{k}.norm1"], w[f"{k}.norm1_b"]))
        x = [norm(v + np.maximum(v @ w[f"{k}.up"] + w[f"{k}.up_b"], 0) @ w[f"{k}.down"] + w[f"{k}.down_b"], w[f"{k}.norm2"], w[f"{k}.norm2_b"]) for v in y]
    return np.stack([norm(v, w["norm"], w["norm_b"]) for v in x])


def test_batches_equal_single_positions():
    w = shaken()
    h, _ = tr.body(w, S, tr.entered(w, IDS, FLAGS[IDS]), IDS != 0)
    for row, ids in zip(h, IDS, strict=True):
        np.testing.assert_allclose(row, one_by_one(w, ids), atol=1e-10)


def test_later_items_and_padding_do_not_matter():
    w = shaken()
    ids = np.array([[1, 2, 3]])
    h = lambda ids: tr.body(w, S, tr.entered(w, ids, FLAGS[ids]), ids != 0)[0][0]
    np.testing.assert_allclose(h(np.array([[1, 2, 7]]))[:2], h(ids)[:2])
    np.testing.assert_allclose(h(np.array([[1, 2, 3, 0, 0]]))[:3], h(ids))
    assert np.isfinite(h(np.array([[0, 0, 3]]))).all()


def differences(loss, w, step=1e-6):
    rng = np.random.default_rng(3)
    for name in sorted(w):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in w[name].shape)
            if name == "item" and at[0] == 0:
                continue
            keep = w[name][at]
            w[name][at] = keep + step
            up = loss()
            w[name][at] = keep - step
            down = loss()
            w[name][at] = keep
            yield name, at, (up - down) / (2 * step)


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_agree_with_differences(dropout):
    s = tr.Shape(**{**S.__dict__, "dropout": dropout, "temperature": 0.5})
    w = shaken()
    rng = lambda: np.random.default_rng(5) if dropout else None  # noqa: E731  the same cells each time
    last = (IDS != 0).shape[1] - 1 - np.argmax((IDS != 0)[:, ::-1], axis=1)
    masked = np.where(np.random.default_rng(1).random(IDS.shape) < 0.3, 0, IDS)
    losses = {
        "entropy": (lambda g=None: tr.cross_entropy(w, s, IDS, FLAGS, LABELS, g, rng())[0]),
        "contrast": (lambda g=None: tr.contrastive(w, s, IDS, masked, last, FLAGS, g, 1.0, rng())),
    }
    for name, loss in losses.items():
        g = {}
        loss(g)
        checked = 0
        for part, at, want in differences(loss, w):
            got = g[part][at] if part in g else 0.0
            assert abs(got - want) < 1e-5 * max(1, abs(want)), (name, part, at)
            checked += abs(want) > 1e-6
        assert checked > 60


def planted(spark, users=60, items=30, n=40, seed=0):
    """Sequences whose next item is its fixed successor four times in five."""
    after = np.random.default_rng(7).permutation(items) + 1
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(users):
        seq = [int(rng.integers(1, items + 1))]
        while len(seq) < n:
            seq.append(int(after[seq[-1] - 1]) if rng.random() < 0.8 else int(rng.integers(1, items + 1)))
        rows.append((seq,))
    return tr.pairs(spark.createDataFrame(rows, "items array<bigint>"))


def test_tasks_add_up_to_one(spark):
    s = tr.Shape(items=30, genres=2, width=8, layers=1, length=20, dropout=0.0, contrast=0.0)
    w, flags = tr.drawn(s), np.zeros((31, 2))
    rows = planted(spark)
    one, told = tr.summed(tr.spread(rows, 1), w, s, flags, 1, 16)
    many, same = tr.summed(tr.spread(rows, 5), w, s, flags, 1, 7)
    np.testing.assert_allclose(same, told)
    for k in one:
        np.testing.assert_allclose(many[k], one[k], atol=1e-12)


def test_training_beats_the_most_common_items(spark):
    s = tr.Shape(items=30, genres=2, width=16, heads=2, layers=1, length=40, dropout=0.1, rate=1e-2)
    flags = np.zeros((31, 2))
    flags[1:16, 0] = flags[16:, 1] = 1
    train, valid = planted(spark), planted(spark, users=80, seed=1)
    w, history = tr.trained(train, valid, s, flags, epochs=16, every=8, steps=3, batch=20)
    ours, plain = tr.measured(valid, w, s, flags, k=3)[0], tr.popular(train, valid, k=3)
    print(f"recall at 3: {ours:.2f}, of the most common items {plain:.2f}")
    assert ours > plain + 0.3
    assert history[-1]["ce"] < history[0]["ce"] - 0.5 and history[-1]["recall"] is not None and history[0]["recall"] is None
    again, _ = tr.trained(train, valid, s, flags, epochs=1, every=1, steps=3, batch=20)
    first, _ = tr.trained(train, valid, s, flags, epochs=1, every=1, steps=3, batch=20)
    assert all((again[k] == first[k]).all() for k in first)


def test_training_ends_when_nothing_improves(spark):
    s = tr.Shape(items=30, genres=2, width=8, layers=1, length=10, rate=0.0, patience=2)
    rows = planted(spark, users=10, n=8)
    assert len(tr.trained(rows, rows, s, np.zeros((31, 2)), epochs=20, every=1, steps=1)[1]) == 3


def test_encoded_contexts_equal_single_ones(spark):
    w = shaken()
    items = spark.createDataFrame([(100 + i, i, np.flatnonzero(FLAGS[i]).tolist()) for i in range(1, 8)], "movie_id bigint, item_idx bigint, genres array<bigint>")
    rng = np.random.default_rng(0)
    contexts = [(u, e, (100 + rng.integers(1, 8, rng.integers(1, 7))).tolist()) for u in range(3) for e in range(40)]
    df = spark.createDataFrame(contexts, "user_id bigint, event_id bigint, items array<bigint>")
    body = tr.layers(w)
    got = {(r.user_id, r.event_id): r.vec for r in en.encoded(df, tr.entries(items, w), many=lambda c: tr.encode_all(body, S, c), batch=9).collect()}
    assert len(got) == len(contexts)
    for u, e, ids in contexts:
        np.testing.assert_allclose(got[u, e], one_by_one(w, np.array(ids) - 100)[-1], atol=1e-10)


def test_last_pairs_hold_out_the_latest(spark):
    rows = [(1, float(t), 10 + t, t, t == 4) for t in range(5)] + [(2, float(t), 20 + t, 9 + t, False) for t in range(3)] + [(3, 0.0, 30, 99, True)]
    df = spark.createDataFrame(rows, "user_id bigint, ts_s double, movie_id bigint, event_id bigint, late boolean")
    assert [tuple(r) for r in tr.last_pairs(df, 3, F.col("late")).collect()] == [([11, 12, 13], [12, 13, 14])]


def test_too_large_a_model_is_refused():
    with pytest.raises(ValueError, match="not sent"):
        tr.drawn(tr.Shape(items=10**6, genres=1))
