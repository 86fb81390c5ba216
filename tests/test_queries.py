"""Every registered query against its SQL form on the smallest tables, and the others against plain loops."""

import numpy as np
import pytest

from larkspur import catalog
from larkspur.operators.clustering import dims, pca, project
from larkspur.streaming import state
from tests.compare import duck_rows, spark_rows
from tests.test_semantics import brute_labels, from_scratch


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert spark_rows(df) == duck_rows(duck, catalog.ORACLES[name], df.columns)


def by_user(spark, sf):
    from larkspur.plans.interests import members

    users = {}
    for r in members(spark, sf).orderBy("user_id", "event_idx", "event_id").collect():
        users.setdefault(r.user_id, []).append(r)
    return users


def test_density_equals_all_pairs(spark, sf):
    """SQL cannot say clu1_density: against distances of all pairs of a user's rows, in the plane of their leading directions."""
    got = {r.event_id: r.label for r in catalog.QUERIES["clu1_density"](spark, sf).collect()}
    want = {}
    for rows in by_user(spark, sf).values():
        if len(rows) >= 6:
            x = np.stack([r.vec for r in rows])
            labels = brute_labels(project(x, *pca(x, dims(3, len(x)))), 3)
            want |= {r.event_id: int(k) for r, k in zip(rows, labels, strict=True)}
    assert got == want and len(set(want.values())) > 2


def test_sliding_counts_equal_all_pairs(spark, sf):
    got = sorted(map(tuple, catalog.QUERIES["win7_sliding_k"](spark, sf).collect()))
    want = []
    for user, rows in by_user(spark, sf).items():
        for a in range(0, max(1, len(rows) - 19), 5):
            b = min(a + 20, len(rows))
            x = np.stack([r.vec for r in rows[a:b]])
            labels = brute_labels(project(x, *pca(x, dims(3, len(x)))), 3) if len(x) > 1 else np.full(len(x), -1)
            want.append((user, rows[min((a + b) // 2, len(rows) - 1)].event_idx, len(set(labels.tolist()) - {-1})))
    assert got == sorted(want)


def test_fold_equals_states_from_scratch(spark, sf):
    """SQL cannot say stm9_fold_batch: against a fold that computes positives and contexts anew at every event."""
    from larkspur.plans.stream import OPTIONS as o
    from larkspur.plans.stream import known_items, log

    vecs = {r.movie_id: np.array(r.vec) for r in known_items(spark, sf).collect()}
    users = {}
    for r in log(spark, sf).orderBy("replay_order").collect():
        users.setdefault(r.user_id, []).append((r.ts_s, r.movie_id, r.event_id, r.rating, vecs.get(r.movie_id)))
    want = {}
    for events in users.values():
        s, before = state.UserState(), {}
        for n, e in enumerate(events, 1):
            liked, contexts = from_scratch(events[:n], o)
            order = {x[2]: x[:3] for x in events[:n]}
            changed = sorted((k for k, c in contexts.items() if before.get(k) != c), key=order.get)
            s.vectors = {k: state.recency_mean(np.stack([vecs[m] for m in c[1:]])) for k, c in contexts.items()}
            s.active = [order[k] for k in sorted(contexts, key=order.get)]
            told = [state.assign(s, k, s.vectors[k], o)[0] for k in changed]
            s.version += 1 + bool(changed)
            s.reasons |= state.triggers(s, o)
            refit = None
            if s.reasons and not s.open:
                refit = state.refit(s, o)
                s.version += 1
            want[e[2]] = (len(changed), sum(k not in contexts for k in before), told.count("assigned"), sum(t.startswith("outlier") for t in told), len(s.pending), refit, len(s.interests), s.version)
            before = contexts
    names = ["changed", "inactive", "assigned", "outliers", "pending", "refit", "interests", "version"]
    got = {r.event_id: tuple(r[c] for c in names) for r in catalog.QUERIES["stm9_fold_batch"](spark, sf).collect()}
    assert got == want and sum(x[5] == "closed" for x in want.values()) > 5


def test_catalogue_clusters_equal_all_pairs(spark, sf):
    from larkspur.sources import adapters as ad

    items = ad.items(spark, sf).orderBy("movie_id").collect()
    want = brute_labels(np.array([r.vec[:3] for r in items]), 4)
    got = {r.movie_id: r.label for r in catalog.QUERIES["clu1_catalogue"](spark, sf).collect()}
    assert got == {r.movie_id: int(k) for r, k in zip(items, want, strict=True)} and len(set(want.tolist())) > 2


def test_layouts_are_those_of_each_user_alone(spark, sf):
    """Every user's layout from distances of all pairs of rows, and the later rows of each in that of the earlier ones."""
    from larkspur.operators import density, layout

    got = {r.event_id: (r.x, r.y, r.z) for r in catalog.QUERIES["clu1_layout"](spark, sf).collect()}
    placed = {r.event_id: (r.x, r.y, r.z) for r in catalog.QUERIES["clu4_placed"](spark, sf).collect()}
    rows = by_user(spark, sf)
    assert set(got) == {r.event_id for x in rows.values() for r in x}
    assert set(placed) == {r.event_id for x in rows.values() for i, r in enumerate(x) if 5 * i >= 4 * len(x)} and np.isfinite(list(placed.values())).all()
    for events in list(rows.values())[:3]:
        x, n = np.stack([r.vec for r in events]), len(events)
        far = density.apart(x, x)
        np.fill_diagonal(far, np.inf)
        at, d = np.argsort(far, axis=1, kind="stable")[:, :10], np.sort(far, axis=1)[:, :10]
        seen = np.zeros((n, n))
        np.put_along_axis(seen, at, layout.smoothed(d), axis=1)
        met = np.zeros((n, n), dtype=bool)
        np.put_along_axis(met, at, True, axis=1)
        # to the last bit, as a layout grows from its start through many steps
        both = 1.0 - (1.0 - np.maximum(seen, seen.T)) * (1.0 - np.minimum(seen, seen.T))
        a, b = np.nonzero(np.triu(met | met.T))
        want = layout.laid_out(n, a, b, both[a, b], 3, 100, 42)
        np.testing.assert_allclose([got[r.event_id] for r in events], want, atol=1e-9)


def test_transformer_equals_single_contexts(spark, sf):
    from larkspur.operators import sequences as sq
    from larkspur.operators import transformer as tr
    from larkspur.plans import learned
    from larkspur.sources import adapters as ad

    _, kinds = learned.indexed(spark, sf)
    s = learned.shape_of(kinds, width=16, length=10)
    w, index = tr.drawn(s), {r.movie_id: (r.item_idx, r.genres) for r in kinds.collect()}
    flags = learned.flags(kinds, s)
    contexts = sq.context_windows(sq.positives(ad.ratings(spark, sf)), ad.known(), 10).collect()
    got = {r.event_id: r.vec for r in catalog.QUERIES["mdl3_transformer"](spark, sf).collect()}
    assert len(got) == len(contexts) > 300
    for c in contexts[::7]:
        ids = np.array([[index[m][0] for m in c["items"]]])
        np.testing.assert_allclose(got[c.event_id], tr.body(w, s, tr.entered(w, ids, flags[ids]), ids != 0)[0][0, -1], atol=1e-10)


def test_training_lowers_its_losses(spark, sf):
    got = catalog.QUERIES["mdl4_trained"](spark, sf).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [1, 2, 3] and got[2].ce < got[0].ce
    assert all(np.isfinite([r.ce, r.cl]).all() and 0 <= r.ndcg <= r.recall <= 1 for r in got)


def test_all_others_are_checked_above():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {
        "clu1_density", "clu1_catalogue", "clu1_layout", "clu4_placed", "mdl3_transformer", "mdl4_trained", "win7_sliding_k", "stm9_fold_batch",
    }


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "movie_id", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
