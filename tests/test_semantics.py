"""Rules that are easy to get wrong, on small inputs worked out by hand."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import numbers as num
from larkspur.functions.text import genres, title_year
from larkspur.operators import cleaning as cl
from larkspur.operators import clustering as cg
from larkspur.operators import density
from larkspur.operators import history as hs
from larkspur.operators import interests as it
from larkspur.operators import sequences as sq
from larkspur.operators import statistics as stt
from larkspur.operators import validation as val
from larkspur.operators.density import density_labels
from larkspur.sources import files
from larkspur.streaming import replay, state


def ratings(spark, values, user=1):
    rows = [(user, i % 7, float(v), float(i), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "user_id bigint, movie_id bigint, rating double, ts_s double, event_id bigint")


def test_titles(spark):
    rows = ["Toy Story (1995)", "X (2001))", "Y ((1999)", "(2000)", "Z 1999", "A (1999)(2000)", None, " B (1990) "]
    got = [tuple(r.t) if r.t else None for r in spark.createDataFrame([(r,) for r in rows], "raw string").select(title_year(F.col("raw")).alias("t")).collect()]
    assert got == [("Toy Story", 1995, "strict"), ("X", 2001, "relaxed"), ("Y (", 1999, "strict"), ("", 2000, "strict"), ("Z 1999", None, None), ("A (1999)", 2000, "strict"), (None, None, None), ("B", 1990, "strict")]


def test_genres(spark):
    rows = ["Action|Sci-Fi", "(no genres listed)", " A || B ", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "g string").select(genres(F.col("g"))).collect()]
    assert got == [["Action", "Sci-Fi"], [], ["A", "B"], []]


@pytest.mark.parametrize(
    ("values", "batch", "online", "seen"),
    [([3, 3, 4, 5], {2, 3}, {2, 3}, {2, 3}), ([4, 4, 4], set(), {0, 1, 2}, set()), ([5, 1], {0}, {0, 1}, {0})],
)
def test_positive_policies(spark, values, batch, online, seen):
    r = ratings(spark, values)
    z = sq.zscored(r)
    ids = lambda df, c="event_id": {x[c] for x in df.select(c).collect()}
    assert ids(sq.positives(r)) == batch
    assert ids(sq.positive_online(z).where("positive")) == online
    assert ids(sq.seen_batch(z), "movie_id") == seen


@pytest.mark.parametrize("parts", [1, 3])
def test_a_rating_at_its_mean_is_not_above_it(spark, parts):
    """Sums of doubles differ by their order; of these, some exceed and some miss three times 0.1 or 0.7."""
    users = {1: [0.1] * 3, 2: [0.7] * 3, 3: [0.1, 0.7, 0.4], 4: [33.11, 17.43, 1.75], 5: [1e25, 1e25, 1.0]}
    users[4].append(round(sum(users[4]) / 3, 2))
    rows = [(u, i, float(i), 10 * u + i, r) for u, rs in users.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "user_id bigint, movie_id bigint, ts_s double, event_id bigint, rating double").repartition(parts)
    above = {(r.user_id, r.rating) for r in sq.positives(df).collect()}
    assert above == {(3, 0.7), (4, 33.11), (5, 1e25)} | ({(4, 17.43)} if users[4][3] < 17.43 else set())


def test_retroactive_positives():
    s, seen = state.UserState(), []
    for i, v in enumerate([4, 2, 3, 5]):
        state.insert(s, (float(i), i, i, float(v), [1.0]), state.Options())
        seen.append([v for v, *_ in sorted(s.ratings, key=lambda x: x[1]) if s.bar() is None or v > s.bar()])
        assert [k[2] for k in s.active] == [i for i in range(i + 1) if [4, 2, 3, 5][i] in seen[-1]]
    assert seen == [[4], [4, 2], [4], [4, 5]]


def from_scratch(events, o):
    """Positives and contexts of all events so far, computed anew."""
    r = np.array([e[3] for e in events])
    rows = sorted(events, key=lambda e: e[:3])
    mean = float(sum(state.Fraction(repr(e[3])) for e in events) / len(events))
    everyone = len(r) < 3 or r.std() <= 1e-8
    liked = [e for e in rows if everyone or e[3] > mean]
    known = [e for e in liked if e[4] is not None]
    return {e[1] for e in liked}, {e[2]: (e[0], *(x[1] for x in known[max(0, i - o.length + 1) : i + 1])) for i, e in enumerate(known)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.sampled_from([1.0, 2.5, 3.0, 3.0, 0.1, 0.2, 0.3])), min_size=1, max_size=30), st.integers(1, 4))
def test_incremental_states(events, length):
    """After each event, late ones too: the same positives and contexts as from scratch, and exactly the changes told."""
    o, s, past = state.Options(length=length), state.UserState(), []
    for raw, (ts, movie, rating) in enumerate(events):
        event = (float(ts), movie, raw, rating, None if movie == 5 else np.eye(6)[movie])
        past.append(event)
        before = dict(s.contexts)
        positive, changed, left = state.insert(s, event, o)
        liked, contexts = from_scratch(past, o)
        assert set(s.liked) == liked and s.contexts == contexts and set(s.vectors) == set(contexts)
        assert [k[2] for k in s.active] == sorted(contexts, key=lambda k: next(e[:3] for e in past if e[2] == k))
        assert {k[2] for k in changed} == {k for k, c in contexts.items() if before.get(k) != c}
        assert sorted(left) == sorted(k for k in before if k not in contexts)
        for k, c in contexts.items():
            assert np.allclose(s.vectors[k], state.recency_mean(np.stack([np.eye(6)[m] for m in c[1:]])))


def test_context_skips_unknown(spark):
    rows = [(1, m, 5.0, float(i), i, i) for i, m in enumerate([0, 1, 7, 3, 4])]
    p = spark.createDataFrame(rows, "user_id bigint, movie_id bigint, rating double, ts_s double, event_id bigint, event_idx bigint")
    got = sq.context_windows(p, F.col("movie_id") != 7, 3).orderBy("event_idx").collect()
    assert [(r["items"], r.context_start_idx, r.history_len) for r in got] == [([0], 0, 1), ([0, 1], 0, 2), ([0, 1, 3], 0, 3), ([1, 3, 4], 1, 3)]


@pytest.mark.parametrize(("n", "starts"), [(2, []), (5, [0]), (6, [0]), (9, [0, 2, 4])])
def test_sample_windows(spark, n, starts):
    got = sq.sample_windows(ratings(spark, [5] * n), 4, 2).orderBy("start").collect()
    assert [r.start for r in got] == starts
    assert all(len(r["items"]) == min(5, n) for r in got)


def test_assignment_rows(spark):
    i = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "user_id bigint, label bigint, vec array<double>")
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [-1.0, -1.0]), (1, 3, [0.0, 0.0]), (1, 4, [float("nan"), 0.0]), (2, 5, [1.0, 0.0])]
    got = {r.event_id: r for r in it.assigned(spark.createDataFrame(rows, "user_id bigint, event_id bigint, vec array<double>"), i, 0.2).collect()}
    assert [got[k].status for k in range(1, 6)] == ["assigned", "outlier", "outlier", "outlier_invalid", "pending_no_interest"]
    assert [got[k].interest for k in range(1, 6)] == [0, 0, 0, None, None]
    assert math.isclose(got[2].similarity, -0.70710678, abs_tol=1e-6)


def test_state_counters():
    o = state.Options(threshold=0.2, refit_min=3, assign_trigger=3, outlier_trigger=2)
    s = state.UserState(interests=[np.array([1.0, 0]), np.array([0, 1.0])], counts=[0, 0])
    vecs = {1: [1, 0], 2: [-1, -1], 3: [0, 0], 4: [math.nan, 0]}
    got = [state.assign(s, k, np.array(v, dtype=float), o)[0] for k, v in vecs.items()]
    assert got == ["assigned", "outlier", "outlier", "outlier_invalid"]
    assert (s.assigned, s.outliers, s.pending) == (1, 3, {2, 3, 4})
    assert state.triggers(s, o) == {"outlier_since_last_refit", "pending_events"}
    state.assign(s, 2, np.array([-1.0, -1]), o)
    assert s.outliers == 3  # counted once


def test_skipped_refit_reopens():
    items = {k: np.eye(4)[k] for k in range(4)}
    o = state.Options(refit_min=3, assign_trigger=99, outlier_trigger=99, forced_every=2)
    s = state.UserState()
    out = [state.step(s, (float(i), i % 4, i, 5.0, items[i % 4]), o) for i in range(3)]
    assert [x["refit"] for x in out] == [None, "skipped", "closed"]


def test_max_interest(spark):
    i = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0])], "user_id bigint, label bigint, vec array<double>")
    v = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0])], "movie_id bigint, vec array<double>")
    seen = spark.createDataFrame([(1, 11)], "user_id bigint, movie_id bigint")
    got = it.best_items(it.user_queries(i, seen), v, 5, "user_id").orderBy("rank").collect()
    assert [(r.movie_id, r.score, r.label) for r in got] == [(12, 2.0, 1), (10, 1.0, 0)]


@pytest.mark.parametrize("matrix", [10**9, 64])
@pytest.mark.parametrize("scores", [10**9, 40])
def test_best_items(spark, monkeypatch, matrix, scores):
    """Against all pairs: ties, vectors that are not finite, users without interests or unseen items, many small blocks."""
    monkeypatch.setattr(it, "MATRIX", matrix)
    monkeypatch.setattr(it, "SCORES", scores)
    monkeypatch.setattr(it, "QUERIES", 3)
    rng = np.random.default_rng(0)
    items = {m: rng.integers(-2, 3, 4).astype(float) for m in range(40)}
    items[7], items[8] = np.array([math.nan, 0, 0, 0]), items[9]
    users = {u: [rng.integers(-2, 3, 4).astype(float) for _ in range(u % 4)] for u in range(12)}
    users[5][0] = np.array([math.inf, 0, 0, 0])
    seen = {u: set(rng.choice(40, 38 if u == 3 else 5, replace=False).tolist()) for u in range(11)}
    i = spark.createDataFrame([(u, n, v.tolist()) for u, vs in users.items() for n, v in enumerate(vs)], "user_id bigint, label bigint, vec array<double>")
    v = spark.createDataFrame([(m, x.tolist()) for m, x in items.items()], "movie_id bigint, vec array<double>")
    s = spark.createDataFrame([(u, m) for u, ms in seen.items() for m in ms], "user_id bigint, movie_id bigint")
    got = sorted((r.user_id, r["rank"], r.movie_id, r.score, r.label) for r in it.best_items(it.user_queries(i, s), v, 6, "user_id").collect())
    want = []
    for u, vs in users.items():
        sound = [(n, x) for n, x in enumerate(vs) if np.isfinite(x).all()]
        rows = [max((float(x @ y), -n) for n, x in sound) + (m,) for m, y in items.items() if sound and np.isfinite(y).all() and m not in seen.get(u, ())]
        rows.sort(key=lambda r: (-r[0], r[2]))
        want += [(u, k + 1, m, score, -n) for k, (score, n, m) in enumerate(rows[:6])]
    assert got == want and len({u for u, *_ in got}) > 6


@pytest.mark.parametrize(("values", "gini"), [([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75)])
def test_gini(spark, values, gini):
    assert stt.gini(spark.createDataFrame([(v,) for v in values], "n bigint"), "n").first()[0] == gini


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 1.0, 30.0, 365.0, 365.1)], "days double")
    got = {r.bucket: r.n for r in stt.buckets(df, "days", [0.1, 1.0, 7.0, 30.0, 365.0], "n").collect()}
    assert got == {"<=0.1d": 1, "0.1-1d": 1, "1-7d": 0, "7-30d": 1, "30-365d": 1, ">365d": 1}


def test_split_of_ten(spark):
    got = {r.event_id: r.split for r in sq.temporal_split(ratings(spark, range(10))).collect()}
    assert [got[k] for k in range(10)] == ["train"] * 8 + ["val", "test"]
    rows = spark.createDataFrame([(1, 5, "val"), (1, 5, "test"), (1, 6, "train")], "user_id bigint, movie_id bigint, split string")
    pairs = {(r.movie_id, r.split) for r in sq.split_pairs(rows).collect()}
    assert pairs == {(5, "val"), (5, "test"), (6, "train"), (6, "val"), (6, "test")}


def test_half_even(spark):
    df = spark.createDataFrame([(3.125,), (0.875,), (2.5,)], "x double")
    assert [r[0] for r in df.select(num.even(F.col("x"), 2)).collect()] == [3.12, 0.88, 2.5]


def test_compaction(spark):
    ev = spark.createDataFrame([(1, i, i, 5) for i in (5, 6, 7, 8)], "user_id bigint, event_id bigint, replay_order bigint, epoch bigint")
    mem = spark.createDataFrame([(1, 5, 101, 0), (1, 5, 102, -1)], "user_id bigint, epoch bigint, raw_id bigint, label bigint")
    ch = spark.createDataFrame([(1, 5, 103, 7, "projection", 0), (1, 5, 101, 8, "inactivate", None)], "user_id bigint, epoch bigint, raw_id bigint, order bigint, change string, label bigint")
    got = [(r.k_count, r.noise, r.assigned) for r in hs.timeline(ev, hs.point_intervals(mem, ch)).orderBy("replay_order").collect()]
    assert got == [(1, 1, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1)]


def test_positional_delta_is_lossy(spark):
    f = spark.createDataFrame([(1, 1, 1, ["a", "c"], True), (1, 2, 2, ["a", "b", "c"], False)], "user_id bigint, event_id bigint, replay_order bigint, points array<string>, is_checkpoint boolean")
    assert hs.positional_delta(f).orderBy("event_id").collect()[1].stored == ["c"]
    assert hs.keyed_delta(f).orderBy("event_id").collect()[1].added == ["b"]


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_stream_equals_batch(spark, sf, tmp_path, order):
    """Every record of the stream is that of the batch, in whatever order the files come, and repeats change nothing."""
    from larkspur.plans.stream import OPTIONS, known_items, log

    events, items = log(spark, sf), known_items(spark, sf)
    twice = events.unionByName(events.where("event_id % 37 = 0"))
    want = sorted(map(tuple, state.fold_batch(twice, items, OPTIONS).collect()), key=repr)
    replay.write_log(twice, f"{tmp_path}/log", 5)
    files = sorted((tmp_path / "log").glob("part-*"), reverse=order == "backward")
    if order == "mixed":
        files = files[1::2] + files[::2]
    for n, f in enumerate(files):
        os.utime(f, (1_700_000_000 + 10 * n,) * 2)
    out = replay.run_stream(state.fold_stream(replay.read_log_stream(spark, f"{tmp_path}/log"), items, OPTIONS), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(tuple, out.collect()), key=repr) == want and len(want) == twice.count()


def test_events_wait_for_their_predecessors():
    o, s = state.Options(), state.UserState()
    event = lambda k: (float(k), k, k, float(k % 4), [1.0])
    told = [[r["event_id"] for r in state.receive(s, k, event(k), o)] for k in (2, 1, 1, 0, 0, 4)]
    assert told == [[], [], [1], [0, 1, 2], [0], []]
    assert [r["event_id"] for r in state.rest(s, o)] == [4]


def test_a_heavy_user(spark):
    """A user with most of the rows: all come back, the history joins and the fold do not grow with their square."""
    rng = np.random.default_rng(6)
    n = 6000
    users = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 40, n)).tolist()
    rows = [(u, int(m), float(r), float(k), k) for k, (u, m, r) in enumerate(zip(users, rng.integers(0, 50, n), rng.random(n), strict=True))]
    r = spark.createDataFrame(rows, "user_id bigint, movie_id bigint, rating double, ts_s double, event_id bigint")
    v = spark.createDataFrame([(m, rng.normal(size=8).tolist()) for m in range(45)], "movie_id bigint, vec array<double>")
    o = state.Options(refit_min=5, assign_trigger=10**9, outlier_trigger=10**9, forced_every=1000)
    out = state.fold_batch(replay.event_log(r, float("-inf"), float("inf")), v, o)
    assert out.groupBy("user_id").count().orderBy("count", ascending=False).first()["count"] == users.count(1)
    m = r.join(v, "movie_id").withColumn("event_idx", F.col("event_id"))
    c = cg.cluster_users(m, least=3)
    assert c.count() == m.count()
    assert cg.cluster_users(m, least=3, stride=10).where("user_id = 1").count() == -(-m.where("user_id = 1").count() // 10)


def test_contract(spark):
    c = files.contract("name: t\ncolumns:\n  - {name: a, physical_type: int64, nullable: false}\nconstraints:\n  - {type: unique, column: a}\n")
    assert val.schema_issues(spark.createDataFrame([("x",)], "a string"), c)[0][0] == "dtype_mismatch"
    assert val.schema_issues(spark.createDataFrame([(1,)], "b bigint"), c) == [("missing_column", "a", ""), ("unexpected_column", "b", "")]
    with pytest.raises(val.ContractError):
        val.enforce(spark.createDataFrame([(1,), (1,)], "a bigint"), c)


def test_checked_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    schema = c = files.contract("name: t\ncolumns:\n  - {name: a, physical_type: int64}\n  - {name: b, physical_type: int64}\n").schema
    good, bad = files.read_checked_csv(spark, f"{tmp_path}/x.csv", schema)
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and bad.first().reasons == ["invalid:a"]
    (tmp_path / "y.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        files.read_checked_csv(spark, f"{tmp_path}/y.csv", c)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-1, 1), min_size=4, max_size=4), min_size=1, max_size=30), st.integers(2, 5))
def test_clusters(rows, least):
    x = np.array(rows)
    labels, _, _ = cg.cluster(x, least)
    found = sorted(set(labels.tolist()) - {-1})
    assert found == list(range(len(found)))
    assert all((labels == k).sum() >= least for k in found)
    if len(x) <= max(2, least):
        assert not found


def brute_labels(x, least):
    """The same from all pairs of rows: the least largest step on any way between two rows, and the definitions."""
    n = len(x)
    if n <= max(2, least):
        return np.full(n, -1)
    far = np.sqrt(sum((x[:, k, None] - x[None, :, k]) ** 2 for k in range(x.shape[1])))
    core = np.sort(far, axis=1)[:, least]
    step = np.maximum(far, np.maximum(core[:, None], core[None, :]))
    for k in range(n):
        step = np.minimum(step, np.maximum(step[:, k, None], step[k]))
    off = ~np.eye(n, dtype=bool)
    floor = 1e-9 * step[off].max() or 1.0

    def grown(rows, birth):
        """(rows, mass, parts) of a cluster."""
        all_rows, mass = rows, 0.0
        while True:
            inner = step[np.ix_(rows, rows)]
            width = inner[~np.eye(len(rows), dtype=bool)].max()
            here = 1 / max(width, floor)
            parts = {}
            for i in range(len(rows)):
                parts.setdefault(min([i, *np.flatnonzero((inner[i] < width) & (np.arange(len(rows)) != i)).tolist()]), []).append(rows[i])
            big = [np.array(p) for p in parts.values() if len(p) >= least]
            birth = here if birth is None else birth
            mass += (here - birth) * (len(rows) - (len(big[0]) if len(big) == 1 else 0))
            if len(big) != 1:
                return all_rows, mass, [grown(p, here) for p in big]
            rows = big[0]

    def best(node):
        rows, mass, parts = node
        below = [best(p) for p in parts]
        total = sum(b[0] for b in below)
        return (mass, [rows]) if mass >= total else (total, [r for b in below for r in b[1]])

    picked = [r for p in grown(np.arange(n), None)[2] for r in best(p)[1]]
    out = np.full(n, -1)
    for k, rows in enumerate(sorted(picked, key=min)):
        out[rows] = k
    return out


def blobs(seed, n=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (4, 3))
    return np.concatenate([rng.normal(c, s, (n // 4 + k, 3)) for k, (c, s) in enumerate(zip(centres, (0.05, 0.3, 1.0, 3.0), strict=True))])


@pytest.mark.parametrize("least", [2, 3, 5])
def test_density_clusters_equal_all_pairs(least):
    found = set()
    for seed in range(25):
        rng = np.random.default_rng(seed)
        x = [blobs(seed), rng.normal(size=(30, 2)), np.round(rng.normal(size=(40, 2)) * 2), np.repeat(rng.normal(size=(8, 2)), 5, axis=0)][seed % 4]
        labels = density_labels(x, least)
        assert (labels == brute_labels(x, least)).all()
        found.add(labels.max())
        order = rng.permutation(len(x))
        # the same groups in another order of rows
        again = density_labels(x[order], least)
        assert ((again[:, None] == again[None, :]) == (labels[order][:, None] == labels[order][None, :])).all()
    assert len(found) > 3


def test_clusters_of_unlike_density():
    """Two tight clusters side by side and a wide one: no one distance separates them."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.02, (40, 2)), rng.normal(0.4, 0.02, (40, 2)), rng.normal(8, 1.0, (40, 2))])
    labels = density_labels(x, 8)
    for k, part in enumerate((slice(0, 40), slice(40, 80), slice(80, 120))):
        own = labels[part]
        assert (own == k).sum() >= 25 and set(own.tolist()) <= {-1, k}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for eps in np.quantile(far, np.linspace(0, 1, 200)):
        group = np.arange(120)
        for _ in range(120):
            new = np.where(far <= eps, group[None, :], 120).min(axis=1)
            if (new == group).all():
                break
            group = new
        sizes = [np.bincount(group[p], minlength=120).max() for p in (slice(0, 40), slice(40, 80), slice(80, 120))]
        assert not (min(sizes) >= 25 and len(set(group[:40]) & set(group[40:80])) == 0)


def test_odd_groups():
    assert (density_labels(np.zeros((20, 3)), 3) == -1).all()
    assert len(density_labels(np.zeros((0, 3)), 3)) == 0
    assert (density_labels(np.zeros((2, 3)), 1) == -1).all()
    x = np.concatenate([np.zeros((10, 2)), np.ones((10, 2)), [[5.0, 5.0]]])
    assert density_labels(x, 4).tolist() == [0] * 10 + [1] * 10 + [-1]


def test_two_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3))])
    labels = density_labels(x, 4)
    assert set(labels[:30].tolist()) - {-1} == {0} and set(labels[30:].tolist()) - {-1} == {1}


@pytest.mark.parametrize("spread", [0.02, 0.5, 10.0])
def test_pruned_search_equals_the_full_scan(spread):
    """All items by cells and by a full scan; where items lie in groups, most products are skipped."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    vecs = np.concatenate([c * rng.uniform(0.5, 2) + rng.normal(0, spread, (50, 12)) for c in centres])
    vecs[::97] = vecs[5]  # equal items
    vecs[3] = np.nan
    ids = rng.permutation(len(vecs))
    labels, queries, seen = [], [], []
    for q in range(40):
        n = int(rng.integers(0, 4))
        labels.append(list(range(n)))
        queries.append([centres[rng.integers(30)] + rng.normal(0, 0.1, 12) for _ in range(n)])
        seen.append(None if q % 3 == 0 else rng.choice(ids, 100).tolist())
    queries[0] = [np.full(12, np.nan), centres[0]]
    labels[0] = [0, 1]
    cells = it.Cells(ids, vecs)
    assert dict(cells.best(labels, queries, seen, 10)) == dict(it.Catalogue(ids, vecs).best(labels, queries, seen, 10))
    print(f"spread {spread}: {cells.share_skipped:.2f} of all products skipped")
    assert spread > 0.1 or cells.share_skipped > 0.8


@pytest.mark.parametrize("tile", [4, 50])
def test_tiles_give_the_labels_of_one_task(spark, tile):
    groups = {7: blobs(3, 120), 8: np.round(blobs(4) * 4), 9: np.zeros((3, 3)), 10: np.ones((1, 3)), 11: np.zeros((30, 3))}
    rows = [(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    got = density.clustered(spark.createDataFrame(rows, "group bigint, place bigint, vec array<double>"), 3, tile).collect()
    want = {(g, i): int(k) for g, x in groups.items() for i, k in enumerate(density_labels(x, 3))}
    assert len(got) == len(want) and {(r.group, r.place): r.label for r in got} == want


def test_edges_of_the_whole_tree_are_lighter_than_the_weight_of_an_end():
    """What the tiles leave out: an edge between rows that a tree of some edges joins by no more than its weight."""
    x = np.concatenate([blobs(2, 150), np.random.default_rng(1).normal(0, 9, (6, 3))])
    n, core = len(x), density.core_distances(x, 3)
    order = np.argsort(x[:, 0], kind="stable")
    far = np.maximum(density.apart(x, x), np.maximum(core[:, None], core[None, :]))
    a, b = order[:-1], order[1:]  # a chain stands for the trees of the tiles
    at = density.joined_at(n, a, b, far[a, b])
    one, other, w = density.spanning(x, core)
    own = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert all((min(i, j), max(i, j)) in own or v <= max(at[i], at[j]) for i, j, v in zip(one.tolist(), other.tolist(), w.tolist(), strict=True))
    assert (at == at.min()).sum() >= density.JOINED * n


def test_large_users_get_the_labels_of_one_task(spark):
    rng = np.random.default_rng(5)
    rows = []
    for user, n in ((1, 60), (2, 9), (3, 25)):
        turn = rng.normal(size=(3, 6))
        rows += [(user, 100 * user + i, (i * 7) % n, v.tolist()) for i, v in enumerate(blobs(user, n)[:n] @ turn)]
    m = spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_idx bigint, vec array<double>")
    rows_of = lambda df: {r.event_id: r for r in df.collect()}
    for kw in ({}, {"skip_under": 10, "stride": 2}):
        one, many = rows_of(cg.cluster_users(m, **kw)), rows_of(cg.cluster_users(m, tile=11, **kw))
        assert {e: r.label for e, r in one.items()} == {e: r.label for e, r in many.items()} and max(r.label for r in one.values()) > 0
        np.testing.assert_allclose([many[e][3:] for e in one], [r[3:] for r in one.values()], atol=1e-9)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 10)), min_size=1, max_size=25))
def test_fold_by_batches(events):
    """A fold in two parts, with the state as bytes between, equals one fold."""
    import pickle

    items = {k: np.eye(6)[k] for k in range(5)}
    o = state.Options(refit_min=3, assign_trigger=4, outlier_trigger=2)
    log = [(float(i), m, i, float(r), items.get(m)) for i, (m, r) in enumerate(events)]
    one, two = state.UserState(), state.UserState()
    whole = [state.step(one, e, o) for e in log]
    first = [state.step(two, e, o) for e in log[: len(log) // 2]]
    two = pickle.loads(pickle.dumps(two))
    assert whole == first + [state.step(two, e, o) for e in log[len(log) // 2 :]]


def test_events_are_dealt_without_their_vectors(spark, monkeypatch):
    """The fold's events are shuffled and sorted narrow, and get their vectors where they are; too many items are joined before."""
    log = spark.createDataFrame([(u, i, 10 * u + i, i % 4, float(i), float(i * u % 5)) for u in range(5) for i in range(9)], "user_id bigint, user_seq bigint, event_id bigint, movie_id bigint, ts_s double, rating double")
    items = spark.createDataFrame([(m, [float(m == k) for k in range(3)]) for m in range(3)], "movie_id bigint, vec array<double>")
    told = []
    for most in (state.MATRIX, 0):
        monkeypatch.setattr(state, "MATRIX", most)
        out = state.fold_batch(log, items, state.Options(refit_min=3))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.index("Join") < plan.index("RepartitionByExpression")) == (most > 0)
        told.append(sorted(map(repr, out.collect())))
    assert told[0] == told[1] and len(told[0]) == 45


@pytest.mark.parametrize("rating", [0.0, -3.0, 29.27, 1e-7, 2.5e-9, 1e22, -1.25e17, 5e-324])
def test_ratings_as_decimals(rating):
    digits, places = state.written_as(rating)
    assert state.Fraction(digits, 10**places) == state.Fraction(repr(rating))


def test_encoders_tell_every_component(spark, sf):
    from larkspur.catalog import QUERIES
    from larkspur.sources import adapters as ad

    contexts = sq.context_windows(sq.positives(ad.ratings(spark, sf)), ad.known(), 10).count()
    wide = len(ad.items(spark, sf).first().vec)
    for name in ("mdl6_canonical", "mdl3_encoder"):
        got = QUERIES[name](spark, sf).groupBy("p").count().collect()
        assert {r.p: r["count"] for r in got} == {p: contexts for p in range(wide)}


def test_means_of_members_as_rows_and_as_columns(spark):
    """Vectors of unlike length and with nulls, noise, small groups; known length: no row for each component."""
    rows = [(1, 0, [1.0, 2.0, 3.0]), (1, 0, [3.0, 4.0]), (1, 1, [None, 5.0]), (1, 1, [None, 7.0]), (1, -1, [9.0]), (2, 3, [1.0]), (3, 0, [2.0]), (3, 0, [4.0])]
    m = spark.createDataFrame(rows, "user_id bigint, label int, vec array<double>")
    out = [it.centroids(m, "user_id", "label", least=2, dim=dim) for dim in (None, 3, it.WIDE + 1)]
    told = [{(r.user_id, r.label): (r["size"], r.vec) for r in df.collect()} for df in out]
    assert told[0] == told[1] == told[2] == {(1, 0): (2, [2.0, 3.0, 3.0]), (1, 1): (2, [None, 6.0]), (3, 0): (2, [3.0])}
    assert ["Generate" in df._jdf.queryExecution().optimizedPlan().toString() for df in out] == [True, False, True]


def counted(calls):
    def encode(items):
        calls.append(len(items))
        return state.recency_mean(items)

    return encode


@pytest.mark.parametrize(("more", "most"), [({"refit_min": 10**12}, 0), ({"refit_min": 5, "forced_every": 10}, 60)])
def test_contexts_are_embedded_when_they_are_read(more, most):
    """without refits or interests no context is embedded, with them fewer than change; what is told is the same."""
    rng, calls = np.random.default_rng(3), []
    far = {"pending_trigger": 10**12, "assign_trigger": 10**12, "outlier_trigger": 10**12}
    log = [(float(i), int(rng.integers(20)), i, float(rng.integers(1, 6))) for i in range(60)]
    vecs, s, whole = rng.normal(size=(20, 4)), state.UserState(), state.UserState()
    lazy, eager = state.Options(encode=counted(calls), **far, **more), state.Options(**far, **more)
    told = []
    for e in log:
        told.append(state.step(s, (*e, vecs[e[1]]), lazy))
        assert told[-1] == state.step(whole, (*e, vecs[e[1]]), eager)
        state.embedded(whole, [k[2] for k in whole.active], eager)
    assert len(calls) <= most and len(calls) < sum(r["changed"] for r in told)


def test_contexts_of_one_length_together():
    x = np.random.default_rng(5).normal(size=(7, 6, 64))
    assert np.array_equal(state.TOGETHER[state.recency_mean](x), np.stack([state.recency_mean(c) for c in x]))


def test_user_log_needs_no_order_of_all(spark, sf):
    """the same places by user as the replay log has, from one exchange."""
    from larkspur.sources import adapters as ad
    from larkspur.streaming import replay

    own = replay.user_log(ad.ratings(spark, sf))
    whole = replay.event_log(ad.ratings(spark, sf), float("-inf"), float("inf"))
    assert sorted(own.select("event_id", "user_seq").collect()) == sorted(whole.select("event_id", "user_seq").collect())
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


@pytest.mark.parametrize("n", [2, 3, 9, 40, 120])
def test_few_rows_as_many(n):
    """trees and directions of few rows as those of many."""
    from larkspur.operators import clustering, density

    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 3)), 1)  # some distances are equal
    core = density.core_distances(x, min(3, n - 1))
    w = np.maximum(np.maximum(density.apart(x, x), core[:, None]), core)
    assert all(np.array_equal(a, b) for a, b in zip(density.spanning_of(w), density.spanning(x, core), strict=True))
    off = rng.normal(size=(n, 64))
    off -= off.mean(axis=0)
    k = min(3, n - 1)
    axes = np.linalg.svd(off, full_matrices=False)[2][:k]
    assert np.allclose(np.abs((clustering.leading(off, k) * axes).sum(axis=1)), 1)
    line = off[:1] * np.arange(5)[:, None]  # two directions without spread
    assert np.isclose(abs(clustering.leading(line, 3)[0] @ off[0]), np.linalg.norm(off[0]))


def test_interests_are_made_where_they_are_scored(spark):
    """as centroids and best_items make them; repeats weigh, unknown items are only seen, and no vector is aggregated."""
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(m, rng.normal(size=4).tolist(), m % 3 if m % 8 else None) for m in range(40)], "movie_id bigint, vec array<double>, label int")
    rows = spark.createDataFrame([(u, int(m)) for u in range(6) for m in rng.integers(0, 44, 5 * u)], "user_id bigint, movie_id bigint")
    known = F.col("movie_id") % 10 != 7
    for seen in (True, False):
        members = rows.where(known).join(items, "movie_id")
        asked = it.user_queries(it.centroids(members, "user_id", "label", least=3), rows.where(F.lit(seen)))
        want = it.best_items(asked, items, 4, "user_id").collect()
        out = it.best_of_members(rows, items, 4, 3, known, seen)
        got = {(r.user_id, r["rank"]): (r.movie_id, r.label, round(r.score, 8)) for r in out.collect()}
        assert got == {(r.user_id, r["rank"]): (r.movie_id, r.label, round(r.score, 8)) for r in want} and len(got) > 8
        assert "avg(" not in out._jdf.queryExecution().executedPlan().toString()
    assert it.best_of_members(rows, items.union(items), 4, 3, known) is None


def test_pruned_queries_visit_cells_together(spark):
    """a cell's items are scored once for all queries that visit it in a step, in as many tasks as there is work for."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(100, 6))
    cells = it.Cells(np.arange(100), vecs)
    asked = [[v] for v in rng.normal(size=(50, 6))]
    calls, parts = [], cells.parts

    class Counted(list):
        def __getitem__(self, at):
            calls.append(at)
            return parts[at]

    cells.parts = Counted(parts)
    want = dict(it.Catalogue(np.arange(100), vecs).best([[0]] * 50, asked, [None] * 50, 5))
    assert dict(cells.best([[0]] * 50, asked, [None] * 50, 5)) == want
    assert len(calls) <= 5 * len(parts)  # steps of 1, 1, 2, 4, ... cells
    items = spark.createDataFrame([(m, v.tolist(), 0) for m, v in enumerate(vecs)], "movie_id bigint, vec array<double>, label int")
    out = it.best_of_members(spark.createDataFrame([(1, 2)], "user_id bigint, movie_id bigint"), items, 4, 1, F.lit(True), prune=True)
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()


def test_whole_numbers_are_cut_or_parsed(spark):
    from larkspur.sources.adapters import number_of

    texts = ['{"k": 5}', '{"k": -12}', '{"k": 05}', '{"k": "7"}', '{"k": 3, "j": 4}', '{"k":9}', '{"k": }', None, "", '{"k": 8 }', '{"j": 8}', '{"k": +5}', "}", '{"k": 4}}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(number_of("t", "k")).collect()] == [r[0] for r in rows.select(F.get_json_object("t", "$.k").cast("bigint")).collect()]


def test_means_of_thousandths_are_those_of_decimals(spark):
    groups = [[6.85] * 3 + [6.85000001], [0.1, 0.2, 0.3], [1e300, 1.0], [float("nan"), 1.0], [-3.5, 1 / 3], [None], [None, 2.0], [12.345, 2.0005], [9e11] * 4, [20.1, 20.2, 20.3, 20.2]]
    rows = spark.createDataFrame([(g, v) for g, vs in enumerate(groups) for v in vs], "g int, v double")
    decimal = F.col("v").try_cast("decimal(38,18)")
    plain = F.coalesce(F.when(F.count(decimal) == F.count("v"), (F.try_sum(decimal) / F.count("v")).cast("double")), F.avg("v"))
    for r in rows.groupBy("g").agg(sq.exact_mean("v").alias("a"), plain.alias("b")).collect():
        assert repr(r.a) == repr(r.b), groups[r.g]


def test_only_products_near_the_best_are_rounded():
    """products that are equal to nine digits go by id and by the first label, as if all were rounded; broken ones take no part."""
    rng = np.random.default_rng(4)
    vecs = np.round(rng.normal(size=(60, 3)), 1)
    vecs[10] = [1e300, 0, 0]
    vecs[20:30] = vecs[5] + rng.uniform(-1e-10, 1e-10, (10, 3))
    queries = [[np.round(rng.normal(size=3), 1) + rng.uniform(-1e-10, 1e-10, 3) for _ in range(n)] for n in (1, 3, 2, 0, 4)]
    queries[1][2] = queries[1][0] + 1e-11
    seen = [None, [3, 4, 99], [], [1], list(range(57))]
    got = dict(it.Catalogue(np.arange(60), vecs).best([list(range(5, 5 + len(q))) for q in queries], queries, seen, 7))
    assert sorted(got) == [0, 1, 2, 4] and len(got[4]) == 3
    for q, found in got.items():
        with np.errstate(over="ignore"):
            scores = np.rint(np.stack(queries[q]) @ vecs.T * 1e9) / 1e9
        own = scores.argmax(axis=0)
        best = [(-scores[own[j], j], j, int(own[j]) + 5) for j in range(60) if np.isfinite(scores[own[j], j]) and j not in (seen[q] or [])]
        assert found == [(j, -s, lab) for s, j, lab in sorted(best)[:7]]


def test_queries_that_ask_for_the_same_are_ranked_once(monkeypatch):
    """events between two refits have the same interests; each leaves out what it has seen."""
    rng = np.random.default_rng(6)
    vecs, one, two = rng.normal(size=(50, 4)), rng.normal(size=(2, 4)), rng.normal(size=(1, 4))
    queries = [list(one)] * 4 + [list(two)] + [[v.copy() for v in one]] * 3 + [[]] * 2 + [[np.full(4, np.nan)]] * 2
    labels = [list(range(len(q))) for q in queries]
    seen = [rng.choice(50, n, replace=False) for n in (0, 5, 48, 50, 10, 3, 0, 49, 0, 1, 0, 1)]
    seen[5] = None
    ranked = []
    top = it.Catalogue.top
    monkeypatch.setattr(it.Catalogue, "top", lambda self, products, *args: ranked.append(len(products)) or top(self, products, *args))
    got = dict(it.Catalogue(np.arange(50), vecs).best(labels, queries, seen, 4))
    assert ranked == [2 + 1 + 2]
    alone = {}
    for q in range(len(queries)):
        alone.update((q, found) for _, found in it.Catalogue(np.arange(50), vecs).best(labels[q : q + 1], queries[q : q + 1], seen[q : q + 1], 4))
    assert got == alone and [len(got[q]) for q in range(8)] == [4, 4, 2, 0, 4, 4, 4, 1]
    twice = it.Catalogue(np.repeat(np.arange(25), 2), vecs)
    assert all(r[0] not in (3, 7) for _, found in twice.best([[0, 1]] * 2, [list(one)] * 2, [[3, 7]] * 2, 40) for r in found)


@pytest.mark.parametrize("named", [True, False])
def test_states_are_kept_without_what_is_made_again(named):
    """a state goes on from its bytes as if it had not been put away, events that wait included; vectors are not in them."""
    import pickle

    rng = np.random.default_rng(2)
    known = {m: rng.normal(size=64) for m in range(30)}
    events = [(n, (float(n), int(m), 100 + n, float(r), known.get(int(m)))) for n, (m, r) in enumerate(zip(rng.integers(0, 33, 90), rng.integers(0, 50, 90), strict=True))]
    events[41], events[48] = events[48], events[41]  # one waits while the state is put away
    o = state.Options(refit_min=5, assign_trigger=8, outlier_trigger=4)
    run = lambda s, some: [r for seq, e in some for r in state.receive(s, seq, e, o)]
    plain, one = state.UserState(), state.UserState()
    want, got = run(plain, events[:45]), run(one, events[:45])
    assert one.held
    data = state.packed(one, named)
    assert named is (len(data) < len(pickle.dumps(one)) / 5)
    two = state.unpacked(data, known if named else None)
    assert repr(want + run(plain, events[45:])) == repr(got + run(two, events[45:])) and plain.liked == two.liked
    assert not two.held and [k for k in two.items] == [k for k in plain.items]


def test_a_stream_reads_vectors_where_they_are(spark, tmp_path, monkeypatch):
    """events of a stream are dealt without their vectors; too many items are joined before, with the same records."""
    log = spark.createDataFrame([(n, n // 5, n, n % 5, n % 4, float(n * 7 % 5), "", float(n)) for n in range(40)], replay.EVENT)
    items = spark.createDataFrame([(m, [float(m == k) for k in range(3)]) for m in range(3)], "movie_id bigint, vec array<double>")
    replay.write_log(log, f"{tmp_path}/log", 2)
    told = []
    for most in (state.MATRIX, 0):
        monkeypatch.setattr(state, "MATRIX", most)
        out = state.fold_stream(replay.read_log_stream(spark, f"{tmp_path}/log"), items, state.Options(refit_min=3))
        assert ("Join" in out._jdf.queryExecution().analyzed().toString()) == (most == 0)
        told.append(sorted(map(repr, replay.run_stream(out, f"{tmp_path}/out{most}", f"{tmp_path}/cp{most}").collect())))
    assert told[0] == told[1] and len(told[0]) == 40
