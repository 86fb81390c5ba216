"""Events in any order, however late, against the batch; the history of decisions against loops."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.plans.stream import known_items, log
from larkspur.streaming import compact, late, replay, state

OPTIONS = state.Options(length=4, threshold=0.2, refit_min=5, assign_trigger=8, outlier_trigger=4, min_cluster=3, decide=True)


class Entries:
    """A map state in memory, which counts what is written."""

    def __init__(self):
        self.rows, self.bytes = {}, 0

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value
        self.bytes += len(value[0])

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))


def events_of(n, seed=0):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(12, 6)) + 3 * np.eye(12, 6)
    return [(float(3600 * k), int(m), 1000 + k, float(rng.integers(1, 9)), None if m == 11 else vecs[m]) for k, m in enumerate(rng.integers(0, 12, n))]


def in_order(events):
    s = state.UserState()
    return {e[2]: state.step(s, e, OPTIONS) for e in sorted(events, key=late.key_of)}


class Run:
    """A user's log over several batches, its state put away and taken back between them."""

    def __init__(self, o=OPTIONS):
        self.o, self.maps, self.head, self.told, self.folded = o, {p: Entries() for p in late.PARTS}, None, {}, 0

    def batch(self, events):
        import pickle

        stores = {p: late.Stored(m) for p, m in self.maps.items()}
        one = late.Log(pickle.loads(self.head) if self.head else None, stores, self.o)
        out = list(one.receive(events))
        for s in stores.values():
            s.flush()
        self.head, self.folded = pickle.dumps(one.head()), one.folded
        for r in out:
            if r["revision"] >= 0:
                before = self.told.get(r["event_id"])
                assert before is None or before["revision"] < r["revision"]
                self.told[r["event_id"]] = r
        return out

    def records(self):
        return {k: {c: v for c, v in r.items() if c != "revision"} for k, r in self.told.items()}


@pytest.mark.parametrize("seed", range(4))
def test_any_order_gives_the_records_in_order(seed):
    events, rng = events_of(260, seed), random.Random(seed)
    run, left = Run(), events[:]
    if seed:
        left.sort(key=lambda e: e[0] + rng.uniform(0, 3600 * 5 ** (1 + seed)))
    while left:
        n = rng.randrange(1, 40)
        run.batch(left[:n])
        left = left[n:]
    assert run.records() == in_order(events)


def test_a_late_event_folds_only_what_follows():
    events = events_of(600)
    run = Run()
    held = events.pop(590), events.pop(400)
    for k in range(0, len(events), 50):
        run.batch(events[k : k + 50])
    run.batch([held[0]])
    assert run.folded <= 2 * 9 + late.EVERY
    run.batch([held[1]])
    assert run.folded <= 2 * 200 + late.EVERY
    out = run.batch([held[1]])
    assert run.records() == in_order([*events, *held]) and [r["status"] for r in out] == ["duplicate"]
    assert len(run.maps["rungs"].rows) <= 2 * np.log2(600)


def test_spans_do_not_grow_with_the_history():
    """What an event in its place writes of events, records and items stays as it is; the head alone grows."""
    events, run, parts = events_of(1500), Run(state.Options(**{**OPTIONS.__dict__, "decide": False})), []
    for k in range(0, 1500, 10):
        before = sum(run.maps[p].bytes for p in ("events", "told", "items"))
        run.batch(events[k : k + 10])
        parts.append(sum(run.maps[p].bytes for p in ("events", "told", "items")) - before)
    assert np.mean(parts[-30:]) < 2 * np.mean(parts[20:50])


class Value:
    """A value state in memory."""

    def __init__(self):
        self.now, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.now is not None

    def get(self):
        self.calls += 1
        return self.now

    def update(self, value):
        self.calls += 1
        self.now = value


class Handle:
    def __init__(self):
        self.values, self.maps = {}, {}

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, Entries())


def through_states(events, sizes, seed):
    """The records of a processor over batches of a user's events, and its states."""
    from pyspark.sql import Row

    one, handle, told, rng = late.LateFold(OPTIONS), Handle(), {}, random.Random(seed)
    one.init(handle)
    left = events[:]
    if seed is not None:
        rng.shuffle(left)
    for n in sizes:
        rows = [Row(ts_s=t, movie_id=m, event_id=e, rating=r, vec=None if v is None else v.tolist()) for t, m, e, r, v in left[:n]]
        for r in one.handleInputRows((7,), iter(rows), None):
            got = r.asDict()
            assert got["user_id"] == 7 and (got["revision"] < 0 or got["revision"] > told.get(r.event_id, {"revision": -1})["revision"])
            told[r.event_id] = got
        left = left[n:]
    return {k: {c: r[c] for c in ("status", "changed", "inactive", "active", "pending", "refit", "interests", "version", "point")} for k, r in told.items()}, handle


def plainly(events):
    names = ("status", "changed", "inactive", "active", "pending", "refit", "interests", "version", "point")
    return {k: {c: r[c] for c in names} for k, r in in_order(events).items()}


def test_a_small_log_is_one_value():
    """Two calls to the state store a batch, in order or not; entries of their own took hundreds."""
    events = events_of(80)
    got, handle = through_states(events, (30, 20, 1, 1, 28), 3)
    assert got == plainly(events)
    assert handle.values["head"].calls == 10 and not any(m.rows for m in handle.maps.values())


def test_in_order_events_of_a_small_log():
    events = events_of(60)
    got, _ = through_states(events, [1] * 60, None)
    assert got == plainly(events)


@pytest.mark.parametrize("small", [0, 40, 100])
def test_a_log_that_grows_is_kept_by_entry(monkeypatch, small):
    monkeypatch.setattr(late, "SMALL", small)
    events = events_of(160, 1)
    got, handle = through_states(events, (30, 40, 1, 49, 40), 5)
    assert got == plainly(events) and all(handle.maps[p].rows for p in ("items", "events", "told", "rungs", "vectors"))


def test_stream_of_late_and_missing_events_equals_batch(spark, sf, tmp_path):
    o = state.Options(**{**OPTIONS.__dict__, "decide": False})
    items = known_items(spark, sf)
    events = log(spark, sf).where("event_id % 41 <> 3")  # some never come
    rows = events.select("user_id", "event_id", "movie_id", "ts_s", "rating")
    # dealt to files by hash; those of one user in fifty rows only in the last, long after later ones
    file = F.when(F.col("event_id") % 50 == 7, 4).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(4)))
    schema = rows.schema
    for k in range(5):
        rows.where(file == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = replay.run_stream(late.fold_late(stream, items, o), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = state.fold_batch(late.by_time(rows), items, o)
    got = late.latest(out)
    names = [c for c in state.COLUMNS if c not in ("vecs", "seen", "point", "decisions")]
    told = lambda df: sorted(map(tuple, df.select(*names).collect()), key=repr)
    assert told(got) == told(want) and out.where("revision > 0").count() > 0


def timeline_by_loop(records):
    """Counts after each event from the decisions, one by one."""
    out = {}
    for user in {r.user_id for r in records}:
        points, refit = {}, None
        for r in sorted((r for r in records if r.user_id == user), key=lambda r: r.version):
            moves = [d for d in r.decisions if d.kind != "base"]
            for d in moves:
                if d.kind == "inactivate":
                    points.pop(d.raw_id, None)
                elif refit is not None:
                    points[d.raw_id] = ("assigned", d.label)
            if r.refit == "closed":
                refit, points = r.version, {d.raw_id: ("base", d.label) for d in r.decisions if d.kind == "base"}
            out[r.event_id] = (refit, len({x for _, x in points.values() if x >= 0}), sum(x == -1 for _, x in points.values()), sum(k == "assigned" for k, _ in points.values()))
    return out


def test_history_follows_the_stream(spark, sf, tmp_path):
    """Fold, history, projection and serving on one table: as loops over the decisions, and a repeated epoch changes nothing."""
    events, items = log(spark, sf), known_items(spark, sf)
    replay.write_log(events, f"{tmp_path}/log", 4)
    for n, f in enumerate(sorted((tmp_path / "log").glob("part-*"))):
        os.utime(f, (1_700_000_000 + 10 * n,) * 2)
    stream = state.fold_stream(replay.read_log_stream(spark, f"{tmp_path}/log"), items, OPTIONS)
    h = compact.History(spark, f"{tmp_path}/history")
    h.follow(stream, f"{tmp_path}/cp")
    rows = lambda: sorted(map(tuple, h.read("timeline").drop("epoch").select("user_id", "event_id", "k_count", "noise", "assigned").collect()))
    batch = state.fold_batch(events, items, OPTIONS).collect()
    loop = timeline_by_loop(batch)
    users = {r.event_id: r.user_id for r in batch}
    want = sorted((users[e], e, *t[1:]) for e, t in loop.items())
    assert rows() == want and max(t[1] for t in loop.values()) > 1 and sum(t[3] for t in loop.values()) > 0
    epochs = sorted(r.epoch for r in h.read("decisions").select("epoch").distinct().collect())
    assert len(epochs) > 2
    schema = spark.createDataFrame([], state.RECORD).schema
    for epoch in (epochs[0], epochs[2]):
        again = spark.read.parquet(h.path("decisions", epoch)).withColumnRenamed("replay_order", "version").withColumn("status", F.lit("told"))
        again.select(*(F.col(f.name) if f.name in again.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{tmp_path}/again-{epoch}")
        h.append(spark.read.parquet(f"{tmp_path}/again-{epoch}"), epoch)
    assert rows() == want
    at = f"{tmp_path}/served"
    compact.lay_out(h.read("timeline").drop("epoch"), at, "user_id", "replay_order", 8)
    user = want[0][0]
    one = compact.served(spark, at, "user_id", user, 8)
    assert sorted((r.event_id, r.k_count) for r in one.collect()) == sorted((w[1], w[2]) for w in want if w[0] == user)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo(user_id,{user})" in plan
    files = [r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
