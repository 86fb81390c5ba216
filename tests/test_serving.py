"""Point queries over laid out tables against loops over the fold's decisions."""

import pytest
from pyspark.sql import functions as F

from larkspur.plans.stream import known_items, log
from larkspur.streaming import compact, serving, state

OPTIONS = state.Options(length=4, threshold=0.2, refit_min=5, assign_trigger=8, outlier_trigger=4, min_cluster=3, decide=True)
MOVIES = "movie_id bigint, title string"


def frames(records):
    """event -> (user, place, refit, points) after it, from the decisions one by one."""
    out = {}
    for user in {r.user_id for r in records}:
        points, refit = {}, None
        for r in sorted((r for r in records if r.user_id == user), key=lambda r: r.version):
            for d in (d for d in r.decisions if d.kind != "base"):
                if d.kind == "inactivate":
                    points.pop(d.raw_id, None)
                elif refit is not None:
                    points[d.raw_id] = ("assigned", d.label)
            if r.refit == "closed":
                refit, points = r.version, {d.raw_id: ("base", d.label) for d in r.decisions if d.kind == "base"}
            out[r.event_id] = (user, r.version, refit, dict(points))
    return out


@pytest.fixture(scope="module")
def served(spark, sf, tmp_path_factory):
    """The records, and their history in two epochs, each published as a part."""
    base = tmp_path_factory.mktemp("serving")
    state.fold_batch(log(spark, sf), known_items(spark, sf), OPTIONS).write.parquet(f"{base}/records")
    records = spark.read.parquet(f"{base}/records")
    h, s = compact.History(spark, f"{base}/history"), serving.Serving(spark, f"{base}/served", 8)
    half = records.groupBy("user_id").agg((F.max("version") / 2).alias("half"))
    split = records.join(half, "user_id")
    for epoch, part in enumerate(("version <= half", "version > half")):
        h.append(split.where(part).drop("half"), epoch)
        s.publish(h, epoch, [epoch])
    return records.collect(), h, s, base


def chosen(records):
    """Events of the user with most points: around the border of the epochs, and the last."""
    want = frames(records)
    user = max((len(f[3]), f[0]) for f in want.values())[1]
    own = sorted((f[1], e) for e, f in want.items() if f[0] == user)
    mid = sum(v <= own[-1][0] / 2 for v, _ in own)
    return want, user, [own[k][1] for k in (0, mid - 1, mid, len(own) - 1)], [e for _, e in own]


def test_points_and_clusters_of_an_event(served):
    records, _, s, _ = served
    want, user, events, _ = chosen(records)
    assert max(len(want[e][3]) for e in events) > 3
    for e in events:
        got = {r.raw_id: (r.kind, r.label) for r in s.points(user, e).collect()}
        assert got == want[e][3]
        labels = sorted({x for _, x in got.values() if x >= 0})
        sizes = [(k, *(sum(x == k and (kind in kinds) for kind, x in got.values()) for kinds in (("base", "assigned"), ("base",), ("assigned",)))) for k in labels]
        assert [tuple(r) for r in s.clusters(user, e).collect()] == sizes


def test_changes_of_a_segment_give_its_frames(served):
    """Also of a segment that both epochs hold."""
    records, _, s, _ = served
    want, user, events, own = chosen(records)
    refits = {want[e][2] for e in events} - {None}
    assert refits
    for refit in refits:
        rows, points = s.segment(user, refit).collect(), {}
        by_event = {}
        for r in rows:
            by_event.setdefault(r.event_id, []).append(r)
        for e in own:
            if want[e][2] != refit:
                continue
            for r in by_event.get(e, []):
                if r.change == "removed":
                    del points[r.raw_id]
                else:
                    points[r.raw_id] = (r.kind, r.label)
            assert points == want[e][3]


def test_timeline_users_and_frame(spark, served):
    records, _, s, _ = served
    want, user, events, own = chosen(records)
    assert {r.user_id for r in s.users().collect()} == {f[0] for f in want.values() if f[2] is not None}
    t = s.timeline(user).collect()
    assert [r.event_id for r in t] == own and [r.refit for r in t] == [want[e][2] for e in own]
    assert [r.is_refit for r in t] == [want[e][1] == want[e][2] for e in own]
    last = events[-1]
    rows = [(user, last, 2, 12, 0.5), (user, last, 1, 11, 0.75), (user, events[0], 1, 13, 0.25)]
    s.put(spark.createDataFrame(rows, "user_id bigint, event_id bigint, rank bigint, movie_id bigint, score double"), "recommended", 0)
    movies = spark.createDataFrame([(11, "eleven"), (13, "thirteen")], MOVIES)
    ranked = [(11, 1, 0.75, "eleven"), (12, 2, 0.5, None)]
    assert [(r.movie_id, r.rank, r.score, r.title) for r in s.recommendations(user, last, movies).collect()] == ranked
    (one,) = s.frame(user, last, movies).collect()
    assert [(r.movie_id, r.rank, r.score, r.title) for r in one.recommendations] == ranked
    assert one.noise + sum(c.size for c in one.clusters) == len(want[last][3]) and len(one.clusters) == one.k_count


def test_unknown_keys_give_no_rows(spark, served, tmp_path):
    records, _, s, _ = served
    _, user, events, _ = chosen(records)
    movies = spark.createDataFrame([], MOVIES)
    none = serving.Serving(spark, f"{tmp_path}/none")
    for at, u, e in ((s, -1, events[0]), (s, user, -1), (none, user, events[0])):
        assert at.points(u, e).isEmpty() and at.clusters(u, e).isEmpty() and at.frame(u, e, movies).isEmpty()
    assert s.timeline(-1).isEmpty() and s.segment(user, -1).isEmpty() and none.users().isEmpty()


def test_a_repeated_part_and_merged_parts(spark, served):
    """A part published again changes nothing; all epochs in one part answer the same."""
    records, h, s, base = served
    _, user, events, _ = chosen(records)
    told = lambda at: [[tuple(r) for r in at.points(user, e).collect()] for e in events] + [[tuple(r) for r in at.timeline(user).collect()]]
    before = told(s)
    s.publish(h, 1, [1])
    assert told(s) == before
    merged = serving.Serving(spark, f"{base}/merged", 8)
    merged.publish(h, 0)
    assert told(merged) == before


def test_a_lookup_reads_one_bucket(served):
    records, _, s, _ = served
    _, user, events, _ = chosen(records)
    rows = s.rows("spells", user)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo(user_id,{user})" in plan
    files = [r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


def test_a_hot_user_is_laid_out_by_several_tasks(spark, tmp_path):
    """One user with nearly all rows: its rows are cut by place, each file a range of its own."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("user_id"), F.col("id").alias("at"))
    compact.lay_out(rows, f"{tmp_path}/hot", "user_id", "at", 8)
    own = compact.served(spark, f"{tmp_path}/hot", "user_id", 7, 8).select("at", F.input_file_name().alias("f"))
    spans = sorted(tuple(r) for r in own.groupBy("f").agg(F.min("at"), F.max("at"), F.count("*")).select("min(at)", "max(at)", "count(1)").collect())
    assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(n for *_, n in spans) == rows.where("user_id = 7").count()
