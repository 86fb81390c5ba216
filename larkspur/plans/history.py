"""Queries: as-of joins, compaction of a history, checkpoints, serving and run reports.

The history is derived from the events: each 13th event id is a refit with the user's points so far as
members, odd ids draw a point, each fifth removes the user's point before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import even
from ..operators import history as hs
from ..operators import statistics as st
from ..registry import query
from ..sources import adapters as ad
from .clean import PARSED
from .stats import e6

HISTORY = """ev AS (
  SELECT user_id, event_id, event_id AS replay_order, event_type, value,
         max(event_id) FILTER (event_id % 13 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev
  FROM events),
refits AS (SELECT user_id, event_id AS epoch FROM events WHERE event_id % 13 = 0),
mem AS (
  SELECT r.user_id, r.epoch, e.event_id AS raw_id, (e.event_id + r.epoch) % 4 - 1 AS label
  FROM refits r JOIN events e ON e.user_id = r.user_id AND e.event_id <= r.epoch AND e.event_id % 3 <> 0),
ch AS (
  SELECT user_id, epoch, event_id AS raw_id, event_id AS ord, 1 AS n, 'assigned' AS kind, event_id % 3 AS label FROM ev WHERE event_id % 2 = 1 AND event_id > epoch
  UNION ALL SELECT user_id, epoch, prev, event_id, 0, 'removed', NULL FROM ev WHERE event_id % 5 = 0 AND event_id > epoch AND prev IS NOT NULL
  UNION ALL SELECT user_id, epoch, raw_id, epoch, -1, 'base', label FROM mem),
st AS (
  SELECT e.user_id, e.event_id, c.raw_id, arg_max(kind, ord * 10 + n) AS kind, arg_max(coalesce(label, -9), ord * 10 + n) AS label
  FROM ev e JOIN ch c ON c.user_id = e.user_id AND c.epoch = e.epoch AND c.ord <= e.event_id GROUP BY ALL),
timeline AS (
  SELECT ev.user_id, ev.event_id, ev.replay_order, ev.epoch, count(DISTINCT label) FILTER (kind <> 'removed' AND label >= 0) AS k_count,
         count(*) FILTER (kind <> 'removed' AND label = -1) AS noise, count(*) FILTER (kind = 'assigned') AS assigned
  FROM ev LEFT JOIN st ON st.user_id = ev.user_id AND st.event_id = ev.event_id GROUP BY ALL)"""


def history(spark, d, user: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with epochs, members, changes), of one user if given: then only that user's events are read on."""
    e = ad.load(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("replay_order"), "event_type", "value")
    e = e if user is None else e.where(F.col("user_id") == user)
    refits = e.where("event_id % 13 = 0").select("user_id", "replay_order", F.col("event_id").alias("epoch"))
    ev = hs.as_of(e, refits, "user_id", "replay_order", ["epoch"])
    ev = ev.withColumn("prev", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    points = e.where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("raw_id"))
    members = refits.join(points, "user_id").where("raw_id <= epoch").select("user_id", "epoch", "raw_id", ((F.col("raw_id") + F.col("epoch")) % 4 - 1).alias("label"))
    drawn = ev.where("event_id % 2 = 1 and event_id > epoch").select("user_id", "epoch", F.col("event_id").alias("raw_id"), F.col("event_id").alias("order"), F.lit("projection").alias("change"), (F.col("event_id") % 3).alias("label"))
    gone = ev.where("event_id % 5 = 0 and event_id > epoch and prev is not null").select("user_id", "epoch", F.col("prev").alias("raw_id"), F.col("event_id").alias("order"), F.lit("inactivate").alias("change"), F.lit(None).cast("bigint").alias("label"))
    return ev, members, drawn.unionByName(gone)


def timeline_of(spark, d, user: int | None = None) -> DataFrame:
    ev, members, changes = history(spark, d, user)
    return hs.timeline(ev, hs.point_intervals(members, changes))


@query("join13_as_of", "SELECT e.user_id, e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate + INTERVAL 26 YEAR AS at_, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.at_")
def as_of(spark, d):
    """JOIN-13, WIN-21: each event with its user's last order at or before it."""
    e = ad.load(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("at_"))
    o = ad.load(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("make_interval(26)")).alias("at_"), "o_orderkey")
    o = o.groupBy("user_id", "at_").agg(F.max("o_orderkey").alias("o_orderkey"))
    return hs.as_of(e, o, "user_id", "at_", ["o_orderkey"]).drop("at_")


@query(
    "join14_recommendation_runs",
    "WITH r AS (SELECT user_id, event_id AS run FROM events WHERE event_id % 4 = 0), a AS (SELECT e.user_id, e.event_id, r.run FROM events e ASOF JOIN r ON e.user_id = r.user_id AND e.event_id >= r.run) SELECT user_id, event_id, run, k AS rank FROM a JOIN (VALUES (1), (2)) t(k) ON k <= run % 3",
)
def recommendation_runs(spark, d):
    """JOIN-14: the rows of the last run at or before an event; an empty run shows nothing."""
    e = ad.load(spark, d, "events").select("user_id", "event_id")
    runs = e.where("event_id % 4 = 0").withColumn("run", F.col("event_id"))
    at = hs.as_of(e, runs, "user_id", "event_id", ["run"]).where("run is not null")
    rows = runs.where("run % 3 > 0").select("user_id", "run", F.explode(F.sequence(F.lit(1), (F.col("run") % 3).cast("int"))).alias("rank"))
    return at.join(rows, ["user_id", "run"]).select("user_id", "event_id", "run", "rank")


@query(
    "join15_deltas",
    "WITH b AS (SELECT user_id, event_id, max(event_id) FILTER (event_id % 13 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS base_order FROM events) SELECT b.user_id, b.event_id AS replay_order, base_order, d.event_id AS delta_order FROM b JOIN events d ON d.user_id = b.user_id AND d.event_id % 2 = 1 AND d.event_id > coalesce(base_order, -1) AND d.event_id <= b.event_id",
)
def deltas(spark, d):
    """JOIN-15: changes after the base and up to the event, by user."""
    e = ad.load(spark, d, "events").select("user_id", F.col("event_id").alias("replay_order"))
    return hs.deltas_since(e, e.where("replay_order % 13 = 0"), e.where("replay_order % 2 = 1"))


@query("stm19_timeline", f"WITH {HISTORY} SELECT user_id, event_id, replay_order, epoch, k_count, noise, assigned FROM timeline")
def timeline(spark, d):
    """STM-19, WIN-24, AGG-32, STO-13: cluster counts of every event, from running sums of spells."""
    return timeline_of(spark, d)


@query("agg32_cluster_sizes", f"WITH {HISTORY} SELECT user_id, event_id, label, count(*) FILTER (kind = 'base') AS base, count(*) FILTER (kind = 'assigned') AS assigned FROM st WHERE kind <> 'removed' GROUP BY ALL")
def cluster_sizes(spark, d):
    """AGG-32: base and assigned points of each cluster at every event."""
    ev, members, changes = history(spark, d)
    return hs.cluster_sizes(ev.where("epoch is not null"), hs.point_intervals(members, changes))


FRAMES = """f AS (
  SELECT user_id, event_id, event_id AS replay_order, list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS points,
         event_id % 13 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_checkpoint FROM events),
c AS (SELECT *, max(CASE WHEN is_checkpoint THEN event_id END) OVER w AS checkpoint_id, coalesce(lag(len(points)) OVER w, 0) AS before, coalesce(lag(points) OVER w, []) AS prev FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CASE WHEN is_checkpoint THEN points ELSE points[before + 1 :] END AS stored FROM c)"""


def frames_of(spark, d, user: int | None = None):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-6, 0)
    e = ad.load(spark, d, "events")
    f = (e if user is None else e.where(F.col("user_id") == user)).select("user_id", "event_id", F.col("event_id").alias("replay_order"), F.collect_list("event_id").over(w).alias("points"))
    return hs.positional_delta(hs.checkpoints(f, F.col("event_id") % 13 == 0))


def listed(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("win16_checkpoints", f"WITH {FRAMES} SELECT user_id, event_id, is_checkpoint, checkpoint_id, array_to_string(stored, ',') AS stored FROM s")
def checkpoint_deltas(spark, d):
    """WIN-16, WIN-17, STM-20: checkpoints and positional deltas."""
    return frames_of(spark, d).select("user_id", "event_id", "is_checkpoint", "checkpoint_id", listed("stored"))


@query("stm20_keyed_delta", f"WITH {FRAMES} SELECT user_id, event_id, array_to_string(list_sort(list_filter(points, lambda x: is_checkpoint OR NOT list_contains(prev, x))), ',') AS added, array_to_string(list_sort(list_filter(prev, lambda x: NOT is_checkpoint AND NOT list_contains(points, x))), ',') AS removed FROM s")
def keyed_deltas(spark, d):
    """STM-20 (by key): what came and what went, which loses nothing."""
    out = hs.keyed_delta(frames_of(spark, d))
    text = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",").alias(c)
    return out.select("user_id", "event_id", text("added"), text("removed"))


@query("stm21_rebuilt", f"WITH {FRAMES} SELECT user_id, event_id, array_to_string(flatten(list(stored) OVER (PARTITION BY user_id, checkpoint_id ORDER BY event_id)), ',') AS rebuilt FROM s")
def rebuilt(spark, d):
    """STM-21: frames rebuilt from a checkpoint and its deltas."""
    return hs.rebuilt(frames_of(spark, d)).select("user_id", "event_id", listed("rebuilt"))


@query("stm18_decisions", f"WITH {HISTORY} SELECT user_id, kind, count(*) AS n FROM ch GROUP BY ALL")
def decisions(spark, d):
    """STM-18: the history's rows by kind of decision."""
    _, members, changes = history(spark, d)
    kind = F.when(F.col("change") == "projection", "assigned").otherwise("removed")
    return members.select("user_id", F.lit("base").alias("kind")).unionByName(changes.select("user_id", kind.alias("kind"))).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


# Serving: point queries over the compact tables.


@query("api1_users", "SELECT DISTINCT user_id FROM events WHERE event_id % 13 = 0")
def users(spark, d):
    """API-1: users with a refit."""
    return ad.load(spark, d, "events").where("event_id % 13 = 0").select("user_id").distinct()


@query("api2_timeline", f"WITH {HISTORY} SELECT event_id, epoch, k_count, noise, assigned, event_id = epoch AS is_refit_triggered FROM timeline WHERE user_id = 5")
def user_timeline(spark, d):
    """API-2: one user's events in order."""
    t = timeline_of(spark, d, user=5)
    return t.select("event_id", "epoch", "k_count", "noise", "assigned", (F.col("event_id") == F.col("epoch")).alias("is_refit_triggered")).orderBy("event_id")


@query("api3_points", f"WITH {HISTORY} SELECT raw_id, kind, label FROM st WHERE kind <> 'removed' AND user_id = 5 AND event_id = (SELECT max(event_id) FROM events WHERE user_id = 5)")
def points(spark, d):
    """API-3: the points of one event."""
    ev, members, changes = history(spark, d, user=5)
    last = ev.agg(F.max_by(F.struct("user_id", "epoch", "event_id", "replay_order"), "event_id").alias("e")).select("e.*")
    s = hs.point_intervals(members, changes)
    met = last.join(s, ["user_id", "epoch"]).where((F.col("from_order") <= F.col("replay_order")) & (F.col("to_order").isNull() | (F.col("to_order") > F.col("replay_order"))))
    return met.select("raw_id", "kind", "label").orderBy("raw_id")


@query("api4_segment", f"WITH {FRAMES} SELECT event_id, is_checkpoint, array_to_string(stored, ',') AS stored FROM s WHERE user_id = 5 AND checkpoint_id = (SELECT max(checkpoint_id) FROM s WHERE user_id = 5)")
def segment(spark, d):
    """API-4: the frames of a user's last checkpoint."""
    f = frames_of(spark, d, user=5)
    last = f.withColumn("_last", F.max("checkpoint_id").over(Window.partitionBy("user_id"))).where("checkpoint_id = _last")
    return last.select("event_id", "is_checkpoint", listed("stored")).orderBy("event_id")


@query("api5_clusters", f"WITH {HISTORY} SELECT event_id, label, count(*) AS size FROM st WHERE kind <> 'removed' AND user_id = 5 AND label >= 0 GROUP BY ALL")
def clusters(spark, d):
    """API-5, API-7, JOIN-11: the clusters of a user's events."""
    ev, members, changes = history(spark, d, user=5)
    c = hs.cluster_sizes(ev.where("epoch is not null"), hs.point_intervals(members, changes))
    return c.where("label >= 0").select("event_id", "label", (F.col("base") + F.col("assigned")).alias("size")).orderBy("event_id", "label")


@query("api6_recommended", f"WITH {PARSED} SELECT e.event_id, CAST(e.props->>'$.k' AS BIGINT) AS movie_id, p.title, coalesce(array_to_string(p.genres, '|'), '') AS genres FROM events e LEFT JOIN (SELECT * FROM parsed WHERE movie_id % 4 > 0) p ON p.movie_id = CAST(e.props->>'$.k' AS BIGINT) WHERE e.user_id = 5")
def recommended(spark, d):
    """API-6, JOIN-12, SRC-11: rows with their movies' data from another store, where it has them."""
    from ..operators.cleaning import parsed

    r = ad.ratings(spark, d).where("user_id = 5").select("event_id", "movie_id")
    m = parsed(ad.movies(spark, d)).where("movie_id % 4 > 0")
    return r.join(m, "movie_id", "left").select("event_id", "movie_id", "title", F.coalesce(F.array_join("genres", "|"), F.lit("")).alias("genres"))


@query("flt12_two_refits", "SELECT user_id, count(*) AS refits FROM events WHERE event_id % 13 = 0 GROUP BY user_id HAVING count(*) >= 2")
def two_refits(spark, d):
    """FLT-12 (serving): users kept in the compact tables."""
    return ad.load(spark, d, "events").where("event_id % 13 = 0").groupBy("user_id").agg(F.count("*").alias("refits")).where("refits >= 2")


# Run reports over a log of stage attempts: events as attempts, their type as the stage.

ATTEMPTS = "a AS (SELECT event_id, event_type AS stage, user_id, value AS latency, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events)"


def attempts(spark, d):
    e = ad.load(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("stage"), "user_id", F.col("value").alias("latency"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"))


@query("rpt1_stages", f"WITH {ATTEMPTS}, s AS (SELECT stage, count(*) AS count, count(*) FILTER (status = 'failed') AS failed, {e6('avg(latency)')} AS mean, {e6('quantile_cont(latency, 0.5)')} AS p50, {e6('quantile_cont(latency, 0.95)')} AS p95, max(latency) AS max, round_even(sum(latency), 2) AS total FROM a GROUP BY stage) SELECT *, total = max(total) OVER () AS dominant FROM s")
def stages(spark, d):
    """RPT-1: attempts, failures and latency of each stage; the stage with the largest total leads."""
    a = attempts(spark, d)
    s = a.groupBy("stage").agg(
        F.count("*").alias("count"), F.count_if(F.col("status") == "failed").alias("failed"), even(F.avg("latency")).alias("mean"), F.max("latency").alias("max"), even(F.sum("latency"), 2).alias("total")
    )
    # a row for each stage
    s = s.join(st.picked(a, "latency", {"p50": 0.5, "p95": 0.95}, "stage"), "stage")
    return s.withColumn("dominant", F.col("total") == F.max("total").over(Window.partitionBy(F.lit(1))))


@query("rpt2_event_progress", "SELECT e.event_id, e.user_id, i.o_orderkey IS NOT NULL AS ingested, i.total FROM events e LEFT JOIN (SELECT o_orderkey, max(o_totalprice) AS total FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_orderkey) i ON i.o_orderkey = e.event_id")
def event_progress(spark, d):
    """RPT-2, JOIN-10: progress rows with their input rows, where there is one."""
    i = ad.load(spark, d, "orders").where("o_orderkey % 3 > 0").groupBy(F.col("o_orderkey").alias("event_id")).agg(F.max("o_totalprice").alias("total"))
    return ad.load(spark, d, "events").select("event_id", "user_id").join(i, "event_id", "left").select("event_id", "user_id", F.col("total").isNotNull().alias("ingested"), "total")


@query("rpt3_runtime_metrics", "SELECT count(*) AS samples, max(value) FILTER (event_id % 5 > 0) AS max_lag, arg_max(value, event_id) AS last_throughput FROM events")
def runtime_metrics(spark, d):
    """RPT-3: the largest of a nullable metric and the last of another."""
    return ad.load(spark, d, "events").agg(F.count("*").alias("samples"), F.max(F.when(F.col("event_id") % 5 > 0, F.col("value"))).alias("max_lag"), F.max_by("value", "event_id").alias("last_throughput"))


@query("rpt4_assignments", f"WITH {ATTEMPTS} SELECT stage, status, count(*) AS n, {e6('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY stage)')} AS share FROM a GROUP BY stage, status")
def assignments(spark, d):
    """RPT-4: rows by status, and their share."""
    n = attempts(spark, d).groupBy("stage", "status").agg(F.count("*").alias("n"))
    return n.withColumn("share", even(F.col("n") / F.sum("n").over(Window.partitionBy("stage"))))


@query("rpt5_refits", f"WITH {HISTORY}, g AS (SELECT user_id, epoch, count(*) AS points, count(DISTINCT label) FILTER (label >= 0) AS k FROM mem GROUP BY ALL) SELECT count(*) AS refits, count(DISTINCT user_id) AS users, {e6('avg(points)')} AS mean_points, max(points) AS most_points, {e6('avg(k)')} AS mean_k FROM g")
def refits(spark, d):
    """RPT-5: refits, their points and clusters."""
    _, members, _ = history(spark, d)
    g = members.groupBy("user_id", "epoch").agg(F.count("*").alias("points"), F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"))
    return g.agg(F.count("*").alias("refits"), F.countDistinct("user_id").alias("users"), even(F.avg("points")).alias("mean_points"), F.max("points").alias("most_points"), even(F.avg("k")).alias("mean_k"))


@query("rpt6_users", f"WITH {ATTEMPTS} SELECT user_id, count(*) AS events, count(*) FILTER (status = 'failed') AS failed, round_even(sum(latency), 2) AS total FROM a GROUP BY user_id")
def user_report(spark, d):
    """RPT-6: events, failures and time of each user."""
    return attempts(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"), even(F.sum("latency"), 2).alias("total"))


@query("rpt7_embeddings", "SELECT label % 2 AS mode, count(*) AS snapshots, CAST(sum(vec_id % 5) AS BIGINT) AS rows, max(vec_id % 5) AS most, min(len(embedding)) AS dim FROM embeddings GROUP BY ALL")
def embedding_report(spark, d):
    """RPT-7: snapshots of vectors by mode."""
    n = F.col("vec_id") % 5
    return ad.load(spark, d, "embeddings").groupBy((F.col("label") % 2).alias("mode")).agg(F.count("*").alias("snapshots"), F.sum(n).alias("rows"), F.max(n).alias("most"), F.min(F.size("embedding")).cast("bigint").alias("dim"))


@query("rpt8_recommendations", "SELECT count(*) AS runs, CAST(sum(event_id % 3) AS BIGINT) AS rows, count(*) FILTER (event_id % 3 = 0) AS empty FROM events WHERE event_id % 4 = 0")
def recommendation_report(spark, d):
    """RPT-8: runs, their rows, and empty ones."""
    n = F.col("event_id") % 3
    return ad.load(spark, d, "events").where("event_id % 4 = 0").agg(F.count("*").alias("runs"), F.sum(n).alias("rows"), F.count_if(n == 0).alias("empty"))


@query(
    "rpt9_findings",
    f"WITH {ATTEMPTS}, s AS (SELECT stage, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0 END) AS rate, quantile_cont(latency, 0.95) AS p95, sum(latency) / sum(sum(latency)) OVER () AS part FROM a GROUP BY stage) SELECT stage, 'failures' AS finding FROM s WHERE rate > 0.085 UNION ALL SELECT stage, 'slow_tail' FROM s WHERE p95 > 60 UNION ALL SELECT stage, 'dominant' FROM s WHERE part > 0.2",
)
def findings(spark, d):
    """RPT-9: rules over the stage report."""
    rows = attempts(spark, d)
    a = rows.groupBy("stage").agg(F.avg((F.col("status") == "failed").cast("double")).alias("rate"), F.sum("latency").alias("total")).join(st.picked(rows, "latency", {"p95": 0.95}, "stage"), "stage")
    a = a.withColumn("part", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))))
    rules = {"failures": F.col("rate") > 0.085, "slow_tail": F.col("p95") > 60, "dominant": F.col("part") > 0.2}
    return a.select("stage", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in rules.items())))).alias("finding"))
