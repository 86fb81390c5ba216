"""Queries: clustering, replay, the per-user state machine, and its tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import even
from ..operators import clustering as cg
from ..operators import interests as it
from ..registry import RATINGS, query
from ..session import scratch
from ..sources import adapters as ad
from ..streaming import compact, late, replay, serving, state, store
from .interests import members
from .stats import e6

OPTIONS = state.Options(length=10, threshold=0.2, refit_min=5, assign_trigger=8, outlier_trigger=4, min_cluster=3)


@query("clu1_density")
def density(spark, d):
    """CLU-1 to CLU-3, CLU-5, CLU-6, CLU-9: density clusters and a 3-d projection of each user's vectors."""
    c = cg.cluster_users(members(spark, d), least=3, skip_under=6)
    return c.withColumn("sequence_length", F.count("*").over(Window.partitionBy("user_id")))


@query("win7_sliding_k")
def sliding_k(spark, d):
    """WIN-7: the number of clusters in sliding windows of a user's rows."""
    return cg.sliding_counts(members(spark, d), width=20, step=5)


LOG = RATINGS + """,
log AS (
  SELECT row_number() OVER (ORDER BY ts_s, user_id, movie_id, event_id) - 1 AS replay_order,
         row_number() OVER (PARTITION BY user_id ORDER BY ts_s, movie_id, event_id) - 1 AS user_seq, event_id, user_id, movie_id, rating, ts_s
  FROM ratings)"""


def log(spark, d):
    """The replay log of the whole table."""
    return replay.event_log(ad.ratings(spark, d), float("-inf"), float("inf"))


def known_items(spark, d):
    return ad.items(spark, d).where(ad.known())


def folded(spark, d, o: state.Options):
    """The records of all events of the table, each user's in order."""
    return state.fold_batch(replay.user_log(ad.ratings(spark, d)), known_items(spark, d), o, dealt=True)


@query("stm1_event_log", f"WITH {LOG} SELECT * FROM log")
def event_log(spark, d):
    """STM-1: the replay log, densely numbered over the whole table and by user."""
    return log(spark, d).drop("rated_at")


@query("flt5_time_range", f"WITH {RATINGS} SELECT row_number() OVER (ORDER BY ts_s, user_id, movie_id, event_id) - 1 AS replay_order, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, movie_id, event_id) - 1 AS user_seq FROM ratings WHERE ts_s BETWEEN 1704300000 AND 1706000000")
def ranged_log(spark, d):
    """FLT-5: a log of an inclusive time range; its numbers are dense again."""
    return replay.event_log(ad.ratings(spark, d), 1704300000, 1706000000).select("replay_order", "event_id", "user_seq")


CLOCK = LOG + """,
due AS (SELECT *, (ts_s - min(ts_s) OVER ()) / 5000.0 AS due_s FROM log),
clock AS (
  SELECT *, max(due_s - replay_order * 0.15) OVER (ORDER BY replay_order) + replay_order * 0.15 AS emitted_s FROM due)"""


@query("stm2_trace_clock", f"WITH {CLOCK} SELECT replay_order, {e6('due_s')} AS due_s, {e6('emitted_s')} AS emitted_s, emitted_s - due_s > 0.001 AS behind FROM clock")
def trace_clock(spark, d):
    """STM-2: when events are due and emitted at 5000 times the speed."""
    c = replay.scheduled(log(spark, d), 5000.0, 0.15)
    return c.select("replay_order", even(F.col("due_s")).alias("due_s"), even(F.col("emitted_s")).alias("emitted_s"), "behind")


@query("stm3_ingress", f"WITH {CLOCK} SELECT event_id AS key, replay_order AS seq, {e6('emitted_s - due_s')} AS lag_s, emitted_s - due_s > 0.001 AS behind FROM clock")
def ingress(spark, d):
    """STM-3: ingress records as upserts by event: of a record that is sent twice the later stays."""
    c = replay.scheduled(log(spark, d), 5000.0, 0.15)
    rows = c.select(F.col("event_id").alias("key"), F.col("replay_order").alias("seq"), even(F.col("lag_s")).alias("lag_s"), "behind")
    stale = rows.withColumns({"seq": F.col("seq") - 1, "lag_s": F.lit(-1.0), "behind": F.lit(None).cast("boolean")})
    return store.upsert(rows.unionByName(stale), ["key"], "seq", ["lag_s", "behind"])


@query("dat7_due", f"WITH {CLOCK} SELECT event_id, {e6('due_s')} AS due_s FROM clock")
def due_times(spark, d):
    """DAT-7: scheduled = (ts - first ts) / speed."""
    return replay.scheduled(log(spark, d), 5000.0, 0.15).select("event_id", even(F.col("due_s")).alias("due_s"))


@query("stm16_progress", f"WITH {CLOCK} SELECT replay_order // 1000 AS batch, count(*) AS events, {e6('max(emitted_s)')} AS done_s, {e6('max(emitted_s - due_s)')} AS max_lag_s FROM clock GROUP BY ALL")
def progress(spark, d):
    """STM-16: events, time and lag of every thousand events."""
    c = replay.scheduled(log(spark, d), 5000.0, 0.15)
    return c.groupBy(F.floor(F.col("replay_order") / 1000).alias("batch")).agg(F.count("*").alias("events"), even(F.max("emitted_s")).alias("done_s"), even(F.max("lag_s")).alias("max_lag_s"))


@query("stm17_run_summary", f"WITH {CLOCK} SELECT count(*) AS events, {e6('count(*) * 5000.0 / 1700000.0')} AS target_eps, {e6('count(*) / max(emitted_s)')} AS actual_eps, {e6('avg(emitted_s - due_s)')} AS mean_lag_s, {e6('max(emitted_s - due_s)')} AS max_lag_s, count(*) FILTER (emitted_s - due_s > 0.001) AS behind FROM clock")
def run_summary(spark, d):
    """STM-17: rates and lags of a run."""
    return replay.run_summary(replay.scheduled(log(spark, d), 5000.0, 0.15), 5000.0, 1700000.0)


# What the state machine holds after each event, from all pairs of a user's events: pos are the ratings that are positive
# then, act those of known items, with the items of their contexts.
STATES = LOG + """,
bars AS (SELECT *, count(*) OVER w AS n, avg(rating) OVER w AS mean, stddev_pop(rating) OVER w AS std FROM log WINDOW w AS (PARTITION BY user_id ORDER BY user_seq)),
pos AS (
  SELECT a.user_id, a.user_seq AS i, b.user_seq AS j, b.movie_id FROM bars a JOIN log b ON a.user_id = b.user_id AND b.user_seq <= a.user_seq
  WHERE a.n < 3 OR a.std <= 1e-8 OR b.rating > round_even(a.mean * 1e9, 0) / 1e9 + 1e-9),
act AS (SELECT *, list(movie_id) OVER (PARTITION BY user_id, i ORDER BY j ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c FROM pos WHERE movie_id % 10 <> 7),
n_act AS (SELECT user_id, i, count(*) AS active FROM act GROUP BY ALL),
moved AS (
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.i, b.i + 1) AS i, count(*) FILTER (a.c IS DISTINCT FROM b.c AND a.i IS NOT NULL) AS changed, count(*) FILTER (a.i IS NULL) AS inactive
  FROM act a FULL JOIN act b ON a.user_id = b.user_id AND a.i = b.i + 1 AND a.j = b.j GROUP BY ALL),
own AS (
  SELECT l.user_id, l.event_id, l.user_seq AS i, coalesce(changed, 0) AS changed, coalesce(inactive, 0) AS inactive, coalesce(active, 0) AS active,
         EXISTS (SELECT 1 FROM act WHERE act.user_id = l.user_id AND act.i = l.user_seq AND act.j = l.user_seq) AS on_,
         EXISTS (SELECT 1 FROM pos WHERE pos.user_id = l.user_id AND pos.i = l.user_seq AND pos.j = l.user_seq) AS liked
  FROM log l LEFT JOIN moved ON moved.user_id = l.user_id AND moved.i = l.user_seq LEFT JOIN n_act ON n_act.user_id = l.user_id AND n_act.i = l.user_seq)"""
# A forced refit at each tenth event is tried until five rows are active.
REFITS = STATES + """,
tries AS (
  SELECT *, CASE WHEN i >= 9 THEN i - (i + 1) % 10 END AS since, active >= 5 AS enough FROM own),
told AS (
  SELECT t.*, NOT EXISTS (SELECT 1 FROM tries e WHERE e.user_id = t.user_id AND e.i >= t.since AND e.i < t.i AND e.enough) AND t.since IS NOT NULL AS tried FROM tries t),
outcomes AS (SELECT *, CASE WHEN tried AND enough THEN 'closed' WHEN tried THEN 'skipped' END AS refit FROM told)"""
NEVER = 10**12
FORCED = {"refit_min": 5, "pending_trigger": NEVER, "assign_trigger": NEVER, "outlier_trigger": NEVER, "forced_every": 10}


def only_forced(**more) -> state.Options:
    """A refit at every tenth event of a user, the usual triggers out of reach."""
    return state.Options(**(FORCED | more))


@query("stm4_states", f"WITH {STATES} SELECT event_id, CASE WHEN on_ THEN 'pending_no_interest' WHEN liked THEN 'unknown_item' ELSE 'not_positive' END AS status, active FROM own")
def states(spark, d):
    """STM-4: each event appended to its user's state, which is judged anew; without refits every known positive waits."""
    o = state.Options(refit_min=NEVER, assign_trigger=NEVER, outlier_trigger=NEVER)
    return folded(spark, d, o).select("event_id", "status", "active")


@query("stm7_changed_rows", f"WITH {STATES} SELECT event_id, changed, inactive, active FROM own")
def changed_rows(spark, d):
    """STM-7: only rows whose context changed are embedded again; rows that cease to be positive leave."""
    return folded(spark, d, OPTIONS).select("event_id", "changed", "inactive", "active")


@query("stm9_fold_batch")
def fold_batch(spark, d):
    """STM-9: every user's events through the state machine, as a batch."""
    return folded(spark, d, OPTIONS).drop("vecs", "seen", "decisions")


PENDING = STATES + """,
met AS (SELECT user_id, j, min(i) AS i FROM act GROUP BY ALL),
waiting AS (SELECT o.user_id, o.event_id, o.i, o.active, (SELECT count(*) FROM met WHERE met.user_id = o.user_id AND met.i <= o.i) AS pending FROM own o)"""


@query("stm10_pending", f"WITH {PENDING} SELECT event_id, pending FROM waiting")
def waiting(spark, d):
    """STM-10: the counter behind the pending trigger: rows that wait, also those that have become inactive."""
    o = state.Options(refit_min=NEVER, assign_trigger=NEVER, outlier_trigger=NEVER)
    return folded(spark, d, o).select("event_id", "pending")


@query("stm12_first_refits", f"WITH {PENDING} SELECT user_id, arg_min(event_id, i) AS event_id FROM waiting WHERE pending >= 5 AND active >= 5 GROUP BY user_id")
def first_refits(spark, d):
    """STM-12: the refit that five pending rows ask for, put off while too few rows are active."""
    out = folded(spark, d, OPTIONS).where("refit = 'closed'")
    order = log(spark, d).select("event_id", "replay_order")
    return out.join(order, "event_id").groupBy("user_id").agg(F.min_by("event_id", "replay_order").alias("event_id"))


@query("stm11_forced_refits", f"WITH {REFITS} SELECT user_id, refit, count(*) AS n FROM outcomes WHERE refit IS NOT NULL GROUP BY ALL")
def forced_refits(spark, d):
    """STM-11: a refit at every tenth event of a user, the usual triggers out of reach."""
    out = folded(spark, d, only_forced())
    return out.where("refit is not null").groupBy("user_id", "refit").agg(F.count("*").alias("n"))


@query("clu8_refit_reset", f"WITH {REFITS}, c AS (SELECT *, max(CASE WHEN refit = 'closed' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM outcomes) SELECT event_id, CASE WHEN last IS NULL THEN 0 ELSE 1 END AS interests, refit FROM c")
def refit_reset(spark, d):
    """CLU-8: a refit in which all rows are noise leaves one interest, the mean of all."""
    out = folded(spark, d, only_forced(min_cluster=NEVER))
    return out.select("event_id", "interests", "refit")


@query("stm15_projected", f"WITH {REFITS}, c AS (SELECT *, max(CASE WHEN refit = 'closed' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM outcomes) SELECT event_id, CASE WHEN NOT on_ THEN 'not_projected' WHEN coalesce(last < i, false) OR coalesce((SELECT max(e.i) FROM c e WHERE e.user_id = c.user_id AND e.refit = 'closed' AND e.i < c.i) >= 0, false) THEN 'projected' ELSE 'not_projected' END AS outcome FROM c")
def projected_rows(spark, d):
    """STM-15: an assigned row is drawn with the reducer of the last refit; others, and rows before a refit, are not."""
    out = folded(spark, d, only_forced(threshold=-1.0))
    return out.select("event_id", F.when(F.col("point").isNotNull(), "projected").otherwise("not_projected").alias("outcome"))


AFTER = REFITS + """,
c AS (SELECT user_id, event_id, i, max(CASE WHEN refit = 'closed' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM outcomes),
vecs AS (SELECT vec_id AS movie_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
cells AS (SELECT a.user_id, a.i, p, avg(x) AS x FROM act a JOIN (SELECT DISTINCT user_id, last AS i FROM c WHERE last IS NOT NULL) r USING (user_id, i) JOIN vecs USING (movie_id) GROUP BY ALL),
dots AS (SELECT user_id, i AS last, v.movie_id, round_even(sum(cells.x * v.x) * 1e9, 0) / 1e9 AS score FROM cells JOIN vecs v USING (p) GROUP BY ALL),
ranked AS (
  SELECT event_id, d.movie_id, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, d.movie_id) AS rank
  FROM c JOIN dots d ON c.user_id = d.user_id AND c.last = d.last
  WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.user_id = c.user_id AND pos.i = c.i AND pos.movie_id = d.movie_id))"""


def after_events(records, items, k):
    """The k best unseen items after each event, by the interests that it left."""
    labels = F.transform("vecs", lambda v, i: i.cast("bigint"))
    asked = records.where("size(vecs) > 0").select("user_id", "event_id", labels.alias("labels"), "vecs", "seen")
    return it.best_items(asked, items, k, "user_id", "event_id")


@query("stm14_after_event", f"WITH {AFTER} SELECT event_id, movie_id, {e6('score')} AS score, rank FROM ranked WHERE rank <= 3")
def recommended_after(spark, d):
    """STM-14: recommendations after every event, from the state as it is then: interests of the last refit, positives seen."""
    o = only_forced(length=1, min_cluster=NEVER, recommend=True)
    out = after_events(folded(spark, d, o), ad.items(spark, d), 3)
    return out.select("event_id", "movie_id", even(F.col("score")).alias("score"), "rank")


def streamed(spark, events, items, o, files=4, seed=None):
    """What the fold makes of a log read as a stream, in files micro-batches."""
    base = f"{scratch(spark)}/{uuid.uuid4().hex}"
    replay.write_log(events, f"{base}/log", files)
    return replay.run_stream(state.fold_stream(replay.read_log_stream(spark, f"{base}/log"), items, o, seed), f"{base}/out", f"{base}/checkpoint")


@query("stm22_fold_stream", f"WITH {STATES} SELECT event_id, changed, inactive, active FROM own")
def fold_stream(spark, d):
    """STM-22: the same from a file stream with state by user, in whatever order its files come."""
    return streamed(spark, log(spark, d), known_items(spark, d), OPTIONS).select("event_id", "changed", "inactive", "active")


@query("stm22_late_events", f"WITH {STATES} SELECT event_id, changed, inactive, active FROM own")
def late_events(spark, d):
    """STM-22: a stream whose files hold the events in no order: what was told too early is told again, and ends as the batch."""
    events = log(spark, d).select("user_id", "event_id", "movie_id", "ts_s", "rating")
    base = f"{scratch(spark)}/{uuid.uuid4().hex}"
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    out = replay.run_stream(late.fold_late(stream, known_items(spark, d), OPTIONS), f"{base}/out", f"{base}/checkpoint")
    return late.latest(out).select("event_id", "changed", "inactive", "active")


# The fold's own decisions as history, projected and served. Labels are the clusters', which SQL does not have; what it does
# have: at the refit before an event (e) all active rows are members, and a row that is first met after it is assigned, until it leaves.
DECIDED = REFITS + """,
c AS (
  SELECT *, max(CASE WHEN refit = 'closed' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS e,
         max(CASE WHEN refit = 'closed' THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM outcomes),
spans AS (
  SELECT c.user_id, c.event_id, c.i, c.e, a.j, count(*) AS n, min(a.i) AS first, max(a.i) AS last
  FROM c JOIN act a ON a.user_id = c.user_id AND a.i BETWEEN c.e AND c.i GROUP BY ALL),
drawn AS (
  SELECT c.user_id, c.event_id, c.i AS place, c.e IS NOT NULL AS fitted, coalesce(x.assigned, 0) AS assigned, coalesce(x.base, 0) AS base
  FROM c LEFT JOIN (
    SELECT user_id, event_id, count(*) FILTER (last = i AND n = i - first + 1 AND first > e) AS assigned, count(*) FILTER (last = i AND n = i - first + 1 AND first = e) AS base
    FROM spans GROUP BY ALL) x USING (user_id, event_id))"""


def projection(spark, d):
    """The fold's history of the whole log, appended as one epoch, with clustering on."""
    h = compact.History(spark, f"{scratch(spark)}/history-{uuid.uuid4().hex}")
    h.append(folded(spark, d, only_forced(threshold=-1.0, decide=True)), 0)
    return h


@query("stm18_fold_decisions", f"""WITH {DECIDED}
SELECT user_id, 'base' AS kind, CAST(sum(active) AS BIGINT) AS n FROM outcomes WHERE refit = 'closed' GROUP BY user_id
UNION ALL SELECT user_id, 'inactivate', CAST(sum(inactive) AS BIGINT) FROM outcomes GROUP BY user_id HAVING sum(inactive) > 0
UNION ALL SELECT user_id, 'projection', count(*) FROM (
  SELECT DISTINCT c.user_id, c.before, a.j FROM c JOIN act a ON a.user_id = c.user_id AND a.i = c.i
  WHERE c.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM act b WHERE b.user_id = c.user_id AND b.i = c.before AND b.j = a.j)) GROUP BY user_id""")
def fold_decisions(spark, d):
    """STM-18: the fold's decisions on single rows, as its history keeps them."""
    told = projection(spark, d).read("decisions").select("user_id", F.inline("decisions"))
    return told.groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query("stm19_fold_timeline", f"WITH {DECIDED} SELECT user_id, event_id, fitted, assigned FROM drawn")
def fold_timeline(spark, d):
    """STM-19: the compact projection of the fold's own history: after each event the points drawn since the last refit."""
    return projection(spark, d).read("timeline").select("user_id", "event_id", F.col("refit").isNotNull().alias("fitted"), "assigned")


@query("api2_served", f"WITH {DECIDED} SELECT event_id, assigned FROM drawn WHERE user_id = 5")
def served_timeline(spark, d):
    """API-2: one user's timeline from a table laid out by user; the plan reads one bucket."""
    at = f"{scratch(spark)}/served-{uuid.uuid4().hex}"
    compact.lay_out(projection(spark, d).read("timeline").select("user_id", "event_id", "replay_order", "k_count", "noise", "assigned"), at, "user_id", "replay_order")
    return compact.served(spark, at, "user_id", 5).select("event_id", "assigned").orderBy("event_id")


def served_tables(spark, d) -> serving.Serving:
    """The fold's history, laid out by user."""
    s = serving.Serving(spark, f"{scratch(spark)}/serving-{uuid.uuid4().hex}")
    s.publish(projection(spark, d), 0)
    return s


def last_of(timeline, column: str) -> int:
    """The latest value of one user's timeline; -1, which no table has, if there is none."""
    got = timeline.agg(F.max_by(column, "replay_order")).first()[0]
    return -1 if got is None else got


@query("api1_served", f"WITH {REFITS} SELECT DISTINCT user_id FROM outcomes WHERE refit = 'closed'")
def served_users(spark, d):
    """API-1: users with a refit, from the laid out timeline."""
    return served_tables(spark, d).users()


@query("api3_served", f"""WITH {DECIDED}
SELECT l.event_id AS raw_id, CASE WHEN s.first = c.e THEN 'base' ELSE 'assigned' END AS kind
FROM spans s JOIN c ON c.event_id = s.event_id JOIN log l ON l.user_id = s.user_id AND l.user_seq = s.j
WHERE s.user_id = 5 AND s.last = s.i AND s.n = s.i - s.first + 1 AND s.i = (SELECT max(i) FROM c WHERE user_id = 5)""")
def served_points(spark, d):
    """API-3: the points that one user's last event shows, from spells laid out by user."""
    s = served_tables(spark, d)
    return s.points(5, last_of(s.timeline(5), "event_id")).select("raw_id", "kind")


@query("api4_served", f"""WITH {DECIDED},
seg AS (SELECT event_id, i, e FROM c WHERE user_id = 5 AND e = (SELECT max(e) FROM c WHERE user_id = 5)),
runs AS (
  SELECT a.j, a.i, row_number() OVER (PARTITION BY a.j ORDER BY a.i) AS k, min(a.i) OVER (PARTITION BY a.j) AS first
  FROM act a JOIN seg ON seg.i = a.i WHERE a.user_id = 5),
ends AS (SELECT j, first, max(i) AS last FROM runs WHERE i = first + k - 1 GROUP BY ALL)
SELECT seg.event_id, l.event_id AS raw_id, 'drawn' AS change, CASE WHEN first = e THEN 'base' ELSE 'assigned' END AS kind
FROM ends JOIN seg ON seg.i = first JOIN log l ON l.user_id = 5 AND l.user_seq = j
UNION ALL SELECT seg.event_id, l.event_id, 'removed', NULL FROM ends JOIN seg ON seg.i = last + 1 JOIN log l ON l.user_id = 5 AND l.user_seq = j""")
def served_segment(spark, d):
    """API-4: what each event since one user's last refit draws and removes."""
    s = served_tables(spark, d)
    return s.segment(5, last_of(s.timeline(5).where("refit is not null"), "refit")).select("event_id", "raw_id", "change", "kind")


@query("api5_served", f"WITH {DECIDED} SELECT event_id, base, assigned FROM drawn WHERE user_id = 5 AND place = (SELECT max(i) FROM c WHERE user_id = 5) AND fitted")
def served_clusters(spark, d):
    """API-5, API-7: one user's last event with its clusters and noise; labels are the clusters', so their sums are told."""
    s = served_tables(spark, d)
    event = last_of(s.timeline(5), "event_id")
    sums = s.clusters(5, event).select("base", "assigned").unionByName(s.points(5, event).where("label < 0").select((F.col("kind") == "base").cast("bigint").alias("base"), (F.col("kind") == "assigned").cast("bigint").alias("assigned")))
    total = sums.agg(F.coalesce(F.sum("base"), F.lit(0)).alias("base"), F.coalesce(F.sum("assigned"), F.lit(0)).alias("assigned")).withColumn("event_id", F.lit(event).cast("bigint"))
    at = s.timeline(5).where(F.col("event_id") == event).where("refit is not null").select("event_id")
    return at.join(total, "event_id").select("event_id", "base", "assigned")


@query("sto14_resumed", f"WITH {STATES} SELECT event_id, changed, active FROM own")
def resumed(spark, d):
    """STO-14: a stream that stops and goes on from its checkpoint: what it has told is kept, and nothing is told twice."""
    base, events, items = f"{scratch(spark)}/{uuid.uuid4().hex}", log(spark, d), known_items(spark, d)
    half = events.count() // 2
    for part in (F.col("replay_order") < half, F.col("replay_order") >= half):
        replay.write_log(events.where(part), f"{base}/log", 2, append=True)
        out = replay.run_stream(state.fold_stream(replay.read_log_stream(spark, f"{base}/log"), items, OPTIONS), f"{base}/out", f"{base}/checkpoint")
    return out.select("event_id", "changed", "active")


@query("stm6_seed_states", f"WITH {STATES}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM own JOIN log USING (user_id, event_id) WHERE ts_s < 1705000000) SELECT user_id, i + 1 AS ratings, active, CASE WHEN active > 0 THEN true ELSE false END AS fitted FROM l WHERE r = 1")
def seed_states(spark, d):
    """STM-6: states at an exclusive cutoff, from which a stream can start."""
    s = state.seed_states(log(spark, d), known_items(spark, d), 1705000000.0, OPTIONS)
    return s.select("user_id", "ratings", "active", (F.col("interests") > 0).alias("fitted"))


@query("stm5_states_from_history", f"WITH {STATES} SELECT event_id, active FROM own JOIN log USING (user_id, event_id) WHERE ts_s >= 1705000000")
def seeded_stream(spark, d):
    """STM-5: a stream that starts from states built of the history before a cutoff."""
    items, events = known_items(spark, d), log(spark, d)
    seed = state.seed_states(events, items, 1705000000.0, OPTIONS).select("user_id", "state")
    later = replay.event_log(ad.ratings(spark, d).where("ts_s >= 1705000000"), float("-inf"), float("inf"))
    return streamed(spark, later, items, OPTIONS, seed=seed).select("event_id", "active")


SOURCES = LOG + """,
src AS (
  SELECT user_id, 1 AS place, 'run' AS origin, max(event_id) AS version FROM log WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY user_id
  UNION ALL SELECT user_id, 2, 'seed', max(event_id) FROM log WHERE event_id % 5 = 0 AND user_id % 3 > 0 GROUP BY user_id
  UNION ALL SELECT user_id, 3, 'file', min(event_id) FROM log GROUP BY user_id)"""


@query("join19_state_sources", f"WITH {SOURCES} SELECT user_id, arg_min(origin, place) AS origin, arg_min(version, place) AS version FROM src GROUP BY user_id")
def state_sources(spark, d):
    """JOIN-19: a user's state from the run's store, else the seed's, else the file."""
    e = log(spark, d)
    of = lambda rows, v: rows.groupBy("user_id").agg(v.alias("version"))
    run = of(e.where("event_id % 3 = 0 and user_id % 2 = 0"), F.max("event_id"))
    seed = of(e.where("event_id % 5 = 0 and user_id % 3 > 0"), F.max("event_id"))
    return store.first_of({"run": run, "seed": seed, "file": of(e, F.min("event_id"))}, "user_id", ["version"])


@query("stm23_duplicates", f"WITH {LOG} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS records, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS duplicates FROM log")
def duplicates(spark, d):
    """STM-23: events that come twice; the second is told as a duplicate and changes nothing."""
    e = log(spark, d)
    out = state.fold_batch(e.unionByName(e.where("event_id % 10 = 0")), known_items(spark, d), OPTIONS)
    return out.groupBy("event_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))


# A log of changes: each event upserts a row of its movie.
CHANGES = RATINGS + """,
ch AS (
  SELECT movie_id AS key, event_id AS seq, user_id % 7 AS a, CASE WHEN event_id % 3 = 0 THEN rating END AS b,
         CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'running' WHEN 2 THEN 'closed' ELSE 'skipped' END AS status
  FROM ratings)"""


def changes(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("open", "running", "closed", "skipped"))), (F.col("event_id") % 4 + 1).cast("int"))
    return ad.ratings(spark, d).select(F.col("movie_id").alias("key"), F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("rating")).alias("b"), status.alias("status"))


@query("sto1_coalescing_upsert", f"WITH {CHANGES} SELECT key, arg_max(a, seq) AS a, arg_max(b, seq) FILTER (b IS NOT NULL) AS b, max(seq) AS seq FROM ch GROUP BY key")
def coalescing_upsert(spark, d):
    """STO-1: the last value of each column that is not null."""
    return store.upsert(changes(spark, d), ["key"], "seq", ["a", "b"], coalesce=True)


@query("sto2_replacing_upsert", f"WITH {CHANGES} SELECT key, a, b, seq FROM ch QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def replacing_upsert(spark, d):
    """STO-2, STO-6, SNK-4: the last row of each key."""
    return store.upsert(changes(spark, d), ["key"], "seq", ["a", "b"])


@query("sto3_replaced_children", f"WITH {CHANGES}, v AS (SELECT key, a, seq, max(seq) FILTER (status = 'closed') OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM ch) SELECT key, seq, a FROM v WHERE cut IS NULL OR seq >= cut")
def replaced_children(spark, d):
    """STO-3: a key's rows replaced as a whole: those since its last 'closed' stay."""
    return store.since_last(changes(spark, d), "key", "seq", F.col("status") == "closed").select("key", "seq", "a")


@query("sto4_attempts", f"WITH {CHANGES} SELECT key, seq, row_number() OVER (PARTITION BY key, status ORDER BY seq) AS attempt, seq - lag(seq) OVER (PARTITION BY key ORDER BY seq) AS gap FROM ch")
def attempts(spark, d):
    """STO-4, WIN-14, WIN-15: attempts numbered by stage, and the distance to the row before."""
    c = changes(spark, d)
    return c.select("key", "seq", F.row_number().over(Window.partitionBy("key", "status").orderBy("seq")).cast("bigint").alias("attempt"), (F.col("seq") - F.lag("seq").over(Window.partitionBy("key").orderBy("seq"))).alias("gap"))


@query("sto5_open_counts", f"WITH {CHANGES} SELECT seq, count(*) FILTER (status = 'open') OVER w AS opened, count(*) FILTER (status = 'running') OVER w AS running FROM ch WINDOW w AS (PARTITION BY key ORDER BY seq)")
def open_counts(spark, d):
    """STO-5: conditional counts so far, beside each row."""
    w = Window.partitionBy("key").orderBy("seq")
    return changes(spark, d).select("seq", F.count(F.when(F.col("status") == "open", 1)).over(w).alias("opened"), F.count(F.when(F.col("status") == "running", 1)).over(w).alias("running"))


@query(
    "sto7_refit_lifecycle",
    f"""WITH {CHANGES}, o AS (SELECT key, seq, status, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS request FROM ch)
    SELECT key, request, CASE WHEN request < max(request) OVER (PARTITION BY key) AND final IN ('open', 'running') THEN 'superseded' ELSE final END AS status, claims AS attempts
    FROM (SELECT key, request, arg_max(status, seq) AS final, count(*) FILTER (status = 'running') AS claims FROM o WHERE request > 0 GROUP BY ALL)""",
)
def refit_lifecycle(spark, d):
    """STO-7 to STO-9, STM-13, WIN-22: requests folded from their log; an older one left open is superseded."""
    return store.lifecycle(changes(spark, d))


@query("sto10_already_seen", f"WITH {CHANGES} SELECT seq, key, a, row_number() OVER (PARTITION BY key, a ORDER BY seq) > 1 AS already_seen FROM ch")
def already_seen(spark, d):
    """STO-10: rows of a snapshot that an earlier one had."""
    w = Window.partitionBy("key", "a").orderBy("seq")
    return changes(spark, d).select("seq", "key", "a", (F.row_number().over(w) > 1).alias("already_seen"))


@query("sto12_row_counts", f"WITH {CHANGES} SELECT status AS name, count(*) AS n FROM ch GROUP BY status")
def row_counts(spark, d):
    """STO-11, STO-12: rows of each table."""
    return changes(spark, d).groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))


@query(
    "stm8_cache_changes",
    f"""WITH {CHANGES}, a AS (SELECT key, md5(string_agg(CAST(a AS VARCHAR), ',' ORDER BY seq)) AS s FROM ch WHERE seq % 2 = 0 AND key % 9 <> 1 GROUP BY key),
    b AS (SELECT key, md5(string_agg(CAST(a AS VARCHAR), ',' ORDER BY seq)) AS s FROM ch WHERE (seq % 2 = 0 OR key % 4 = 0) AND key % 9 <> 2 GROUP BY key)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'insert' WHEN b.key IS NULL THEN 'inactive' ELSE 'update' END AS change
    FROM a FULL JOIN b ON a.key = b.key WHERE a.s IS DISTINCT FROM b.s""",
)
def cache_changes(spark, d):
    """STM-8, STM-7, SET-8, JOIN-9: old and new signatures compared: inserts, updates, and rows gone."""
    c = changes(spark, d)
    a = store.signatures(c.where("seq % 2 = 0 and key % 9 <> 1"), "key", "seq", "a")
    b = store.signatures(c.where("(seq % 2 = 0 or key % 4 = 0) and key % 9 <> 2"), "key", "seq", "a")
    return store.changed(a, b, "key")
