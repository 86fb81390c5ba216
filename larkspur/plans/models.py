"""Queries of single operators of models, clustering, recommendation, histories and state tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import even
from ..operators import clustering as cg
from ..operators import encoding as en
from ..operators import history as hs
from ..operators import interests as it
from ..operators import sequences as sq
from ..registry import RATINGS, ZSCORED, query
from ..sources import adapters as ad
from ..streaming import store
from .clean import PARSED
from .history import FRAMES, HISTORY, frames_of, history, timeline_of
from .interests import CENTROIDS, CONTEXT, MEMBERS, SCORES, members, recommendations
from .rows import VOCABULARY
from .stats import e6
from .stream import CHANGES, changes

Z, M = f"WITH {ZSCORED}", f"WITH {MEMBERS}"


# Models.


@query("mdl1_sequences", f"{Z}, u AS (SELECT user_id, (max(ts_s) - min(ts_s)) / 86400.0 AS days FROM ratings GROUP BY user_id), p AS (SELECT user_id, count(*) AS n, array_to_string(list(movie_id ORDER BY ts_s, movie_id, event_id), ',') AS items FROM positives GROUP BY user_id) SELECT user_id, n, items FROM p JOIN u USING (user_id) WHERE days >= 25 AND n >= 20")
def user_sequences(spark, d):
    """MDL-1: the positive items of the eligible users, in order."""
    r = ad.ratings(spark, d)
    seq = sq.sequences(sq.positives(r)).join(sq.eligible(r, None, 25, 20).select("user_id"), "user_id", "left_semi")
    return seq.select("user_id", F.size("items").cast("bigint").alias("n"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


ENCODED = CONTEXT + """,
own AS (SELECT user_id, event_id, unnest(items) AS movie_id, generate_subscripts(items, 1) AS k, history_len FROM ctx),
cells AS (
  SELECT user_id, event_id, p, sum(x * pow({decay}, history_len - k)) / sum(pow({decay}, history_len - k)) AS x
  FROM own JOIN (SELECT vec_id AS movie_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) v USING (movie_id) GROUP BY ALL)"""


def placed_sum(vec):
    """The sum of a vector's components, each times its place from 1."""
    return F.aggregate(F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def embedded(spark, d, encode):
    """Contexts encoded: every component of each, with its place from 0."""
    contexts = sq.context_windows(sq.positives(ad.ratings(spark, d)), ad.known(), 10)
    v = en.encoded(contexts, ad.items(spark, d), encode)
    cells = v.select("user_id", "event_id", F.posexplode("vec").alias("p", "x"))
    return cells.select("user_id", "event_id", F.col("p").cast("bigint").alias("p"), even(F.col("x")).alias("x"))


@query("mdl6_canonical", f"WITH {ENCODED.replace('{decay}', '0.8')} SELECT user_id, event_id, p, {e6('x')} AS x FROM cells")
def canonical(spark, d):
    """MDL-6: an embedding for each known positive, from its context of at most ten items."""
    return embedded(spark, d, en.recency_mean)


def plain_mean(items: np.ndarray) -> np.ndarray:
    return items.mean(axis=0)


@query("mdl3_encoder", f"WITH {ENCODED.replace('{decay}', '1.0')} SELECT user_id, event_id, p, {e6('x')} AS x FROM cells")
def other_encoder(spark, d):
    """MDL-3: another encoder in the place of the default: any function of a context's item vectors."""
    return embedded(spark, d, plain_mean)


# Clustering. The labels of the density clustering are no matter of SQL; what they must meet is.


@query("clu1_sound", f"{M} SELECT user_id, count(*) AS n, true AS sound FROM members GROUP BY user_id HAVING count(*) >= 6")
def sound_clusters(spark, d):
    """CLU-1: every row has a label; labels run from 0 without gaps, and every cluster has three rows."""
    c = cg.cluster_users(members(spark, d), least=3, skip_under=6)
    sizes = c.groupBy("user_id", "label").agg(F.count("*").alias("n"))
    own = sizes.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("label").alias("top"), F.count_if(F.col("label") >= 0).alias("k"), F.min(F.when(F.col("label") >= 0, F.col("n"))).alias("least"))
    return own.select("user_id", "n", ((F.col("top") + 1 == F.col("k")) & (F.coalesce("least", F.lit(3)) >= 3)).alias("sound"))


@query("clu2_few_rows", f"{M}, s AS (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM members) SELECT event_id, CASE WHEN n <= 30 THEN -1 END AS label FROM s")
def few_rows(spark, d):
    """CLU-2: users with no more rows than a cluster needs are all noise; the others are clustered, with labels of their own."""
    c = cg.cluster_users(members(spark, d), least=30).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return c.select("event_id", F.when(F.col("n") <= 30, F.col("label")).alias("label"))


REDUCERS = MEMBERS + """,
means AS (SELECT user_id, list(x ORDER BY p) AS mean FROM (SELECT user_id, p, avg(x) AS x FROM (SELECT user_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM members) GROUP BY ALL) GROUP BY user_id),
axes AS (SELECT vec_id AS place, embedding::DOUBLE[] AS axis FROM embeddings WHERE vec_id < 3),
drawn AS (SELECT m.event_id, a.place, list_dot_product(list_transform(list_zip(m.vec, mean), lambda z: z[1] - z[2]), axis) AS x FROM members m JOIN means USING (user_id), axes a)"""


@query("clu4_projected", f"WITH {REDUCERS} SELECT event_id, place, {e6('x')} AS x FROM drawn")
def projected(spark, d):
    """CLU-4: vectors projected with a reducer that was fitted before: off its mean, along its axes."""
    m = members(spark, d)
    mean = it.gathered(it.spread(m, "vec", "user_id").groupBy("user_id", "pos").agg(F.avg("x").alias("x")), "user_id").withColumnRenamed("vec", "mean")
    axes = ad.items(spark, d).where("movie_id < 3").agg(F.transform(F.array_sort(F.collect_list(F.struct("movie_id", "vec"))), lambda a: a["vec"]).alias("axes"))
    reducers = mean.crossJoin(F.broadcast(axes))  # one row of three axes
    out = it.projected(m, reducers)
    return out.select("event_id", F.posexplode("point").alias("place", "x")).select("event_id", F.col("place").cast("bigint").alias("place"), even(F.col("x")).alias("x"))


@query("clu5_strided", f"{M}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_idx, event_id) - 1 AS r FROM members) SELECT event_id FROM s WHERE r % 3 = 0 QUALIFY count(*) OVER (PARTITION BY user_id) >= 10")
def strided(spark, d):
    """CLU-5: each user's rows in order of time, every third if asked for; users with too few are skipped."""
    return cg.cluster_users(members(spark, d), least=3, skip_under=10, stride=3).select("event_id")


@query("clu6_drawn", f"{M} SELECT user_id, count(*) AS n, true AS centred, true AS ordered FROM members GROUP BY user_id")
def drawn(spark, d):
    """CLU-6: the 3-d projection: centred, its directions in order of their spread, whatever the clusters."""
    c = cg.cluster_users(members(spark, d), least=3)
    a = c.groupBy("user_id").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{x}") for x in "xyz"), *(F.var_pop(x).alias(f"v{x}") for x in "xyz"))
    centred = F.greatest(*(F.abs(f"m{x}") for x in "xyz")) < 1e-9
    return a.select("user_id", "n", centred.alias("centred"), ((F.col("vx") >= F.col("vy") - 1e-12) & (F.col("vy") >= F.col("vz") - 1e-12)).alias("ordered"))


@query("clu7_interests", f"WITH {CENTROIDS} SELECT user_id, label, size, 'batch' AS source, (SELECT count(*) FROM cells c WHERE c.user_id = b.user_id AND c.label = b.label) AS dim FROM big b")
def interest_states(spark, d):
    """CLU-7: interest vectors with their size and where they come from."""
    c = it.centroids(members(spark, d), "user_id", "label", least=3)
    return c.select("user_id", "label", "size", F.lit("batch").alias("source"), F.size("vec").cast("bigint").alias("dim"))


NOISY = MEMBERS + """,
lab AS (SELECT *, CASE WHEN user_id % 3 = 0 OR label > 6 THEN -1 ELSE label END AS l FROM members),
top AS (SELECT user_id, max(l) AS t FROM lab GROUP BY user_id),
fit AS (SELECT user_id, CASE WHEN t < 0 THEN 0 ELSE l END AS label, vec FROM lab JOIN top USING (user_id) WHERE l >= 0 OR t < 0)"""


@query("clu8_refit", f"WITH {NOISY} SELECT user_id, CAST(label AS BIGINT) AS label, max(n) AS size, {e6('sum(p * x)')} AS whole FROM (SELECT user_id, label, p, count(*) AS n, avg(x) AS x FROM (SELECT user_id, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM fit) GROUP BY ALL) GROUP BY user_id, label")
def refit(spark, d):
    """CLU-8: labels to interest vectors; where all are noise, the mean of all rows."""
    m = members(spark, d)
    noisy = m.withColumn("label", F.when((F.col("user_id") % 3 == 0) | (F.col("label") > 6), -1).otherwise(F.col("label")))
    return it.refitted(noisy, "user_id").select("user_id", "label", "size", even(placed_sum("vec")).alias("whole"))


@query("clu9_exported", f"{M} SELECT event_id, true AS labelled, event_idx AS timepoint, count(*) OVER (PARTITION BY user_id) AS sequence_length FROM members")
def exported(spark, d):
    """CLU-9: the label table with each row's time and its user's number of rows."""
    m = members(spark, d)
    c = cg.cluster_users(m, least=3).select("user_id", "event_id", "label").join(m.select("event_id", F.col("event_idx").alias("timepoint")), "event_id")
    return c.select("event_id", (F.col("label") >= -1).alias("labelled"), "timepoint", F.count("*").over(Window.partitionBy("user_id")).alias("sequence_length"))


@query("win7_windows", f"{M}, s AS (SELECT user_id, list(event_idx ORDER BY event_idx, event_id) AS at_, count(*) AS n FROM members GROUP BY user_id), w AS (SELECT *, unnest(range(0, greatest(1, n - 19), 5)) AS a FROM s) SELECT user_id, at_[least((a + least(a + 20, n)) // 2, n - 1) + 1] AS centre, true AS sound FROM w")
def sliding_windows(spark, d):
    """WIN-7: windows of 20 rows, five apart, and their centres; a window has no more clusters than its rows allow."""
    k = cg.sliding_counts(members(spark, d), width=20, step=5)
    return k.select("user_id", "centre", F.col("k").between(0, 6).alias("sound"))


# Recommendation.


@query("join16_best_items", f"WITH {SCORES}, r AS (SELECT user_id, movie_id, round_even(score * 1e9, 0) / 1e9 AS score FROM scores) SELECT user_id, movie_id, {e6('score')} AS score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, movie_id) <= 3")
def best_of_all(spark, d):
    """JOIN-16: every interest against every item, of which only the best few of a user leave a task."""
    return recommendations(spark, d, 3, seen=False).select("user_id", "movie_id", even(F.col("score")).alias("score"))


@query("rec1_pruned", f"WITH {SCORES} SELECT user_id, movie_id, {e6('round_even(score * 1e9, 0) / 1e9')} AS score, rank FROM ranked WHERE rank <= 7")
def pruned_search(spark, d):
    """REC-1, JOIN-16: the same by cells of items, of which only those are scored that can hold one of the best."""
    return recommendations(spark, d, 7, prune=True).select("user_id", "movie_id", even(F.col("score")).alias("score"), "rank")


@query("top1_items", f"WITH {SCORES} SELECT user_id, movie_id, rank FROM ranked WHERE rank <= 12")
def top_items(spark, d):
    """TOP-1: the best twelve of each user; ties go to the smaller id."""
    return recommendations(spark, d, 12).select("user_id", "movie_id", "rank")


@query("top2_best_interest", f"WITH {SCORES}, d AS (SELECT user_id, movie_id, label, round_even(s * 1e9, 0) AS s FROM dots), b AS (SELECT user_id, movie_id, arg_min(label, struct_pack(a := -s, b := label)) AS label FROM d GROUP BY ALL) SELECT r.user_id, r.movie_id, CAST(b.label AS BIGINT) AS label FROM ranked r JOIN b USING (user_id, movie_id) WHERE rank <= 5")
def best_interest(spark, d):
    """TOP-2: the interest that an item suits best; the first wins a tie."""
    return recommendations(spark, d, 5).select("user_id", "movie_id", "label")


@query("rec1_scored", f"WITH {SCORES}, d AS (SELECT user_id, movie_id, label, round_even(s * 1e9, 0) AS s FROM dots), b AS (SELECT user_id, movie_id, arg_min(label, struct_pack(a := -s, b := label)) AS label FROM d GROUP BY ALL) SELECT r.user_id, rank, r.movie_id, {e6('round_even(score * 1e9, 0) / 1e9')} AS score, CAST(b.label AS BIGINT) AS label FROM ranked r JOIN b USING (user_id, movie_id) WHERE rank <= 8")
def scored(spark, d):
    """REC-1: the largest product over a user's interests, seen items left out, the best eight with score and interest."""
    return recommendations(spark, d, 8).select("user_id", "rank", "movie_id", even(F.col("score")).alias("score"), "label")


@query("rec2_candidates", f"WITH {VOCABULARY} SELECT v.item_idx, v.movie_id FROM v JOIN embeddings e ON e.vec_id = v.movie_id WHERE item_idx > 0 AND item_idx < (SELECT count(*) FROM embeddings)")
def candidates(spark, d):
    """REC-2: vocabulary ids that have a row in the item matrix, padding left out, ascending."""
    v = sq.vocabulary(ad.ratings(spark, d).where(ad.known()))
    i = ad.items(spark, d).select("movie_id")
    n = i.agg(F.count("*").alias("rows"))
    return v.join(i, "movie_id").crossJoin(F.broadcast(n)).where("item_idx > 0 and item_idx < rows").select("item_idx", "movie_id").orderBy("item_idx")


# Histories.


@query("join11_shown", f"WITH {FRAMES} SELECT s.user_id, s.event_id, e.event_type, len(s.points) AS points FROM s JOIN events e ON e.user_id = s.user_id AND e.event_id = s.event_id WHERE e.event_id % 2 = 0")
def shown(spark, d):
    """JOIN-11: frames with their events, on two keys."""
    e = ad.load(spark, d, "events").where("event_id % 2 = 0").select("user_id", "event_id", "event_type")
    return frames_of(spark, d).join(e, ["user_id", "event_id"]).select("user_id", "event_id", "event_type", F.size("points").cast("bigint").alias("points"))


@query("join12_movies", f"WITH {PARSED}, {RATINGS} SELECT r.event_id, p.title, p.year FROM ratings r LEFT JOIN (SELECT * FROM parsed WHERE movie_id % 4 > 0) p ON p.movie_id = r.movie_id")
def with_movies(spark, d):
    """JOIN-12: rows with the movies of another store, null where it lacks them."""
    from ..operators.cleaning import parsed

    m = parsed(ad.movies(spark, d)).where("movie_id % 4 > 0").select("movie_id", "title", "year")
    return ad.ratings(spark, d).join(m, "movie_id", "left").select("event_id", "title", "year")


@query("win17_stored", f"WITH {FRAMES} SELECT event_id, len(stored) AS stored FROM s")
def stored(spark, d):
    """WIN-17: what a positional delta stores beside the frame before it."""
    return frames_of(spark, d).select("event_id", F.size("stored").cast("bigint").alias("stored"))


@query("win21_last_refit", "SELECT user_id, event_id, max(CASE WHEN event_id % 13 = 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS refit FROM events")
def last_refit(spark, d):
    """WIN-21: the last refit of a user at each event."""
    e = ad.load(spark, d, "events").select("user_id", "event_id")
    return hs.as_of(e, e.where("event_id % 13 = 0").withColumn("refit", F.col("event_id")), "user_id", "event_id", ["refit"])


@query("win24_alive", f"WITH {HISTORY}, l AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT st.user_id, raw_id, kind, label FROM st JOIN l ON l.user_id = st.user_id AND l.event_id = st.event_id WHERE kind <> 'removed'")
def alive(spark, d):
    """WIN-24: the points that are alive at each user's last event: its base, later draws, removals."""
    ev, members_, moves = history(spark, d)
    last = ev.groupBy("user_id").agg(F.max_by("epoch", "event_id").alias("epoch"))
    return hs.point_intervals(members_, moves).where("to_order is null").join(last, ["user_id", "epoch"]).select("user_id", "raw_id", "kind", "label")


@query("api7_frame", f"WITH {HISTORY}, {PARSED} SELECT t.event_id, k_count, noise, assigned, p.title FROM timeline t JOIN events e ON e.event_id = t.event_id LEFT JOIN parsed p ON p.movie_id = CAST(e.props->>'$.k' AS BIGINT) WHERE t.user_id = 5")
def combined_frame(spark, d):
    """API-7: a user's events with their counts and movies in one frame."""
    from ..operators.cleaning import parsed

    r = ad.ratings(spark, d).where("user_id = 5").select("event_id", "movie_id").join(parsed(ad.movies(spark, d)).select("movie_id", "title"), "movie_id", "left")
    return timeline_of(spark, d, user=5).join(r, "event_id").select("event_id", "k_count", "noise", "assigned", "title").orderBy("event_id")


# State tables.


@query("stm13_outcomes", f"WITH {CHANGES}, o AS (SELECT key, seq, status, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS request FROM ch), f AS (SELECT key, request, arg_max(status, seq) AS final FROM o WHERE request > 0 GROUP BY ALL), s AS (SELECT CASE WHEN request < max(request) OVER (PARTITION BY key) AND final IN ('open', 'running') THEN 'superseded' ELSE final END AS status FROM f) SELECT status, count(*) AS n FROM s GROUP BY status")
def outcomes(spark, d):
    """STM-13: refit requests by what became of them."""
    return store.lifecycle(changes(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("sto6_assignments", f"WITH {CHANGES} SELECT key, a, status, seq, b FROM ch QUALIFY row_number() OVER (PARTITION BY key, a, status ORDER BY seq DESC) = 1")
def assignments(spark, d):
    """STO-6: rows by a key of several columns; a repeat replaces the row before it, nulls included."""
    c = changes(spark, d)
    return store.upsert(c, ["key", "a", "status"], "seq", ["b"])


@query("sto8_claims", f"WITH {CHANGES}, o AS (SELECT key, seq, status, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS request FROM ch) SELECT key, max(request) AS request, count(*) FILTER (status = 'running' AND request = last) AS attempts FROM (SELECT *, max(request) OVER (PARTITION BY key) AS last FROM o) WHERE request > 0 GROUP BY key")
def claims(spark, d):
    """STO-8: the newest request of each key and how often it was claimed."""
    c = store.lifecycle(changes(spark, d))
    return c.groupBy("key").agg(F.max("request").alias("request"), F.max_by("attempts", "request").alias("attempts"))


@query("sto9_completed", f"WITH {CHANGES}, o AS (SELECT key, seq, status, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS request FROM ch), f AS (SELECT key, request, arg_max(status, seq) AS status, max(seq) AS seq FROM o WHERE request > 0 GROUP BY ALL) SELECT key, request, status, seq FROM f WHERE status IN ('closed', 'skipped', 'failed', 'superseded')")
def completed(spark, d):
    """STO-9: requests that ended, with how and when."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = changes(spark, d).withColumn("request", F.sum(F.when(F.col("status") == "open", 1).otherwise(0)).over(w)).where("request > 0")
    done = rows.groupBy("key", "request").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return done.where(F.col("status").isin("closed", "skipped", "failed", "superseded"))


@query("sto11_recommendation_rows", f"WITH {SCORES} SELECT user_id, count(*) AS rows, min(rank) AS first, max(rank) AS last FROM ranked WHERE rank <= 4 GROUP BY user_id")
def recommendation_rows(spark, d):
    """STO-11: a run for each user, and its rows."""
    return recommendations(spark, d, 4).groupBy("user_id").agg(F.count("*").alias("rows"), F.min("rank").alias("first"), F.max("rank").alias("last"))


@query("sto13_rebuilt_tables", f"WITH {CHANGES} SELECT key, arg_max(a, seq) AS a, max(seq) AS seq FROM ch WHERE seq % 2 = 0 GROUP BY key")
def rebuilt_tables(spark, d):
    """STO-13: a compact table that is emptied and rebuilt; batches that come twice change nothing."""
    c = changes(spark, d).select("key", "seq", "a")
    t = store.Table(spark, ["key"], "seq")
    t.merge(c.where("seq % 2 = 1"))
    t.clear()
    for k in (0, 2, 0):
        t.merge(c.where(f"seq % 4 = {k}"))
    return t.read()
