"""Queries: positives, windows, splits, centroids, assignment and recommendation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions.numbers import even
from ..operators import interests as it
from ..operators import sequences as sq
from ..registry import MOVIES, RATINGS, ZSCORED, query
from ..sources import adapters as ad
from .clean import PARSED
from .stats import e6

Z = f"WITH {ZSCORED}"
POLICY = RATINGS + """,
few AS (SELECT * REPLACE (CASE WHEN user_id % 10 = 3 THEN -(user_id * 1000 + dayofyear(ts)) ELSE user_id END AS user_id) FROM ratings),
half AS (SELECT * REPLACE (CASE WHEN user_id % 10 = 5 THEN 40.0 ELSE rating END AS rating) FROM few),
m AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n FROM half GROUP BY user_id),
z AS (SELECT h.*, mean, std, n, (rating - mean) / (std + 1e-8) AS z FROM half h JOIN m USING (user_id))"""


def policy_rows(spark, d):
    """All ratings, with users of few ratings (a user's days as users of their own) and users without spread."""
    by_day = F.when(F.col("user_id") % 10 == 3, -(F.col("user_id") * 1000 + F.dayofyear("ts"))).otherwise(F.col("user_id"))
    r = ad.ratings(spark, d).withColumn("user_id", by_day)
    return sq.zscored(r.withColumn("rating", F.when(F.col("user_id") % 10 == 5, 40.0).otherwise(F.col("rating"))))


@query("win1_zscore_positive", f"{Z} SELECT event_id, user_id, {e6('z')} AS z FROM positives")
def zscore_positive(spark, d):
    """WIN-1, MTH-1: ratings above their user's mean."""
    return sq.positives(ad.ratings(spark, d)).select("event_id", "user_id", even(F.col("z")).alias("z"))


@query("win2_online_policy", f"WITH {POLICY} SELECT event_id, CASE WHEN n < 3 THEN 'cold_start' WHEN std <= 1e-8 THEN 'zero_std' WHEN z > 0 THEN 'zscore' END AS reason, CASE WHEN n >= 3 AND std > 1e-8 THEN {e6('z')} END AS shown_z FROM z")
def online_policy(spark, d):
    """WIN-2: the online rule: few ratings or no spread make all of a user's ratings positive."""
    return sq.positive_online(policy_rows(spark, d)).select("event_id", "reason", even(F.col("shown_z")).alias("shown_z"))


@query("rec3_seen_sets", f"WITH {POLICY} SELECT DISTINCT user_id, movie_id FROM z WHERE std > 1e-8 AND z > 0")
def seen_sets(spark, d):
    """REC-3: what counts as seen under the batch rule."""
    return sq.seen_batch(policy_rows(spark, d))


@query("win3_event_index", f"{Z} SELECT event_id, user_id, event_idx, known FROM positives")
def event_index(spark, d):
    """WIN-3, JOIN-7: positives numbered by user, unknown items included."""
    p = sq.positives(ad.ratings(spark, d))
    vocab = sq.vocabulary(ad.ratings(spark, d).where(ad.known()))
    out = p.join(vocab, "movie_id", "left")
    return out.select("event_id", "user_id", "event_idx", F.col("item_idx").isNotNull().alias("known"))


CONTEXT = ZSCORED + """,
ctx AS (
  SELECT user_id, event_id, event_idx, list(movie_id) OVER w AS items, first_value(event_idx) OVER w AS context_start_idx, count(*) OVER w AS history_len
  FROM positives WHERE known
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, movie_id, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query("win4_context_window", f"WITH {CONTEXT} SELECT user_id, event_id, event_idx, array_to_string(items, ',') AS items, context_start_idx, history_len FROM ctx")
def context_window(spark, d):
    """WIN-4, VAL-11: the last ten known items of each positive."""
    c = sq.context_windows(sq.positives(ad.ratings(spark, d)), ad.known(), 10)
    return c.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(
    "win5_sample_windows",
    f"""{Z}, s AS (SELECT user_id, list(movie_id ORDER BY ts_s, movie_id, event_id) AS items, count(*) AS n FROM positives GROUP BY user_id),
    w AS (SELECT user_id, items, unnest(CASE WHEN n <= 11 THEN [0] ELSE range(0, n - 10, 5) END) AS start FROM s WHERE n >= 3)
    SELECT user_id, CAST(start AS BIGINT) AS start, array_to_string(items[start + 1 : start + 11], ',') AS items FROM w""",
)
def sample_windows(spark, d):
    """WIN-5: training windows of eleven items, five apart."""
    w = sq.sample_windows(sq.positives(ad.ratings(spark, d)), 10, 5)
    return w.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(
    "win6_shifted",
    f"""{Z}, q AS (SELECT user_id, list(movie_id ORDER BY ts_s, movie_id, event_id) AS items, count(*) AS n FROM positives GROUP BY user_id),
    w AS (SELECT user_id, items, unnest(CASE WHEN n <= 11 THEN [0] ELSE range(0, n - 10, 5) END) AS start FROM q WHERE n >= 3),
    s AS (SELECT user_id, CAST(start AS BIGINT) AS start, items[start + 1 : start + 11] AS items FROM w)
    SELECT user_id, start, array_to_string(list_concat([0 for x in range(12 - (len(items) - 1))], items[1 : len(items) - 1]), ',') AS input,
           array_to_string(list_concat([0 for x in range(12 - (len(items) - 1))], items[2 : len(items)]), ',') AS label FROM s""",
)
def shifted(spark, d):
    """WIN-6, ARR-5: inputs and labels one item apart, padded on the left."""
    s = sq.sample_windows(sq.positives(ad.ratings(spark, d)), 10, 5)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return sq.shifted(s, 12).select("user_id", "start", text("input"), text("label"))


@query(
    "flt7_eligible",
    f"WITH {RATINGS}, r AS (SELECT * FROM ratings WHERE ts_s < 1706600000), m AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n, (max(ts_s) - min(ts_s)) / 86400.0 AS days FROM r GROUP BY user_id) SELECT user_id, n, count(*) FILTER ((rating - mean) / (std + 1e-8) > 0) AS positives, {e6('days')} AS span_days FROM r JOIN m USING (user_id) GROUP BY user_id, n, days HAVING days >= 25 AND count(*) FILTER ((rating - mean) / (std + 1e-8) > 0) >= 30",
)
def eligible(spark, d):
    """FLT-4, FLT-7, MDL-1: users active and rated enough before an exclusive cutoff."""
    return sq.eligible(ad.ratings(spark, d), 1706600000, 25, 30).withColumn("span_days", even(F.col("span_days")))


@query(
    "mdl2_canonical_counters",
    f"{Z}, u AS (SELECT user_id, count(*) AS positives, count(*) FILTER (known) AS known FROM positives GROUP BY user_id) SELECT (SELECT count(*) FROM ratings) AS ratings, (SELECT count(DISTINCT user_id) FROM ratings) AS users, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(known) AS BIGINT) AS known_positives, count(*) FILTER (positives >= 30) AS kept_users, CAST(sum(known) FILTER (positives >= 30) AS BIGINT) AS kept_events FROM u",
)
def canonical_counters(spark, d):
    """MDL-2: the counters of a canonical load, one aggregate each over ratings and users."""
    r = ad.ratings(spark, d)
    u = sq.zscored(r).where("z > 0").groupBy("user_id").agg(F.count("*").alias("p"), F.count_if(ad.known()).alias("k"))
    kept = F.col("p") >= 30
    out = u.agg(F.sum("p").alias("positives"), F.sum("k").alias("known_positives"), F.count_if(kept).alias("kept_users"), F.sum(F.when(kept, F.col("k"))).alias("kept_events"))
    return r.agg(F.count("*").alias("ratings"), F.countDistinct("user_id").alias("users")).crossJoin(out)  # two single rows


@query("win18_every_nth", f"WITH {RATINGS} SELECT event_id, row_number() OVER w AS ordinal, row_number() OVER w % 7 = 0 AS due FROM ratings WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, movie_id, event_id)")
def every_nth(spark, d):
    """WIN-15, WIN-18, STM-5: a counter by user and a trigger at every seventh event."""
    return sq.every_nth(ad.ratings(spark, d), 7, sq.BY_EVENT).select("event_id", "ordinal", "due")


SPLIT = RATINGS + """,
split AS (
  SELECT *, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY ts_s, event_id) - 1 AS p, count(*) OVER () AS n FROM ratings))"""


@query("win19_temporal_split", f"WITH {SPLIT} SELECT event_id, split FROM split")
def temporal_split(spark, d):
    """WIN-19: 80/10/10 by place in time over the whole table."""
    return sq.temporal_split(ad.ratings(spark, d)).select("event_id", "split")


@query(
    "win20_split_pairs",
    f"WITH {SPLIT} SELECT DISTINCT user_id, movie_id, s.split FROM split p JOIN (VALUES ('train','train'),('train','val'),('train','test'),('val','val'),('val','test'),('test','test')) s(own, split) ON p.split = s.own",
)
def split_pairs(spark, d):
    """WIN-20: a repeated pair stands in each split that it touches; later splits hold the earlier."""
    return sq.split_pairs(sq.temporal_split(ad.ratings(spark, d)))


# Members: known positives with the vector and the label of their item.
MEMBERS = ZSCORED + """,
items AS (SELECT vec_id AS movie_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
members AS (SELECT p.user_id, p.event_id, p.event_idx, p.movie_id, i.label, i.vec FROM positives p JOIN items i USING (movie_id) WHERE p.known)"""
CENTROIDS = MEMBERS + """,
x AS (SELECT user_id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM members),
big AS (SELECT user_id, label, count(*) AS size FROM members GROUP BY ALL HAVING count(*) >= 3),
cells AS (SELECT user_id, label, pos, avg(x) AS x FROM x JOIN big USING (user_id, label) GROUP BY ALL)"""


def members(spark, d):
    p = sq.positives(ad.ratings(spark, d)).where(ad.known())
    return p.join(ad.items(spark, d), "movie_id").select("user_id", "event_id", "event_idx", "movie_id", "label", "vec")


@query("agg27_centroids", f"WITH {CENTROIDS} SELECT user_id, label, size, pos, {e6('x')} AS x FROM cells JOIN big USING (user_id, label)")
def centroids(spark, d):
    """AGG-27, CLU-7: means of the vectors of a user's clusters with three members."""
    c = it.centroids(members(spark, d), "user_id", "label", least=3)
    return c.select("user_id", "label", "size", F.posexplode("vec").alias("pos", "x")).withColumns({"x": even(F.col("x")), "pos": F.col("pos").cast("bigint")})


@query(
    "agg28_top_genres",
    f"""WITH {ZSCORED}, {MOVIES}, g AS (SELECT movie_id, string_split(genres_text, '|') AS genres FROM movies),
    x AS (SELECT p.user_id, p.movie_id % 4 AS label, p.event_idx, unnest(genres) AS genre, generate_subscripts(genres, 1) AS at_ FROM positives p JOIN g USING (movie_id)),
    h AS (SELECT user_id, label, genre, count(*) AS hits, min(event_idx * 100 + at_) AS first FROM x GROUP BY ALL)
    SELECT user_id, label, genre, hits, row_number() OVER (PARTITION BY user_id, label ORDER BY hits DESC, first) AS place FROM h
    QUALIFY row_number() OVER (PARTITION BY user_id, label ORDER BY hits DESC, first) <= 5""",
)
def top_genres(spark, d):
    """AGG-28: a cluster's five most frequent genres; ties keep the first seen."""
    from ..functions.text import genres

    p = sq.positives(ad.ratings(spark, d)).withColumn("label", F.col("movie_id") % 4)
    g = ad.movies(spark, d).select("movie_id", genres(F.col("genres_text")).alias("genres"))
    return it.top_genres(p.select("user_id", "label", "movie_id", "event_idx"), g)


@query("agg30_cluster_counts", f"WITH {MEMBERS}, k AS (SELECT user_id, count(DISTINCT label) AS k, count(*) AS n FROM members GROUP BY user_id) SELECT min(k) AS least, max(k) AS most, {e6('avg(k)')} AS mean, {e6('quantile_cont(k, 0.5)')} AS median, count(*) FILTER (n < 20) AS skipped FROM k")
def cluster_counts(spark, d):
    """AGG-30, CLU-5: clusters by user; users with too few rows are counted as skipped."""
    k = members(spark, d).groupBy("user_id").agg(F.countDistinct("label").alias("k"), F.count("*").alias("n"))
    return k.agg(F.min("k").alias("least"), F.max("k").alias("most"), even(F.avg("k")).alias("mean"), even(F.percentile("k", 0.5)).alias("median"), F.count_if(F.col("n") < 20).alias("skipped"))


COSINES = CENTROIDS + """,
cn AS (SELECT user_id, label, sqrt(sum(x * x)) AS norm FROM cells GROUP BY ALL),
mx AS (SELECT user_id, event_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS pos, sqrt(list_dot_product(vec, vec)) AS norm FROM members),
sims AS (SELECT m.user_id, m.event_id, c.label, sum(m.v * c.x) / greatest(any_value(m.norm) * any_value(cn.norm), 1e-8) AS s
         FROM mx m JOIN cells c ON c.user_id = m.user_id AND c.pos = m.pos JOIN cn ON cn.user_id = c.user_id AND cn.label = c.label GROUP BY ALL)"""


@query(
    "join17_assign",
    f"WITH {COSINES}, b AS (SELECT user_id, event_id, max(s) AS s, arg_max(label, s) AS label FROM sims GROUP BY ALL) SELECT m.user_id, m.event_id, CASE WHEN b.s IS NULL THEN 'pending_no_interest' WHEN b.s < 0.6 THEN 'outlier' ELSE 'assigned' END AS status, b.label AS interest, {e6('b.s')} AS similarity FROM members m LEFT JOIN b ON m.user_id = b.user_id AND m.event_id = b.event_id",
)
def assign(spark, d):
    """JOIN-17, MTH-5, STM-9 (batch form): each row and its nearest interest by cosine."""
    m = members(spark, d)
    a = it.assigned(m, it.centroids(m, "user_id", "label", least=3), 0.6)
    return a.withColumn("similarity", even(F.col("similarity")))


SCORES = CENTROIDS + """,
v AS (SELECT vec_id AS movie_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
dots AS (SELECT user_id, label, movie_id, sum(x * v) AS s FROM cells JOIN v USING (pos) GROUP BY ALL),
scores AS (SELECT user_id, movie_id, max(s) AS score, arg_max(label, s) AS label FROM dots GROUP BY ALL),
ranked AS (
  SELECT user_id, movie_id, score, label, row_number() OVER (PARTITION BY user_id ORDER BY round_even(score * 1e9, 0) DESC, movie_id) AS rank
  FROM scores s WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = s.user_id AND p.movie_id = s.movie_id))"""


def recommendations(spark, d, k=5, seen=True, prune=False):
    """The k best items of each user; scores are compared to nine digits, so that ties do not hang on the order of a sum."""
    p, items = sq.positives(ad.ratings(spark, d)), ad.items(spark, d)
    told = it.best_of_members(p.where("movie_id is not null").select("user_id", "movie_id"), items, k, 3, ad.known(), seen, prune)
    if told is not None:
        return told
    dim = items.agg(F.max(F.size("vec"))).first()[0]
    c = it.centroids(members(spark, d), "user_id", "label", least=3, dim=dim)
    return it.best_items(it.user_queries(c, p.select("user_id", "movie_id").where(F.lit(seen))), items, k, "user_id", prune=prune)


@query("top_max_interest", f"WITH {SCORES} SELECT user_id, movie_id, {e6('round_even(score * 1e9, 0) / 1e9')} AS score, rank FROM ranked WHERE rank <= 5")
def top_max_interest(spark, d):
    """REC-1: the best unseen items by a user's best interest."""
    return recommendations(spark, d).select("user_id", "movie_id", even(F.col("score")).alias("score"), "rank")


@query("rec5_enriched", f"WITH {SCORES}, {PARSED} SELECT r.user_id, r.rank, r.movie_id, coalesce(p.title, '') AS title, p.year, coalesce(array_to_string(p.genres, '|'), '') AS genres FROM ranked r LEFT JOIN (SELECT * FROM parsed WHERE movie_id % 3 <> 0) p ON p.movie_id = r.movie_id WHERE rank <= 5")
def enriched(spark, d):
    """REC-2, REC-5, JOIN-8: recommendations with title, year and genres; blank where unknown."""
    from ..operators.cleaning import parsed

    m = parsed(ad.movies(spark, d)).where("movie_id % 3 <> 0")
    out = recommendations(spark, d).join(m, "movie_id", "left")
    return out.select("user_id", "rank", "movie_id", F.coalesce("title", F.lit("")).alias("title"), "year", F.coalesce(F.array_join("genres", "|"), F.lit("")).alias("genres"))


@query("rec4_skip_reasons", f"WITH {CENTROIDS}, u AS (SELECT DISTINCT user_id FROM ratings UNION SELECT -1), n AS (SELECT user_id, count(*) AS n, count(*) FILTER (label <> 2) AS sound FROM big GROUP BY user_id) SELECT u.user_id, CASE WHEN n.n IS NULL THEN 'no_interest_state' WHEN sound = 0 THEN 'all_interest_vectors_non_finite' END AS reason FROM u LEFT JOIN n ON u.user_id = n.user_id")
def skip_reasons(spark, d):
    """REC-4: why a user gets no recommendation; the vectors of one label are broken first."""
    c = it.centroids(members(spark, d), "user_id", "label", least=3)
    vec = F.when(F.col("label") == 2, F.transform("vec", lambda x: F.lit(float("nan")))).otherwise(F.col("vec"))
    n = c.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(num.finite(vec)).alias("sound"))
    users = ad.ratings(spark, d).select("user_id").distinct().union(spark.range(-1, 0).toDF("user_id"))
    return users.join(n, "user_id", "left").select("user_id", it.skip_reason(F.col("n"), F.col("sound")).alias("reason"))


@query(
    "agg38_ranking_quality",
    f"WITH {SCORES}, r AS (SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY round_even(score * 1e9, 0) DESC, movie_id) AS rank FROM scores), t AS (SELECT user_id, arg_max(movie_id, event_idx) AS movie_id FROM positives GROUP BY user_id) SELECT count(*) AS users, {e6('avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)')} AS recall, {e6('avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END)')} AS ndcg FROM t LEFT JOIN r USING (user_id, movie_id)",
)
def ranking_quality(spark, d):
    """AGG-38: recall and NDCG at 10 with the last positive as the relevant item."""
    last = sq.positives(ad.ratings(spark, d)).groupBy("user_id").agg(F.max_by("movie_id", "event_idx").alias("movie_id"))
    q = it.ranking_quality(recommendations(spark, d, 10, seen=False), last, 10)
    return q.select("users", even(F.col("recall")).alias("recall"), even(F.col("ndcg")).alias("ndcg"))


@query("mth2_unit_vectors", f"SELECT vec_id, {e6('sqrt(list_dot_product(v, v))')} AS norm, {e6('v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12)')} AS first FROM (SELECT vec_id, [x * (vec_id % 5) for x in embedding::DOUBLE[]] AS v FROM embeddings)")
def unit_vectors(spark, d):
    """MTH-2, MTH-7: unit vectors with a floor of the norm."""
    v = ad.items(spark, d).select(F.col("movie_id").alias("vec_id"), F.transform("vec", lambda x: x * (F.col("movie_id") % 5)).alias("v"))
    return v.select("vec_id", even(num.norm(F.col("v"))).alias("norm"), even(num.unit(F.col("v"))[0]).alias("first"))


@query("join20_close_vectors", "SELECT a.vec_id, list_max(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2]))) <= 0.35 AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def close_vectors(spark, d):
    """JOIN-20: two stores of vectors, here each vector and the next, compared by component within a tolerance."""
    a = ad.items(spark, d)
    b = a.select((F.col("movie_id") - 1).alias("movie_id"), F.col("vec").alias("other"))
    return a.join(b, "movie_id").select(F.col("movie_id").alias("vec_id"), num.vectors_close(F.col("vec"), F.col("other"), 0.35).alias("same"))


@query("arr7_first_dims", "SELECT vec_id, array_to_string([CAST(round_even(x * 1e6, 0) AS BIGINT) for x in (embedding::DOUBLE[])[1:3]], ',') AS head FROM embeddings")
def first_dims(spark, d):
    """ARR-7: the first three components as a stand-in for a projection."""
    head = F.transform(F.slice("vec", 1, 3), lambda x: F.rint(x * 1e6).cast("bigint").cast("string"))
    return ad.items(spark, d).select(F.col("movie_id").alias("vec_id"), F.array_join(head, ",").alias("head"))


@query(
    "win13_pending",
    f"WITH {CONTEXT} SELECT user_id, event_id, row_number() OVER w AS pending, CASE WHEN row_number() OVER w >= 5 THEN 'pending_refit_required' ELSE 'pending_no_interest' END AS status FROM ctx WINDOW w AS (PARTITION BY user_id ORDER BY event_idx)",
)
def pending(spark, d):
    """WIN-13: without interests, rows wait, and the fifth asks for a refit."""
    c = sq.context_windows(sq.positives(ad.ratings(spark, d)), ad.known(), 10)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_idx"))
    return c.select("user_id", "event_id", n.cast("bigint").alias("pending"), F.when(n >= 5, "pending_refit_required").otherwise("pending_no_interest").alias("status"))
