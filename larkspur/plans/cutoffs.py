"""Queries: the temporal-cutoff study, and summaries of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import even
from ..operators import cutoffs as ct
from ..operators import statistics as st
from ..registry import RATINGS, query
from ..sources import adapters as ad
from .clean import FLAGGED, PARSED
from .stats import e6

DAYS = RATINGS + """,
g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ratings GROUP BY 1),
run AS (SELECT day, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER () AS total FROM g),
q AS (SELECT min(day) FILTER (upto >= ceil(total * 0.5)) AS a, min(day) FILTER (upto >= ceil(total * 0.8)) AS b, max(day) AS last FROM run),
named AS (
  SELECT 1 AS i, a AS day, 'quantile_0.5' AS source FROM q UNION ALL SELECT 2, b, 'quantile_0.8' FROM q
  UNION ALL SELECT 3, '2024-01-15', 'calendar' UNION ALL SELECT 4, '2030-01-01', 'calendar'
  UNION ALL SELECT 5, strftime(CAST(last AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d'), 'recent_7' FROM q),
cand AS (SELECT day, arg_min(source, i) AS source FROM named, q WHERE day < q.last AND day >= (SELECT min(day) FROM g) GROUP BY day)"""


def days(r):
    return ct.candidates(r, [0.5, 0.8], ["2024-01-15", "2030-01-01"], [7])


@query("cut1_candidates", f"WITH {DAYS} SELECT day, source FROM cand")
def candidates(spark, d):
    """CUT-1: candidate days without repeats, those outside the data left out."""
    return spark.createDataFrame(days(ad.ratings(spark, d)), "day string, source string")


VOLUMES = DAYS + """,
uu AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM ratings GROUP BY user_id),
mm AS (SELECT movie_id, min(ts) AS lo, count(*) AS n FROM ratings GROUP BY movie_id),
e AS (SELECT day, source, CAST(day AS TIMESTAMP) + INTERVAL 86399 SECOND AS t FROM cand),
volumes AS (
  SELECT day, source, (SELECT count(*) FROM ratings WHERE ts <= t) AS before, (SELECT count(*) FROM ratings WHERE ts > t) AS after,
    (SELECT count(*) FROM uu WHERE lo <= t) AS users_before, (SELECT count(*) FROM uu WHERE hi > t) AS users_after,
    (SELECT count(*) FROM uu WHERE lo > t) AS new_users, (SELECT count(*) FROM mm WHERE lo > t) AS cold_movies,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM mm WHERE lo > t) AS cold_ratings FROM e)"""


@query("cut2_volumes", f"WITH {VOLUMES} SELECT * FROM volumes")
def volumes(spark, d):
    """CUT-2: what stands before and after each candidate."""
    r = ad.ratings(spark, d)
    return ct.volumes(r, days(r))


@query("cut3_roles", f"WITH {VOLUMES} SELECT day, {e6('before * 1.0 / (before + after)')} AS share_before, CASE WHEN row_number() OVER (ORDER BY abs(before * 1.0 / (before + after) - 0.8), day) = 1 THEN 'main' WHEN row_number() OVER (ORDER BY day DESC) = 1 THEN 'stress' ELSE 'spare' END AS role FROM volumes")
def roles(spark, d):
    """CUT-3: a role for each candidate."""
    r = ad.ratings(spark, d)
    return ct.roles(ct.volumes(r, days(r)))


PRE = RATINGS + """,
pre AS (SELECT * FROM ratings WHERE ts <= TIMESTAMP '2024-01-15 23:59:59'),
pm AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n FROM pre GROUP BY user_id),
pp AS (SELECT user_id, n, count(*) FILTER ((rating - mean) / (std + 1e-8) > 0) AS p FROM pre JOIN pm USING (user_id) GROUP BY ALL),
post AS (SELECT r.*, r.movie_id IN (SELECT movie_id FROM pre) AS known FROM ratings r WHERE ts > TIMESTAMP '2024-01-15 23:59:59')"""


@query("cut4_user_kinds", f"WITH {PRE}, a AS (SELECT user_id, count(*) AS a FROM post GROUP BY user_id) SELECT CASE WHEN a IS NULL THEN 'gone' WHEN n IS NULL THEN 'new' WHEN p >= 12 THEN 'ready' ELSE 'warm' END AS kind, count(*) AS users, CAST(coalesce(sum(a), 0) AS BIGINT) AS after FROM pp FULL JOIN a ON pp.user_id = a.user_id GROUP BY 1")
def user_kinds(spark, d):
    """CUT-4: users by what they bring to a cutoff."""
    return ct.user_kinds(ad.ratings(spark, d), "2024-01-15", 12)


@query(
    "cut5_recompute",
    f"""WITH {PRE}, wm AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std FROM ratings GROUP BY user_id),
    w AS (SELECT user_id, count(*) FILTER ((rating - mean) / (std + 1e-8) > 0) AS final FROM ratings JOIN wm USING (user_id) GROUP BY user_id),
    a AS (SELECT user_id, count(*) AS post, count(*) FILTER (known) AS known FROM post GROUP BY user_id)
    SELECT count(*) AS users, CAST(sum(post) AS BIGINT) AS post, CAST(sum(known) AS BIGINT) AS known, CAST(sum(post - known) AS BIGINT) AS unknown,
           {e6('sum(post * (p + final) / 2.0)')} AS recomputed, count(*) FILTER (post >= 20) AS refit_candidates
    FROM pp JOIN a USING (user_id) JOIN w USING (user_id) WHERE p >= 12""",
)
def recompute(spark, d):
    """CUT-5: known and unknown items after a cutoff, and the rows that a stream would embed again."""
    return ct.recompute_estimate(ad.ratings(spark, d), "2024-01-15", 12)


@query("cut6_distributions", f"WITH {PRE}, a AS (SELECT user_id, count(*) AS n FROM post GROUP BY user_id) SELECT {e6('quantile_cont(n, 0.5)')} AS p50, {e6('quantile_cont(n, 0.9)')} AS p90, {e6('quantile_cont(n, 0.95)')} AS p95, {e6('quantile_cont(n, 0.99)')} AS p99, max(n) AS max, {e6('avg(n)')} AS mean FROM a")
def distributions(spark, d):
    """CUT-6: how many ratings users have after a cutoff."""
    a = ad.ratings(spark, d).where(F.col("ts") > ct.day_end("2024-01-15")).groupBy("user_id").agg(F.count("*").alias("n"))
    return st.quantiles(a, "n", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).select("p50", "p90", "p95", "p99", "max", "mean")


@query("eda1_drop_comparison", f"WITH {FLAGGED} SELECT NOT (no_ratings OR no_genres OR no_year) AS kept, count(*) AS movies, CAST(sum(rating_count) AS BIGINT) AS ratings, {e6('avg(len(genres))')} AS mean_genres FROM flagged GROUP BY 1")
def drop_comparison(spark, d):
    """EDA-1: kept and dropped movies side by side."""
    from ..operators.cleaning import drop_flags
    from .clean import catalogue_of

    f = drop_flags(catalogue_of(spark, d))
    return f.groupBy((~F.col("dropped")).alias("kept")).agg(F.count("*").alias("movies"), F.sum("rating_count").alias("ratings"), even(F.avg(F.size("genres"))).alias("mean_genres"))


@query("eda3_raw_counts", f"WITH {PARSED}, {RATINGS} SELECT (SELECT count(*) FROM parsed) AS movies, (SELECT count(*) FROM parsed WHERE year IS NULL) AS no_year, (SELECT count(*) FROM ratings) AS ratings, (SELECT count(*) FROM lineitem) AS tags, (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) AS distinct_tags")
def raw_counts(spark, d):
    """EDA-3, EDA-4: counts of a raw source, one row from each table."""
    from ..operators.cleaning import parsed

    m = parsed(ad.movies(spark, d)).agg(F.count("*").alias("movies"), F.count_if(F.col("year").isNull()).alias("no_year"))
    t = ad.tags(spark, d).agg(F.count("*").alias("tags"), F.countDistinct("tag").alias("distinct_tags"))
    return m.crossJoin(ad.ratings(spark, d).agg(F.count("*").alias("ratings"))).crossJoin(t)  # single rows


@query("eda5_combined", f"WITH {RATINGS} SELECT 'events' AS source, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS items FROM ratings UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), count(DISTINCT l_partkey) FROM lineitem JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON l_orderkey = o_orderkey")
def combined(spark, d):
    """EDA-5, JOIN-1: two sources in one table of sizes."""
    r = ad.ratings(spark, d).select(F.lit("events").alias("source"), "user_id", "movie_id")
    o = ad.load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")).distinct()
    x = ad.load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("movie_id")).join(o, "l_orderkey").select(F.lit("orders").alias("source"), "user_id", "movie_id")
    return r.unionByName(x).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("items"))
