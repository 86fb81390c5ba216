"""Queries: aggregates, summaries, concentration, windows over time and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import even, share
from ..operators import statistics as st
from ..registry import MOVIES, RATINGS, STARS, query
from ..sources import adapters as ad
from .clean import FLAGGED, PARSED, catalogue_of

R = f"WITH {RATINGS}"
RS = f"WITH {RATINGS}, {STARS}"
COUNTS = RATINGS + ", c AS (SELECT movie_id, count(*) AS n FROM ratings GROUP BY movie_id), u AS (SELECT user_id, count(*) AS n, min(ts_s) AS first_s, max(ts_s) AS last_s, (max(ts_s) - min(ts_s)) / 86400.0 AS days FROM ratings GROUP BY user_id)"
E6 = "round_even(({}) * 1e6, 0) / 1e6"


def e6(x: str) -> str:
    return E6.format(x)


@query("agg11_profile", f"{RS} SELECT {e6('avg(rating)')} AS mean, {e6('quantile_cont(rating, 0.5)')} AS median, min(rating) AS least, max(rating) AS most, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies FROM stars")
def profile(spark, d):
    """AGG-11, EDA-2: mean, median, extremes and distinct counts in one pass."""
    r = ad.stars(spark, d)
    return r.agg(even(F.avg("rating")).alias("mean"), even(F.percentile("rating", 0.5)).alias("median"), F.min("rating").alias("least"), F.max("rating").alias("most"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("movies"))


@query("agg12_value_counts", f"{RS} SELECT rating, count(*) AS n FROM stars GROUP BY rating")
def value_counts(spark, d):
    """AGG-12: how often each rating is given."""
    return st.value_counts(ad.stars(spark, d), "rating").orderBy("rating")


@query("agg13_user_spans", f"WITH {COUNTS} SELECT user_id, n, first_s, last_s, {e6('days')} AS days FROM u")
def user_spans(spark, d):
    """AGG-13, DAT-5: ratings, first, last and days of each user."""
    return st.user_spans(ad.ratings(spark, d)).withColumn("days", even(F.col("days")))


@query("agg14_calendar", f"{R} SELECT 'month' AS unit, strftime(ts, '%Y-%m') AS slot, count(*) AS n FROM ratings GROUP BY ALL UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM ratings GROUP BY ALL UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%dT%H'), count(*) FROM ratings GROUP BY ALL")
def calendar(spark, d):
    """AGG-14: counts by month, day and hour, from one aggregation by hour."""
    return st.calendar_counts(ad.ratings(spark, d), {"month": 7, "day": 10, "hour": 13})


@query(
    "agg15_candidate_sums",
    f"WITH {RATINGS}, k(cutoff) AS (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22')) SELECT user_id, cutoff, count(*) FILTER (ts <= cutoff) AS before, count(*) FILTER (ts > cutoff) AS after FROM ratings, k GROUP BY ALL",
)
def candidate_sums(spark, d):
    """AGG-15, JOIN-18: ratings of each user before and after each candidate cutoff, in one pass."""
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    return st.by_candidate(ad.ratings(spark, d), cuts)


@query("agg16_summary", f"WITH {COUNTS} SELECT 'movies' AS of, min(n) AS min, {e6('quantile_cont(n, 0.25)')} AS p25, {e6('quantile_cont(n, 0.5)')} AS p50, {e6('quantile_cont(n, 0.75)')} AS p75, {e6('quantile_cont(n, 0.9)')} AS p90, {e6('quantile_cont(n, 0.99)')} AS p99, max(n) AS max, {e6('avg(n)')} AS mean FROM c UNION ALL SELECT 'users', min(n), {e6('quantile_cont(n, 0.25)')}, {e6('quantile_cont(n, 0.5)')}, {e6('quantile_cont(n, 0.75)')}, {e6('quantile_cont(n, 0.9)')}, {e6('quantile_cont(n, 0.99)')}, max(n), {e6('avg(n)')} FROM u")
def summary(spark, d):
    """AGG-16, MTH-6: eight numbers of the ratings of movies and users."""
    r = ad.ratings(spark, d)
    both = r.groupBy("movie_id").agg(F.count("*").alias("n")).select(F.lit("movies").alias("of"), "n").unionByName(r.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("users").alias("of"), "n"))
    return st.eight_numbers(both, "n", "of")


@query("agg17_load_quantiles", f"{R}, h AS (SELECT strftime(ts, '%Y-%m-%dT%H') AS slot, count(*) AS n FROM ratings GROUP BY 1) SELECT {e6('quantile_cont(n, 0.5)')} AS p50, {e6('quantile_cont(n, 0.9)')} AS p90, {e6('quantile_cont(n, 0.95)')} AS p95, {e6('quantile_cont(n, 0.99)')} AS p99, max(n) AS max, {e6('avg(n)')} AS mean FROM h")
def load_quantiles(spark, d):
    """AGG-17: load of the active hours."""
    h = ad.ratings(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("slot")).agg(F.count("*").alias("n"))
    return st.quantiles(h, "n", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).select("p50", "p90", "p95", "p99", "max", "mean")


LAG = RATINGS + ", l AS (SELECT event_id, user_id, ts_s - lag(ts_s) OVER (PARTITION BY user_id ORDER BY ts_s, movie_id, event_id) AS lag_s FROM ratings)"


@query("agg18_latency", f"WITH {LAG} SELECT count(lag_s) AS count, {e6('avg(lag_s)')} AS mean, {e6('quantile_cont(lag_s, 0.5)')} AS p50, {e6('quantile_cont(lag_s, 0.95)')} AS p95, {e6('max(lag_s)')} AS max, {e6('sum(lag_s)/1e3')} AS total_ks FROM l")
def latency(spark, d):
    """AGG-18: a latency summary, here of the time between a user's events."""
    s = st.quantiles(st.lags(ad.ratings(spark, d)), "lag_s", {"p50": 0.5, "p95": 0.95}, total=True)
    return s.select("count", "mean", "p50", "p95", "max", even(F.col("total") / 1e3).alias("total_ks"))


@query("agg19_gini", f"WITH {COUNTS}, g AS (SELECT n, row_number() OVER (ORDER BY n, movie_id) AS i FROM c) SELECT {e6('(2.0 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n))')} AS gini FROM g")
def gini(spark, d):
    """AGG-19: the Gini coefficient of the movies' ratings."""
    return st.gini(ad.ratings(spark, d).groupBy("movie_id").agg(F.count("*").alias("n")), "n")


@query("agg20_concentration", f"WITH {COUNTS}, f(fraction) AS (VALUES (0.01), (0.05), (0.1), (0.5)), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, movie_id) AS i FROM c) SELECT fraction, greatest(1, CAST(ceil((SELECT count(*) FROM c) * fraction) AS BIGINT)) AS top_n, CAST(sum(n) AS BIGINT) AS held, {e6('sum(n) * 1.0 / (SELECT sum(n) FROM c)')} AS share FROM f JOIN k ON i <= greatest(1, ceil((SELECT count(*) FROM c) * fraction)) GROUP BY fraction".replace("(VALUES (0.01), (0.05), (0.1), (0.5))", "(SELECT CAST(x AS DOUBLE) FROM (VALUES (0.01), (0.05), (0.1), (0.5)) t(x))"))
def concentration(spark, d):
    """AGG-20: share of the ratings that the most rated movies hold."""
    c = ad.ratings(spark, d).groupBy("movie_id").agg(F.count("*").alias("n"))
    return st.concentration(c, "n", "movie_id", [0.01, 0.05, 0.1, 0.5])


@query("agg21_coverage", f"WITH {COUNTS}, t(threshold) AS (VALUES (50), (90), (100), (120)) SELECT threshold, count(*) FILTER (n >= threshold) AS items, {e6('count(*) FILTER (n >= threshold) * 1.0 / count(*)')} AS item_share, CAST(coalesce(sum(n) FILTER (n >= threshold), 0) AS BIGINT) AS ratings, {e6('coalesce(sum(n) FILTER (n >= threshold), 0) * 1.0 / sum(n)')} AS rating_share FROM c, t GROUP BY threshold")
def coverage(spark, d):
    """AGG-21: items with so many ratings at least, and what they hold."""
    c = ad.ratings(spark, d).groupBy("movie_id").agg(F.count("*").alias("n"))
    return st.coverage(c, "n", [50, 90, 100, 120])


@query("agg22_at_most", f"WITH {COUNTS}, t(threshold) AS (VALUES (50), (60), (70), (80)) SELECT threshold, count(*) FILTER (n <= threshold) AS users FROM u, t GROUP BY threshold")
def at_most(spark, d):
    """AGG-22: users with so many ratings at most."""
    return st.at_most(st.user_spans(ad.ratings(spark, d)), "n", [50, 60, 70, 80], "users")


@query("agg23_span_buckets", f"WITH {COUNTS}, l(bucket, lo, hi) AS (VALUES ('<=1d', -1e9, 1.0), ('1-7d', 1.0, 7.0), ('7-28d', 7.0, 28.0), ('28-29d', 28.0, 29.0), ('>29d', 29.0, 1e9)) SELECT bucket, count(user_id) AS users FROM l LEFT JOIN u ON days > lo AND days <= hi GROUP BY bucket")
def span_buckets(spark, d):
    """AGG-23: users by span, buckets open on the left; empty ones stay."""
    return st.buckets(st.user_spans(ad.ratings(spark, d)), "days", [1.0, 7.0, 28.0, 29.0], "users")


@query("agg24_span_by_length", f"WITH {COUNTS}, t(threshold) AS (VALUES (50), (65), (75)) SELECT threshold, count(*) AS users, {e6('quantile_cont(days, 0.5)')} AS median_days, {e6('avg(days)')} AS mean_days FROM t JOIN u ON n >= threshold GROUP BY threshold")
def span_by_length(spark, d):
    """AGG-24: spans of the users with so many ratings at least."""
    u = st.user_spans(ad.ratings(spark, d))
    t = u.select("days", F.explode(F.filter(F.array(*map(F.lit, (50, 65, 75))), lambda t: t <= F.col("n"))).alias("threshold"))
    return t.groupBy("threshold").agg(F.count("*").alias("users"), even(F.avg("days")).alias("mean_days")).join(st.picked(t, "days", {"median_days": 0.5}, "threshold"), "threshold")


@query("agg25_genre_ratings", f"WITH {PARSED}, {RATINGS}, {STARS}, g AS (SELECT movie_id, unnest(genres) AS genre FROM parsed) SELECT genre, count(*) AS n, {e6('avg(rating)')} AS mean FROM g JOIN stars USING (movie_id) GROUP BY genre")
def genre_ratings(spark, d):
    """AGG-25: ratings and mean by genre; movies are summed up before their genres are spread."""
    from ..operators.cleaning import parsed

    s = ad.stars(spark, d).groupBy("movie_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
    g = parsed(ad.movies(spark, d)).join(s, "movie_id").select(F.explode("genres").alias("genre"), "n", "total")
    return g.groupBy("genre").agg(F.sum("n").alias("n"), even(F.sum("total") / F.sum("n")).alias("mean"))


@query("agg26_density", f"{R} SELECT count(*) AS n, {e6('count(*) * 1.0 / (count(DISTINCT user_id) * count(DISTINCT movie_id))')} AS density, {e6('1 - count(*) * 1.0 / (count(DISTINCT user_id) * count(DISTINCT movie_id))')} AS sparsity FROM ratings")
def density(spark, d):
    """AGG-26: how full the user-item matrix is."""
    a = ad.ratings(spark, d).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("movie_id").alias("m"))
    x = share(F.col("n"), F.col("u") * F.col("m"))
    return a.select("n", even(x).alias("density"), even(1 - x).alias("sparsity"))


@query("agg29_label_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, d):
    """AGG-29: sizes of the clusters."""
    return st.value_counts(ad.items(spark, d), "label")


@query("agg31_status_counts", "SELECT event_type, user_id % 10 AS grp, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, d):
    """AGG-31: events by status and group."""
    return ad.load(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("grp")).agg(F.count("*").alias("n"))


@query("agg33_group_size", f"{R} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS sequence_length FROM ratings")
def group_size(spark, d):
    """AGG-33: the size of each row's group, beside the row."""
    return ad.ratings(spark, d).select("event_id", "user_id", F.count("*").over(Window.partitionBy("user_id")).alias("sequence_length"))


@query("agg34_score_stats", f"SELECT count(*) AS n, count(DISTINCT l_partkey) AS items, {e6('avg(s)')} AS mean, {e6('min(s)')} AS least, {e6('max(s)')} AS most, count(*) FILTER (s < 0) AS below_0, count(*) FILTER (s > 1) AS above_1 FROM (SELECT l_partkey, l_extendedprice / 50000 - 0.1 AS s FROM lineitem)")
def score_stats(spark, d):
    """AGG-34: range checks of a score file."""
    s = ad.load(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_extendedprice") / 50000 - 0.1).alias("s"))
    return s.agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"), even(F.avg("s")).alias("mean"), even(F.min("s")).alias("least"), even(F.max("s")).alias("most"), F.count_if(F.col("s") < 0).alias("below_0"), F.count_if(F.col("s") > 1).alias("above_1"))


@query("agg35_survey", "SELECT score, count(*) AS n, score >= 1 AS valid FROM (SELECT CASE WHEN l_linenumber % 7 = 0 THEN -1 ELSE CAST(l_quantity AS INT) % 5 + 1 END AS score FROM lineitem) GROUP BY score")
def survey(spark, d):
    """AGG-35: answers by score; -1 (not sure) is no valid answer."""
    s = F.when(F.col("l_linenumber") % 7 == 0, -1).otherwise(F.col("l_quantity").cast("int") % 5 + 1)
    return ad.load(spark, d, "lineitem").groupBy(s.alias("score")).agg(F.count("*").alias("n")).withColumn("valid", F.col("score") >= 1)


@query("agg36_tag_applications", "SELECT tag, count(*) AS movies, CAST(sum(n) AS BIGINT) AS applications FROM (SELECT l_partkey, l_returnflag || l_linestatus AS tag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY tag ORDER BY applications DESC, tag LIMIT 15")
def tag_applications(spark, d):
    """AGG-36, TOP-5: the fifteen tags applied most."""
    one = ad.tags(spark, d).groupBy("movie_id", "tag").agg(F.count("*").alias("n"))
    return one.groupBy("tag").agg(F.count("*").alias("movies"), F.sum("n").alias("applications")).orderBy(F.desc("applications"), "tag").limit(15)


@query("agg37_snapshots", "SELECT event_type AS kind, CASE WHEN user_id % 2 = 0 THEN 'delta' ELSE 'full' END AS mode, count(*) AS snapshots, CAST(sum(event_id % 7) AS BIGINT) AS rows, max(event_id % 7) AS most FROM events GROUP BY ALL")
def snapshots(spark, d):
    """AGG-37: snapshots by kind and mode."""
    mode = F.when(F.col("user_id") % 2 == 0, "delta").otherwise("full")
    n = F.col("event_id") % 7
    return ad.load(spark, d, "events").groupBy(F.col("event_type").alias("kind"), mode.alias("mode")).agg(F.count("*").alias("snapshots"), F.sum(n).alias("rows"), F.max(n).alias("most"))


@query("win8_running_counts", f"{R}, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ratings GROUP BY 1) SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS upto, {e6('sum(n) OVER (ORDER BY day) * 1.0 / sum(n) OVER ()')} AS share FROM g")
def running_counts(spark, d):
    """WIN-8: days with running counts and shares."""
    return st.running_days(ad.ratings(spark, d)).withColumn("share", even(F.col("share")))


@query("win9_quantile_days", f"{R}, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ratings GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER () AS total FROM g), q(q) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES (0.25), (0.5), (0.8), (0.9)) t(x)) SELECT q, min(day) AS day FROM q JOIN c ON upto >= ceil(total * q) GROUP BY q")
def quantile_days(spark, d):
    """WIN-9: the first day by which a share of the ratings has come."""
    return st.quantile_days(ad.ratings(spark, d), [0.25, 0.5, 0.8, 0.9])


@query("win10_top_movies", f"{RS} SELECT movie_id, count(*) AS n, {e6('avg(rating)')} AS mean FROM stars GROUP BY movie_id HAVING count(*) >= 50 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 20")
def top_movies(spark, d):
    """WIN-10, SRT-4: the best movies with fifty ratings, ties by count and id."""
    g = ad.stars(spark, d).groupBy("movie_id").agg(F.count("*").alias("n"), even(F.avg("rating")).alias("mean")).where("n >= 50")
    return g.orderBy(F.desc("mean"), F.desc("n"), "movie_id").limit(20)


@query("win12_repeats", f"{R} SELECT count(*) AS repeats FROM (SELECT user_id, movie_id, lag(movie_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ratings) WHERE before = movie_id")
def repeats(spark, d):
    """WIN-12: immediate repetitions of a movie by its user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ad.ratings(spark, d).withColumn("before", F.lag("movie_id").over(w)).where("before = movie_id").agg(F.count("*").alias("repeats"))


@query("top3_users", f"{R} SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark, d):
    """TOP-3, TOP-6: users with most rows, ties by the smaller id."""
    return ad.ratings(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("top4_slowest", f"WITH {LAG} SELECT event_id, {e6('lag_s')} AS lag_s FROM l ORDER BY l.lag_s DESC NULLS LAST, event_id LIMIT 10")
def slowest(spark, d):
    """TOP-4: the slowest events; unknown lags last."""
    return st.lags(ad.ratings(spark, d)).orderBy(F.desc_nulls_last("lag_s"), "event_id").limit(10).select("event_id", even(F.col("lag_s")).alias("lag_s"))


@query("flt6_first_users", f"{R}, o AS (SELECT user_id, min(event_id) AS first FROM ratings GROUP BY user_id ORDER BY first LIMIT 12) SELECT event_id, user_id FROM ratings WHERE user_id IN (SELECT user_id FROM o) AND ts_s BETWEEN 1704500000 AND 1705500000")
def first_users(spark, d):
    """FLT-5, FLT-6: the first twelve users to appear, before the time range is applied."""
    r = ad.ratings(spark, d)
    first = r.groupBy("user_id").agg(F.min("event_id").alias("first")).orderBy("first").limit(12)
    return r.join(F.broadcast(first), "user_id", "left_semi").where(F.col("ts_s").between(1704500000, 1705500000)).select("event_id", "user_id")


@query("flt8_vectors", "SELECT vec_id FROM embeddings WHERE label % 3 <> 0")
def sound_vectors(spark, d):
    """FLT-8, FLT-13, VAL-12: vectors of the right length without gaps; a third is broken first."""
    from ..functions.numbers import finite

    v = ad.items(spark, d)
    nan = F.transform("vec", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))
    broken = F.when(F.col("label") % 3 == 0, nan).otherwise(F.col("vec"))
    return v.select(F.col("movie_id").alias("vec_id"), broken.alias("vec")).where(finite(F.col("vec")) & (F.size("vec") == 64)).select("vec_id")


@query("flt10_stride", f"{R} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS i FROM ratings) WHERE (i - 1) % 4 = 0")
def stride(spark, d):
    """FLT-10: every fourth event of a user, in time order."""
    w = Window.partitionBy("user_id").orderBy("ts_s", "event_id")
    return ad.ratings(spark, d).withColumn("i", F.row_number().over(w)).where("(i - 1) % 4 = 0").select("event_id")


@query("flt12_having", f"{R} SELECT user_id, count(*) FILTER (rating > 95) AS high FROM ratings GROUP BY user_id HAVING count(*) FILTER (rating > 95) >= 2")
def having(spark, d):
    """FLT-11, FLT-12: groups with two flagged rows at least."""
    return ad.ratings(spark, d).groupBy("user_id").agg(F.count_if(F.col("rating") > 95).alias("high")).where("high >= 2")


@query("join6_genre_drops", f"WITH {FLAGGED}, t AS (SELECT unnest(genres) AS genre, movie_id FROM catalogue), x AS (SELECT genre, count(*) AS n FROM t GROUP BY genre), y AS (SELECT genre, count(*) AS n FROM t WHERE movie_id IN (SELECT movie_id FROM why) GROUP BY genre) SELECT x.genre, x.n AS movies, coalesce(y.n, 0) AS dropped, {e6('coalesce(y.n, 0) * 1.0 / x.n')} AS rate FROM x LEFT JOIN y ON x.genre = y.genre")
def genre_drops(spark, d):
    """JOIN-6, EDA-1: drop rates by genre; genres without a drop have 0."""
    from ..operators.cleaning import drop_flags

    t = drop_flags(catalogue_of(spark, d)).select("dropped", F.explode("genres").alias("genre"))
    total = t.groupBy("genre").agg(F.count("*").alias("movies"))
    gone = t.where("dropped").groupBy("genre").agg(F.count("*").alias("dropped"))
    return total.join(gone, "genre", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)).cast("bigint")).withColumn("rate", even(F.col("dropped") / F.col("movies")))
