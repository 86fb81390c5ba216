"""Queries of single operators of sources, sinks, cleaning and validation, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as num
from ..functions import text as txt
from ..functions.numbers import even
from ..operators import cleaning as cl
from ..operators import sequences as sq
from ..operators import statistics as st
from ..operators import validation as val
from ..registry import MOVIES, RATINGS, ZSCORED, query
from ..sources import adapters as ad
from ..sources import files
from .clean import CATALOGUE, CONTRACT, FLAGGED, ISSUED, PARSED, _path, catalogue_of
from .interests import CONTEXT
from .stats import e6

R, Z = f"WITH {RATINGS}", f"WITH {ZSCORED}"


# Sources and sinks.


def rating_csv(spark, d):
    path = _path(spark, "ratings.csv")
    files.write_csv(ad.ratings(spark, d).select("user_id", "movie_id", "rating", "event_id"), path)
    return path


@query("src3_lazy_csv", f"{R} SELECT event_id, rating FROM ratings WHERE rating > 50")
def lazy_csv(spark, d):
    """SRC-3: a CSV that is scanned when the query runs, with its filter."""
    return files.read_csv(spark, rating_csv(spark, d), "user_id bigint, movie_id bigint, rating double, event_id bigint").where("rating > 50").select("event_id", "rating")


@query("src5_csv_scan", f"WITH {MOVIES} SELECT count(*) AS n, count(*) FILTER (raw_title LIKE '%)') AS with_year, CAST(sum(len(string_split(genres_text, '|'))) AS BIGINT) AS names FROM movies")
def csv_scan(spark, d):
    """SRC-5: a survey of the raw catalogue file in one scan."""
    path = _path(spark, "movies.csv")
    files.write_csv(ad.movies(spark, d).select("movie_id", "raw_title", "genres_text"), path)
    m = files.read_csv(spark, path, "movie_id bigint, raw_title string, genres_text string")
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("raw_title").endswith(")")).alias("with_year"), F.sum(F.size(F.split("genres_text", r"\|"))).alias("names"))


@query("src11_attached", "SELECT e.event_id, p.p_name AS name FROM events e JOIN part p ON p.p_partkey = CAST(e.props->>'$.k' AS BIGINT)")
def attached(spark, d):
    """SRC-11: two stores under names, read by one statement."""
    with_names = files.attached(spark, {"ratings": ad.ratings(spark, d), "movies": ad.load(spark, d, "part")})
    return with_names("SELECT r.event_id, m.p_name AS name FROM {ratings} r JOIN {movies} m ON m.p_partkey = r.movie_id")


@query("src12_first_existing", "SELECT count(*) AS n FROM orders")
def first_existing(spark, d):
    """SRC-12: the first path that exists."""
    return spark.read.parquet(files.first_existing(spark, f"{d}/none.parquet", f"{d}/orders.parquet", f"{d}/events.parquet")).agg(F.count("*").alias("n"))


@query("snk1_nulls_empty", "SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS empty FROM part")
def nulls_empty(spark, d):
    """SNK-1: nulls are written as empty fields."""
    path = _path(spark, "nulls.csv")
    files.write_csv(ad.movies(spark, d).select("movie_id", F.when(F.col("movie_id") % 3 > 0, F.col("raw_title")).alias("title")), path)
    lines = spark.read.text(path).where("value <> 'movie_id,title'")
    return lines.agg(F.count("*").alias("n"), F.count_if(F.col("value").endswith(",")).alias("empty"))


@query("snk2_sunk_csv", f"{R} SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ratings WHERE rating > 20")
def sunk_csv(spark, d):
    """SNK-2: a CSV written part by part as the plan runs, collected nowhere."""
    path = _path(spark, "sunk.csv")
    files.write_csv(ad.ratings(spark, d).where("rating > 20").select("event_id"), path)
    return files.read_csv(spark, path, "event_id bigint").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("snk3_user_lines", f"{R} SELECT count(DISTINCT user_id) AS lines, count(*) AS ratings FROM ratings")
def user_lines(spark, d):
    """SNK-3: JSON lines, one user each."""
    path = _path(spark, "users.jsonl")
    files.write_json_lines(cl.user_records(ad.ratings(spark, d)), path)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.sum(F.size(F.from_json("value", "ratings array<struct<movie_id:bigint>>")["ratings"])).alias("ratings"))


@query("snk4_append_log", "SELECT event_id % 3 AS part, count(*) AS n FROM events GROUP BY ALL")
def append_log(spark, d):
    """SNK-4: a log of JSON lines that grows by appends."""
    path, e = _path(spark, "log.jsonl"), ad.load(spark, d, "events").select("event_id")
    for k in range(3):
        files.write_json_lines(e.where(f"event_id % 3 = {k}").withColumn("part", F.lit(k)), path, append=k > 0)
    return files.read_json_lines(spark, path, "event_id bigint, part bigint").groupBy("part").agg(F.count("*").alias("n"))


@query("snk6_bundle", "SELECT vec_id, CAST(label AS BIGINT) AS label, len(embedding) AS dim FROM embeddings")
def bundle(spark, d):
    """SNK-6: parallel arrays of vectors, ids and labels as one bundle, and its required columns."""
    path = _path(spark, "bundle.parquet")
    files.write_frame(ad.load(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label")), path)
    return files.require(spark.read.parquet(path), "vec_id", "embedding", "label").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"))


@query("snk7_cleared", "SELECT p_partkey AS movie_id FROM part WHERE p_partkey % 2 = 0")
def cleared(spark, d):
    """SNK-7: what an output held before goes first."""
    path, m = _path(spark, "cleared.parquet"), ad.movies(spark, d).select("movie_id")
    files.write_frame(m, path)
    files.write_frame(m.where("movie_id % 2 = 0"), path)
    return spark.read.parquet(path)


@query("snk8_report", f"WITH {ISSUED} SELECT issue, count(*) AS n, (SELECT count(*) FROM issued) AS total FROM issued GROUP BY issue")
def report(spark, d):
    """SNK-8: a validation report and its bad rows, written side by side and read again."""
    path = _path(spark, "report")
    issues = cl.issues(catalogue_of(spark, d))
    files.write_report(issues.agg(F.count("*").alias("total")), issues, path)
    total = files.read_json_lines(spark, f"{path}/report.jsonl", "total bigint")  # one row
    rows = files.read_csv(spark, f"{path}/bad_rows.csv", "movie_id bigint, issue string, severity string, details string")
    return rows.groupBy("issue").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


# Projections and filters.


@query("prj1_renamed", f"WITH {PARSED} SELECT year AS release_year, movie_id AS id, title FROM parsed")
def renamed(spark, d):
    """PRJ-1: columns renamed and put in another order, helpers left out."""
    return cl.parsed(ad.movies(spark, d)).drop("mode", "genres").withColumnsRenamed({"movie_id": "id", "year": "release_year"}).select("release_year", "id", "title")


@query("prj2_added", "SELECT p_partkey AS movie_id, p_size * 2 AS double_size, p_size % 2 = 0 AS even_size, length(p_name) AS name_length FROM part")
def added(spark, d):
    """PRJ-2: several columns added at once."""
    p = ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), "p_size", "p_name")
    return p.withColumns({"double_size": F.col("p_size") * 2, "even_size": F.col("p_size") % 2 == 0, "name_length": F.length("p_name").cast("bigint")}).drop("p_size", "p_name")


@query("prj3_filled", f"WITH {CATALOGUE} SELECT movie_id, coalesce(imdb_id, -1) AS imdb_id, coalesce(rating_avg, 0.0) AS rating_avg, tag_count FROM catalogue")
def filled(spark, d):
    """PRJ-3: defaults for nulls."""
    c = catalogue_of(spark, d)
    return c.select("movie_id", F.coalesce("imdb_id", F.lit(-1)).alias("imdb_id"), F.coalesce("rating_avg", F.lit(0.0)).alias("rating_avg"), "tag_count")


@query("prj4_lenient_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 1 THEN 'tt' || event_id WHEN event_id % 4 = 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def lenient_cast(spark, d):
    """PRJ-4: text to number, null where it is none."""
    i = F.col("event_id").cast("string")
    t = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("tt"), i)).when(F.col("event_id") % 4 == 2, F.lit("")).otherwise(i)
    return ad.load(spark, d, "events").select("event_id", t.try_cast("bigint").alias("n"))


@query("prj5_markers", f"WITH {CATALOGUE} SELECT has_links, has_ratings, count(*) AS n FROM catalogue GROUP BY ALL")
def markers(spark, d):
    """PRJ-5: literal marks that tell a missed left join."""
    return catalogue_of(spark, d).groupBy("has_links", "has_ratings").agg(F.count("*").alias("n"))


@query("prj6_details", "SELECT event_id, 'user ' || user_id || ': value ' || printf('%.2f', value) || ' of ' || coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END, 'none') AS details FROM events")
def details(spark, d):
    """PRJ-6: a template filled in, nulls included."""
    kind = F.coalesce(F.when(F.col("event_id") % 5 > 0, F.col("event_type")), F.lit("none"))
    return ad.load(spark, d, "events").select("event_id", F.format_string("user %d: value %.2f of %s", "user_id", "value", kind).alias("details"))


BLANKS = "SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '  ' WHEN p_partkey % 4 = 2 THEN chr(8195) ELSE p_name END AS title FROM part"


@query("flt1_blank", f"WITH b AS ({BLANKS}) SELECT movie_id FROM b WHERE title IS NULL OR trim(replace(title, chr(8195), ' ')) = ''")
def blank(spark, d):
    """FLT-1: blank titles; null and wide blanks count as blank."""
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("  ")).when(k == 2, F.lit("\u2003")).otherwise(F.col("p_name"))
    return ad.load(spark, d, "part").where(txt.is_blank(title)).select(F.col("p_partkey").alias("movie_id"))


@query("flt3_both_sides", f"WITH {FLAGGED} SELECT NOT (no_ratings OR no_genres OR no_year) AS kept, count(*) AS n, min(movie_id) AS least FROM flagged GROUP BY ALL")
def both_sides(spark, d):
    """FLT-3: kept and dropped rows by complementary predicates, which together are all."""
    f = cl.drop_flags(catalogue_of(spark, d))
    side = lambda rows, kept: rows.agg(F.lit(kept).alias("kept"), F.count("*").alias("n"), F.min("movie_id").alias("least")).where("n > 0")
    return side(f.where(~F.col("dropped")), True).unionByName(side(f.where("dropped"), False))


@query("flt4_before", f"{R} SELECT event_id FROM ratings WHERE ts_s < 1705000000")
def before(spark, d):
    """FLT-4: an exclusive cutoff."""
    return ad.ratings(spark, d).where(F.col("ts_s") < 1705000000.0).select("event_id")


@query("flt9_members", f"{R} SELECT event_id FROM ratings WHERE movie_id IN (3, 14, 15, 92) AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def members_only(spark, d):
    """FLT-9: membership in a list and in a table."""
    rich = ad.load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return ad.ratings(spark, d).where(F.col("movie_id").isin(3, 14, 15, 92)).join(rich, "user_id", "left_semi").select("event_id")


@query("flt11_active", f"{Z} SELECT p.event_id FROM positives p WHERE known")
def active(spark, d):
    """FLT-11: rows that are active and whose item is known."""
    rows = sq.zscored(ad.ratings(spark, d)).withColumn("status", F.when(F.col("z") > 0, "active").otherwise("inactive"))
    return rows.where((F.col("status") == "active") & ad.known()).select("event_id")


@query("flt13_finite", "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 2 AND vec_id % 11 <> 3")
def finite_rows(spark, d):
    """FLT-13: vectors without components that are not finite; some are broken first."""
    k = F.col("movie_id")
    broken = F.transform("vec", lambda x, i: F.when((i == 5) & (k % 7 == 2), float("nan")).when((i == 60) & (k % 11 == 3), float("-inf")).otherwise(x))
    return ad.items(spark, d).where(num.finite(broken)).select(k.alias("vec_id"))


@query("flt14_unseen", f"{Z} SELECT r.event_id FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = r.user_id AND p.movie_id = r.movie_id)")
def unseen(spark, d):
    """FLT-14: rows whose (user, movie) has not been seen."""
    r = ad.ratings(spark, d)
    return r.join(sq.positives(r).select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti").select("event_id")


# Joins and aggregates.


@query("join4_reason_lists", f"WITH {FLAGGED} SELECT r.event_id, w.reasons IS NULL AS unknown, coalesce(len(w.reasons), 0) AS n FROM ratings r LEFT JOIN why w USING (movie_id)")
def left_lists(spark, d):
    """JOIN-4: a left join that brings a list, null where there is none."""
    why = cl.reasons(cl.drop_flags(catalogue_of(spark, d)))
    r = ad.ratings(spark, d).join(why, "movie_id", "left")
    return r.select("event_id", F.col("reasons").isNull().alias("unknown"), F.coalesce(F.size("reasons"), F.lit(0)).cast("bigint").alias("n"))


VOCABULARY = RATINGS + ", v AS (SELECT movie_id, row_number() OVER (ORDER BY movie_id) AS item_idx FROM (SELECT DISTINCT movie_id FROM ratings WHERE movie_id % 10 <> 7))"


@query("join7_lookup", f"WITH {VOCABULARY} SELECT event_id, item_idx, CASE WHEN item_idx IS NULL THEN 'skipped_unknown' ELSE 'active' END AS status FROM ratings LEFT JOIN v USING (movie_id)")
def lookup(spark, d):
    """JOIN-7: items looked up in the vocabulary; what is not there is skipped as unknown."""
    r = ad.ratings(spark, d)
    rows = r.join(sq.vocabulary(r.where(ad.known())), "movie_id", "left")
    return rows.select("event_id", "item_idx", F.when(F.col("item_idx").isNull(), "skipped_unknown").otherwise("active").alias("status"))


@query("join8_metadata", f"WITH {PARSED}, {RATINGS} SELECT event_id, coalesce(title, '') AS title, coalesce(array_to_string(genres, '|'), '') AS genres FROM ratings r LEFT JOIN (SELECT * FROM parsed WHERE movie_id % 3 > 0) p ON p.movie_id = r.movie_id")
def metadata(spark, d):
    """JOIN-8: metadata beside each row, blank where unknown."""
    m = cl.parsed(ad.movies(spark, d)).where("movie_id % 3 > 0")
    return ad.ratings(spark, d).join(m, "movie_id", "left").select("event_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_join("genres", "|"), F.lit("")).alias("genres"))


@query("join9_changed_rows", "SELECT c.event_id, c.value FROM events l JOIN events c ON l.user_id = c.user_id AND l.event_id = c.event_id AND l.event_type = c.event_type WHERE l.event_id % 3 = 0 AND c.event_id % 2 = 0")
def cached_changes(spark, d):
    """JOIN-9: a log of changes with the cached rows, on three keys."""
    e, keys = ad.load(spark, d, "events"), ["user_id", "event_id", "event_type"]
    return e.where("event_id % 3 = 0").select(*keys).join(e.where("event_id % 2 = 0").select(*keys, "value"), keys).select("event_id", "value")


@query("join10_progress", "SELECT e.user_id, e.event_id, i.value IS NOT NULL AS ingested FROM events e LEFT JOIN (SELECT * FROM events WHERE event_id % 4 > 0) i ON i.user_id = e.user_id AND i.event_id = e.event_id")
def progress_rows(spark, d):
    """JOIN-10: progress with its input rows, on two keys, where there is one."""
    e = ad.load(spark, d, "events").select("user_id", "event_id", "value")
    return e.select("user_id", "event_id").join(e.where("event_id % 4 > 0"), ["user_id", "event_id"], "left").select("user_id", "event_id", F.col("value").isNotNull().alias("ingested"))


@query("join18_cutoffs", f"{R} SELECT c.cutoff, count(*) FILTER (ts_s <= c.cutoff) AS before, count(*) FILTER (ts_s > c.cutoff) AS after FROM ratings, (VALUES (1704500000), (1705000000), (1706000000)) c(cutoff) GROUP BY c.cutoff")
def cutoff_sides(spark, d):
    """JOIN-18: rows on both sides of each candidate, by conditional counts of one pass."""
    cuts = [1704500000, 1705000000, 1706000000]
    one = ad.ratings(spark, d).agg(*(F.count_if(F.col("ts_s") <= c).alias(f"b{c}") for c in cuts), F.count("*").alias("n"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"b{c}").alias("before"), (F.col("n") - F.col(f"b{c}")).alias("after")) for c in cuts))))


@query("agg1_means", f"{R} SELECT movie_id, round_even(avg(rating) * 100, 0) / 100 AS mean, count(*) AS n FROM ratings GROUP BY movie_id")
def means(spark, d):
    """AGG-1: mean to two digits and count by movie."""
    return cl.rating_summary(ad.ratings(spark, d)).withColumnsRenamed({"rating_avg": "mean", "rating_count": "n"})


@query("agg2_ordered_tags", "WITH t AS (SELECT l_partkey AS movie_id, l_returnflag || l_linestatus AS tag, min(l_shipdate) AS shipped FROM lineitem GROUP BY ALL) SELECT movie_id, array_to_string(list(tag ORDER BY shipped, tag), '|') AS tags, count(*) AS tag_count FROM t GROUP BY movie_id")
def ordered_tags(spark, d):
    """AGG-2: distinct tags in order of first appearance, and their number."""
    t = cl.ordered_tags(ad.tags(spark, d), F.col("at"))
    return t.select("movie_id", F.array_join("tags", "|").alias("tags"), F.col("tag_count").cast("bigint").alias("tag_count"))


@query("agg4_totals", f"{R} SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies FROM ratings")
def totals(spark, d):
    """AGG-4: a count and two exact distinct counts."""
    return ad.ratings(spark, d).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("movies"))


# Order, tops and sets.


@query("win11_ranks", f"{R} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, movie_id, event_id) AS rank FROM ratings QUALIFY rank <= 10")
def ranks(spark, d):
    """WIN-11: ranks 1 to 10 within a user, ties to the smaller item."""
    w = Window.partitionBy("user_id").orderBy(F.desc("rating"), "movie_id", "event_id")
    return ad.ratings(spark, d).select("event_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("win14_before", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, value AS after FROM events")
def before_and_after(spark, d):
    """WIN-14: the row before, beside each row."""
    return ad.load(spark, d, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"), F.col("value").alias("after"))


@query("win15_versions", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_id % 2 = 0")
def versions(spark, d):
    """WIN-15: a version counter of each user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ad.load(spark, d, "events").where("event_id % 2 = 0").select("event_id", F.row_number().over(w).cast("bigint").alias("version"))


@query("win22_last_open", "SELECT user_id, max(event_id) AS request, arg_max(value, event_id) AS value FROM events WHERE event_id % 4 = 0 GROUP BY user_id")
def last_open(spark, d):
    """WIN-22: the last open request of each user."""
    o = ad.load(spark, d, "events").where("event_id % 4 = 0")
    return o.groupBy("user_id").agg(F.max("event_id").alias("request"), F.max_by("value", "event_id").alias("value"))


@query("win23_latest_run", "SELECT event_type AS run, max(coalesce(CASE WHEN event_id % 3 = 0 THEN event_id END, CASE WHEN event_id % 3 = 1 THEN event_id + 2 END, event_id - 5)) AS at_ FROM events GROUP BY run ORDER BY at_ DESC, run LIMIT 1")
def latest_run(spark, d):
    """WIN-23: the latest run by the first of started, created and updated that it has."""
    k = F.col("event_id")
    at = F.coalesce(F.when(k % 3 == 0, k), F.when(k % 3 == 1, k + 2), k - 5)
    return ad.load(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.max(at).alias("at_")).orderBy(F.desc("at_"), "run").limit(1)


@query("srt1_user_order", f"{R} SELECT event_id, row_number() OVER (ORDER BY user_id, ts_s, movie_id, event_id) - 1 AS place FROM ratings")
def user_order(spark, d):
    """SRT-1: the table in order of user, time and movie."""
    return sq.numbered(ad.ratings(spark, d).select("user_id", "ts_s", "movie_id", "event_id"), ["user_id", "ts_s", "movie_id", "event_id"], "place", start=0).select("event_id", "place")


@query("srt2_dense_order", f"{R} SELECT event_id, row_number() OVER (ORDER BY ts_s, user_id, movie_id, event_id) AS place FROM ratings WHERE rating > 10")
def dense_order(spark, d):
    """SRT-2: a dense order by four keys over the whole table."""
    r = ad.ratings(spark, d).where("rating > 10").select("ts_s", "user_id", "movie_id", "event_id")
    return sq.numbered(r, ["ts_s", "user_id", "movie_id", "event_id"], "place").select("event_id", "place")


@query("srt4_first_events", f"{R} SELECT event_id FROM ratings ORDER BY rating DESC, event_id LIMIT 50")
def first_events(spark, d):
    """SRT-4: a limit after a sort."""
    return ad.ratings(spark, d).orderBy(F.desc("rating"), "event_id").limit(50).select("event_id")


@query("top5_most_common", "SELECT l_returnflag || l_linestatus || l_linenumber AS tag, count(*) AS n FROM lineitem GROUP BY tag ORDER BY n DESC, tag LIMIT 15")
def most_common(spark, d):
    """TOP-5: the fifteen most common."""
    t = ad.load(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("tag")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "tag").limit(15)


@query("top6_first_users", "SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 7")
def first_users(spark, d):
    """TOP-6: the first users in order of the file."""
    return ad.load(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("_first")).orderBy("_first").limit(7).select("user_id")


@query("set1_all_issues", f"WITH {ISSUED} SELECT 'catalogue' AS origin, count(*) AS n FROM issued UNION ALL SELECT 'orphans', count(*) FROM (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) AS k FROM events) WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def all_issues(spark, d):
    """SET-1: frames of issues one under the other."""
    c = cl.issues(catalogue_of(spark, d)).select(F.lit("catalogue").alias("origin"), "movie_id")
    o = cl.orphans(ad.ratings(spark, d), ad.movies(spark, d).where("p_size > 5")).select(F.lit("orphans").alias("origin"), "movie_id")
    return c.unionByName(o).groupBy("origin").agg(F.count("*").alias("n"))


@query("set7_vocabulary", f"WITH {PARSED} SELECT title, row_number() OVER (ORDER BY title) AS idx FROM (SELECT DISTINCT title FROM parsed)")
def title_vocabulary(spark, d):
    """SET-7: distinct names in order, numbered from 1."""
    return sq.numbered(cl.parsed(ad.movies(spark, d)).select("title").distinct(), "title", "idx")


@query("set8_stale", f"{R}, m AS (SELECT max(event_id) // 2 AS h FROM ratings) SELECT DISTINCT user_id, movie_id FROM ratings, m WHERE event_id <= h AND (user_id, movie_id) NOT IN (SELECT (user_id, movie_id) FROM ratings, m WHERE event_id > h)")
def stale(spark, d):
    """SET-8: what was active and is no more."""
    r = ad.ratings(spark, d)
    half = r.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    keys = ["user_id", "movie_id"]
    return r.where(F.col("event_id") <= half).select(*keys).distinct().join(r.where(F.col("event_id") > half).select(*keys), keys, "left_anti")


@query("set9_users", "SELECT DISTINCT user_id FROM events")
def distinct_users(spark, d):
    """SET-9: the users, once each."""
    return ad.load(spark, d, "events").select("user_id").distinct().orderBy("user_id")


# Scalars.


@query("str2_stripped", "SELECT p_partkey AS movie_id, p_name AS name FROM part")
def stripped(spark, d):
    """STR-2: white space of every kind goes at both ends, and stays inside."""
    p = ad.load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("movie_id"), txt.strip(F.concat(F.lit("\u2003 \t"), "p_name", F.lit("\u00a0\n "))).alias("name"))


@query("str4_all_genres", "SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 3 = 0 THEN '(no genres listed)' ELSE replace(p_name, ' ', ',') END AS genres FROM part")
def all_genres(spark, d):
    """STR-4: the survey's split, which keeps the unlisted mark as a genre."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit(txt.NO_GENRES)).otherwise(F.regexp_replace("p_name", " ", "| "))
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.array_join(txt.genres(text, keep_unlisted=True), ",").alias("genres"))


@query("str6_prefixes", "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def prefixes(spark, d):
    """STR-6: parts of a date as prefixes of its text."""
    iso = num.iso(F.floor("ts_s").cast("bigint"))
    return ad.ratings(spark, d).groupBy(F.substring(iso, 1, 4).alias("year"), F.substring(iso, 1, 10).alias("day")).agg(F.count("*").alias("n"))


@query("str7_names", "SELECT p_partkey AS movie_id, trim(regexp_replace(lower(p_type || ' & ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS run FROM part")
def names(spark, d):
    """STR-7: slugs and run ids."""
    p = ad.load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("movie_id"), txt.slug(F.concat("p_type", F.lit(" & "), "p_name")).alias("slug"), txt.run_id(F.concat("p_brand", F.lit("/"), "p_name")).alias("run"))


@query("str8_formats", "SELECT o_orderkey AS id, format('{:,}', o_orderkey * 1000) AS thousands, printf('%.2f', round_even(o_totalprice * 100, 0) / 100) AS fixed, CASE WHEN o_custkey % 3 = 0 THEN '0.0%' ELSE printf('%.1f%%', 100.0 * (o_orderkey % 7) / (o_custkey % 3)) END AS percent FROM orders")
def formats(spark, d):
    """STR-8: thousands, fixed digits, and percents of a whole that may be 0."""
    o = ad.load(spark, d, "orders")
    whole = F.col("o_custkey") % 3
    return o.select(F.col("o_orderkey").alias("id"), txt.thousands(F.col("o_orderkey") * 1000).alias("thousands"), F.format_string("%.2f", even(F.col("o_totalprice"), 2)).alias("fixed"), txt.percent(F.col("o_orderkey") % 7, whole).alias("percent"))


@query("dat2_epochs", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) - 3600.0 * (event_id % 5) AS s FROM events")
def epochs(spark, d):
    """DAT-2: ISO texts with Z or an offset as seconds."""
    r = ad.ratings(spark, d)
    local = F.date_format(F.timestamp_seconds(F.floor("ts_s")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(local, F.when(F.col("event_id") % 5 == 0, F.lit("Z")).otherwise(F.format_string("+%02d:00", F.col("event_id") % 5)))
    return r.select("event_id", num.epoch(text).alias("s"))


@query("dat4_years", "SELECT event_id, least(2030, greatest(1970, CAST(year(ts) AS BIGINT) + (event_id % 5 - 2) * 40)) AS year FROM events")
def years(spark, d):
    """DAT-4: the year of an epoch, no earlier than 1970 and no later than 2030."""
    s = F.unix_micros(F.make_timestamp(F.year("ts") + ((F.col("event_id") % 5 - 2) * 40).cast("int"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) / F.lit(1e6)
    return ad.ratings(spark, d).select("event_id", num.clamped_year(s).alias("year"))


@query("dat5_spans", f"{R} SELECT user_id, {e6('(max(ts_s) - min(ts_s)) / 86400.0')} AS days FROM ratings GROUP BY user_id")
def spans(spark, d):
    """DAT-5: the days between first and last, as a fraction."""
    return ad.ratings(spark, d).groupBy("user_id").agg(even(num.span_days(F.min("ts_s"), F.max("ts_s"))).alias("days"))


@query("dat6_calendar", "SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(CAST(o_orderdate AS DATE) - INTERVAL 730 DAY AS DATE) AS earlier, CAST(make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31) AS DATE) AS year_end, strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59Z' AS day_end FROM orders")
def calendar(spark, d):
    """DAT-6: day counts, years back as 365 days each, ends of years and days."""
    day = F.to_date("o_orderdate")
    return ad.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.datediff(day, F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"), F.date_sub(day, 730).alias("earlier"), F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("year_end"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z")).alias("day_end")
    )


@query("mth1_zscores", f"{R}, m AS (SELECT movie_id, avg(rating) AS a, stddev_pop(rating) AS s FROM ratings GROUP BY movie_id) SELECT event_id, {e6('(rating - a) / (s + 1e-8)')} AS z FROM ratings JOIN m USING (movie_id)")
def zscores(spark, d):
    """MTH-1: z with a regularised deviation, here by movie."""
    r = ad.ratings(spark, d)
    m = r.groupBy("movie_id").agg(F.avg("rating").alias("a"), F.stddev_pop("rating").alias("s"))
    return r.join(m, "movie_id").select("event_id", even((F.col("rating") - F.col("a")) / (F.col("s") + F.lit(1e-8))).alias("z"))


PAIRS = "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def neighbours(spark, d):
    i = ad.items(spark, d)
    return i.select("movie_id", F.col("vec").alias("a")).join(i.select((F.col("movie_id") - 1).alias("movie_id"), F.col("vec").alias("b")), "movie_id").withColumnRenamed("movie_id", "vec_id")


@query("mth4_dots", f"{PAIRS} SELECT vec_id, {e6('list_dot_product(a, b)')} AS s FROM p")
def dots(spark, d):
    """MTH-4: dot products in double precision."""
    return neighbours(spark, d).select("vec_id", even(num.dot(F.col("a"), F.col("b"))).alias("s"))


@query("mth5_cosines", f"{PAIRS}, q AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN [0.0 for x in a] ELSE a END AS a, b FROM p) SELECT vec_id, {e6('list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-8)')} AS s FROM q")
def cosines(spark, d):
    """MTH-5: cosines with a floor under the denominator, so that zero vectors give 0."""
    a = F.when(F.col("vec_id") % 4 == 0, F.transform("a", lambda x: F.lit(0.0))).otherwise(F.col("a"))
    return neighbours(spark, d).select("vec_id", even(num.cosine(a, F.col("b"))).alias("s"))


@query("mth6_percentiles", f"{R} SELECT movie_id, {e6('quantile_cont(rating, 0.95)')} AS p95 FROM ratings GROUP BY movie_id")
def percentiles(spark, d):
    """MTH-6: percentiles by linear interpolation."""
    return st.picked(ad.ratings(spark, d), "rating", {"p95": 0.95}, "movie_id")


@query("mth7_close", "SELECT vec_id, vec_id % 3 = 0 AS near FROM embeddings")
def relative_closeness(spark, d):
    """MTH-7: |a - b| <= atol + rtol |b|; one in three is within it."""
    x = F.col("vec")[0] + 3
    other = x * F.when(F.col("movie_id") % 3 == 0, 1 + 5e-6).when(F.col("movie_id") % 3 == 1, 1 + 3e-5).otherwise(1 - 3e-5)
    return ad.items(spark, d).select(F.col("movie_id").alias("vec_id"), num.close(other, x).alias("near"))


@query("arr2_vector_texts", "SELECT p_partkey AS movie_id, '[' || p_size || ', ' || (p_size % 3) || ']' AS listed FROM part")
def vector_texts(spark, d):
    """ARR-2: a vector as text."""
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), txt.list_text(F.array("p_size", F.col("p_size") % 3)).alias("listed"))


@query("arr3_exploded", "SELECT p_partkey AS movie_id, w AS word FROM part, unnest(string_split(p_name, ' ')) t(w) WHERE w <> 'small'")
def exploded(spark, d):
    """ARR-3: a list in rows, nulls left out."""
    names = F.transform(F.split("p_name", " "), lambda x: F.when(x != "small", x))
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.explode(names).alias("word")).where("word is not null")


@query("arr4_lists", "SELECT p_partkey AS movie_id, len(l) AS n, list_contains(l, 'ring') AS ring, array_to_string(list_sort(list_distinct(l)), ',') AS names FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS l FROM part)")
def list_facts(spark, d):
    """ARR-4: length, membership, and distinct values in order."""
    names = F.split(F.concat("p_name", F.lit(" "), "p_type"), " ")
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.size(names).cast("bigint").alias("n"), F.array_contains(names, "ring").alias("ring"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("names"))


@query("arr5_padded", f"{R}, s AS (SELECT user_id, list(movie_id ORDER BY event_id)[1:user_id % 7] AS l FROM ratings GROUP BY user_id) SELECT user_id, array_to_string(list_concat([0 for x in range(8 - len(l))], l), ',') AS left_, array_to_string(list_concat(l, [0 for x in range(8 - len(l))]), ',') AS right_ FROM s")
def padded(spark, d):
    """ARR-5: sequences filled up to a length, on either side."""
    lists = ad.ratings(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "movie_id"))), lambda x: x["movie_id"]).alias("l"))
    short = lists.withColumn("l", F.slice("l", F.lit(1), (F.col("user_id") % 7).cast("int")))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return short.select("user_id", text(num.pad_left(F.col("l"), 8)).alias("left_"), text(num.pad_right(F.col("l"), 8)).alias("right_"))


@query("jsn2_decoded", "SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE len(string_split(p_name, ' ')) END AS n, p_partkey % 4 = 1 AS wrong FROM part")
def decoded(spark, d):
    """JSN-2: JSON texts as lists; a text that is none is told, not guessed."""
    good = F.to_json(F.split("p_name", " "))
    text = F.when(F.col("p_partkey") % 4 == 1, F.lit('{"a": 1}')).otherwise(good)
    names = txt.json_list(text)
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.size(names).cast("bigint").alias("n"), txt.not_a_list(text).alias("wrong"))


@query("jsn3_nested", "SELECT p_partkey AS movie_id, p_brand AS brand, array_to_string(string_split(p_name, ' '), '/') AS genres FROM part")
def nested(spark, d):
    """JSN-3: a list inside a JSON object."""
    text = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct(F.split("p_name", " ").alias("genres")).alias("movie")))
    r = F.from_json("t", "brand string, movie struct<genres:array<string>>")
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), text.alias("t")).select("movie_id", r.alias("r")).select("movie_id", "r.brand", F.array_join("r.movie.genres", "/").alias("genres"))


@query("jsn4_names", "SELECT p_partkey AS movie_id, array_to_string(string_split(p_name, ' '), '|') AS names FROM part")
def object_names(spark, d):
    """JSN-4: objects of a JSON list flattened to their names."""
    objects = F.to_json(F.transform(F.split("p_name", " "), lambda g, i: F.struct(g.alias("genre"), i.alias("count"))))
    read = F.from_json(objects, "array<struct<genre:string,count:int>>")
    return ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.array_join(F.transform(read, lambda o: o["genre"]), "|").alias("names"))


@query("hsh2_requests", "SELECT event_id, 'run:' || user_id || ':' || event_id || ':' || substr(sha1(event_type || props), 1, 12) AS request FROM events")
def requests(spark, d):
    """HSH-2: request ids of run, user, time and a digest."""
    digest = F.substring(F.sha1(F.concat("event_type", "props")), 1, 12)
    return ad.load(spark, d, "events").select("event_id", F.concat_ws(":", F.lit("run"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), digest).alias("request"))


@query("hsh3_file_digests", "WITH f AS (SELECT string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey) SELECT CASE WHEN length(text) <= 1200 THEN sha256(text) END AS digest, length(text) AS bytes, length(text) > 1200 AS too_large FROM f")
def file_digests(spark, d):
    """HSH-3: digests of files up to a size, here one file of customers' names for each nation."""
    path = _path(spark, "digests")
    names = ad.load(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    names.select(F.col("c_name").alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(path)
    return files.digests(spark, f"{path}/*/part-*", 1200).select("digest", "bytes", "too_large")


# Validation.


def contract_rows(spark, d):
    """The catalogue in the columns of the contract, with some prices broken."""
    price = F.when(F.col("movie_id") % 13 == 0, F.lit(None)).when(F.col("movie_id") % 11 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
    return ad.movies(spark, d).select("movie_id", txt.title_year(F.col("raw_title")).alias("t"), price.alias("price")).select("movie_id", "t.title", "t.year", "price")


@query(
    "src9_contract_columns",
    """SELECT 0 AS place, 'movie_id' AS name, 'bigint' AS kind, false AS nullable, count(*) - count(p_partkey) AS nulls FROM part
       UNION ALL SELECT 1, 'title', 'string', false, count(*) - count(p_name) FROM part
       UNION ALL SELECT 2, 'year', 'bigint', true, count(CASE WHEN p_size % 7 = 0 THEN 1 END) FROM part
       UNION ALL SELECT 3, 'price', 'double', false, count(CASE WHEN p_partkey % 13 = 0 THEN 1 END) FROM part""",
)
def contract_columns(spark, d):
    """SRC-9: a YAML contract as a schema, and the nulls that a table has in each of its columns."""
    fields = list(files.contract(CONTRACT).schema)
    counts = contract_rows(spark, d).agg(*(F.count_if(F.col(f.name).isNull()).alias(f.name) for f in fields))
    rows = (F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("kind"), F.lit(f.nullable).alias("nullable"), F.col(f.name).alias("nulls")) for i, f in enumerate(fields))
    return counts.select(F.inline(F.array(*rows)))


@query("val1_columns", "SELECT 'missing_column' AS issue, 'year' AS column_, count(*) AS affected FROM part UNION ALL SELECT 'unexpected_column', 'extra', count(CASE WHEN p_size % 7 > 0 THEN 1 END) FROM part")
def column_issues(spark, d):
    """VAL-1: missing and unexpected columns, and the rows that lack a value or have one too many."""
    rows = contract_rows(spark, d).withColumnRenamed("year", "extra")
    return val.schema_report(rows, files.contract(CONTRACT)).select("issue", F.col("column").alias("column_"), "affected")


@query("val2_types", "SELECT 'dtype_mismatch' AS issue, 'year' AS column_, 'string for bigint' AS details, count(CASE WHEN p_size % 7 > 0 THEN 1 END) AS affected FROM part UNION ALL SELECT 'dtype_mismatch', 'price', 'float for double', count(CASE WHEN p_partkey % 13 > 0 THEN 1 END) FROM part")
def type_issues(spark, d):
    """VAL-2: columns of another type than the contract's, and their values."""
    rows = contract_rows(spark, d).withColumns({"year": F.col("year").cast("string"), "price": F.col("price").cast("float")})
    return val.schema_report(rows, files.contract(CONTRACT)).select("issue", F.col("column").alias("column_"), "details", "affected")


def broken(spark, d, kind):
    v = val.violations(contract_rows(spark, d), files.contract(CONTRACT))
    return v.where(F.array_contains("violations", kind)).select("movie_id")


@query("val4_duplicates", f"WITH {PARSED} SELECT movie_id FROM parsed QUALIFY count(*) OVER (PARTITION BY title) > 1")
def duplicate_titles(spark, d):
    """VAL-4: every row that shares what should be unique."""
    return broken(spark, d, "duplicate:title")


@query("val5_negative", "SELECT p_partkey AS movie_id FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 13 > 0 AND p_retailprice > 0")
def negative(spark, d):
    """VAL-5: values below zero."""
    return broken(spark, d, "negative:price")


@query("val6_range", f"WITH {PARSED} SELECT movie_id FROM parsed WHERE year < 1955 OR year > 1990")
def out_of_range(spark, d):
    """VAL-6: values outside inclusive bounds."""
    return broken(spark, d, "range:year")


@query("val7_aborted", "SELECT 'catalogue' AS contract, true AS aborted, false AS written")
def aborted(spark, d):
    """VAL-7: a table that breaks its contract stops the job before its output is written."""
    path, told, done = _path(spark, "aborted.parquet"), False, True
    try:
        files.write_frame(val.enforce(contract_rows(spark, d), files.contract(CONTRACT)), path)
    except val.ContractError:
        told = True
    try:
        files.first_existing(spark, path)
    except FileNotFoundError:
        done = False
    return spark.createDataFrame([("catalogue", told, done)], "contract string, aborted boolean, written boolean")


@query("val9_parse_errors", "SELECT event_id, 'user_id' AS column_ FROM events WHERE event_id % 10 = 3 UNION ALL SELECT event_id, 'value' FROM events WHERE event_id % 8 = 1")
def parse_errors(spark, d):
    """VAL-9: rows that do not parse, with what is wrong in each."""
    path = _path(spark, "checked.csv")
    e = ad.load(spark, d, "events")
    text = lambda bad, c: F.when(bad, F.lit("x")).otherwise(F.col(c).cast("string")).alias(c)
    files.write_csv(e.select(text(F.col("event_id") % 10 == 3, "user_id"), text(F.col("event_id") % 8 == 1, "value"), "event_id"), path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("event_id", T.LongType())])
    bad = files.read_checked_csv(spark, path, schema)[1]
    return bad.select(F.col("event_id").cast("bigint").alias("event_id"), F.explode(F.transform("reasons", lambda r: F.regexp_replace(r, "^invalid:", ""))).alias("column_"))


@query("val10_reconciled", "SELECT count(*) AS input, count(*) FILTER (event_id % 10 = 3) AS invalid, count(*) FILTER (event_id % 10 <> 3) AS output, true AS reconciled FROM events")
def reconciled(spark, d):
    """VAL-10: output = input - invalid."""
    path = _path(spark, "checked.csv")
    bad = F.when(F.col("event_id") % 10 == 3, "x").otherwise(F.col("user_id").cast("string"))
    files.write_csv(ad.ratings(spark, d).select(bad.alias("user_id"), "event_id"), path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType())])
    good, wrong = files.read_checked_csv(spark, path, schema)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(files.read_csv(spark, path, "user_id string, event_id string"), "input").crossJoin(n(wrong, "invalid")).crossJoin(n(good, "output"))  # single rows
    return one.withColumn("reconciled", F.col("output") == F.col("input") - F.col("invalid"))


@query("val11_invariants", f"WITH {CONTEXT} SELECT count(*) AS n, count(DISTINCT (user_id, event_id)) AS keys, max(history_len) AS longest, count(*) FILTER (context_start_idx > event_idx) AS late, count(*) FILTER (len(items) <> history_len) AS uneven FROM ctx")
def invariants(spark, d):
    """VAL-11: unique keys, contexts no longer than allowed, none that starts after its event."""
    c = sq.context_windows(sq.positives(ad.ratings(spark, d)), ad.known(), 10)
    return c.agg(F.count("*").alias("n"), F.countDistinct("user_id", "event_id").alias("keys"), F.max("history_len").alias("longest"), F.count_if(F.col("context_start_idx") > F.col("event_idx")).alias("late"), F.count_if(F.size("items") != F.col("history_len")).alias("uneven"))


@query("val12_dimensions", "SELECT CAST(label AS BIGINT) AS label, count(*) FILTER (vec_id % 9 = 4) AS wrong FROM embeddings GROUP BY label")
def dimensions(spark, d):
    """VAL-12: vectors of another length than most of their group's."""
    short = F.when(F.col("movie_id") % 9 == 4, F.slice("vec", 1, 10)).otherwise(F.col("vec"))
    return val.other_dimensions(ad.items(spark, d).select(F.col("label").cast("bigint").alias("label"), short.alias("vec")), "label", "vec")


@query(
    "val13_options",
    "WITH o AS (SELECT event_id, value - 50 AS speed, event_id % 4 AS top_k, event_id % 2 = 0 AS skip_refit, event_id % 3 AS forced_every FROM events) SELECT event_id, 'speed' AS option FROM o WHERE speed <= 0 UNION ALL SELECT event_id, 'top_k' FROM o WHERE top_k <= 0 UNION ALL SELECT event_id, 'refit' FROM o WHERE skip_refit AND forced_every > 0",
)
def option_issues(spark, d):
    """VAL-13: options that are out of bounds or contradict each other, here of one run for each event."""
    e = ad.load(spark, d, "events")
    runs = e.select("event_id", (F.col("value") - 50).alias("speed"), (F.col("event_id") % 4).alias("top_k"), (F.col("event_id") % 2 == 0).alias("skip_refit"), (F.col("event_id") % 3).alias("forced_every"))
    return runs.select("event_id", F.explode(val.option_issues("speed", "top_k", "skip_refit", "forced_every")).alias("option"))
