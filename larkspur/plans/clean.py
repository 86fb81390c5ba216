"""Queries: sources, cleaning, joins, sets and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as num
from ..functions import text as txt
from ..operators import cleaning as cl
from ..operators import validation as val
from ..registry import MOVIES, RATINGS, STARS, query
from ..session import scratch
from ..sources import adapters as ad
from ..sources import files

PARSED = MOVIES + r""",
parsed AS (
  SELECT movie_id, raw_title,
         CASE WHEN regexp_matches(raw_title, '\((\d{4})\)\s*$') THEN rtrim(regexp_replace(raw_title, '\((\d{4})\)\s*$', ''))
              ELSE raw_title END AS title,
         CAST(nullif(regexp_extract(raw_title, '\((\d{4})\)\s*$', 1), '') AS BIGINT) AS year,
         CASE WHEN regexp_matches(raw_title, '\((\d{4})\)\s*$') THEN 'strict' END AS mode,
         list_filter(string_split(genres_text, '|'), lambda x: x <> '' AND x <> '(no genres listed)') AS genres
  FROM movies)"""

SUMMARY = RATINGS + ", " + STARS + """,
summary AS (
  SELECT movie_id, round_even(avg(rating) * 100, 0) / 100 AS rating_avg, count(*) AS rating_count FROM stars GROUP BY movie_id)"""


def _path(spark, name: str) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}-{name}"


@query("src1_csv_round_trip", f"WITH {MOVIES} SELECT movie_id, raw_title, genres_text FROM movies")
def csv_round_trip(spark, d):
    """SRC-1, SRC-3, SNK-1, SNK-2: the catalogue written as CSV and read with explicit types."""
    path = _path(spark, "movies.csv")
    files.write_csv(ad.movies(spark, d).select("movie_id", "raw_title", "genres_text"), path)
    return files.read_csv(spark, path, "movie_id bigint, raw_title string, genres_text string")


@query("src2_csv_pruned", f"WITH {RATINGS} SELECT movie_id, count(*) AS n FROM ratings GROUP BY movie_id")
def csv_pruned(spark, d):
    """SRC-2: only the needed columns of a CSV are parsed."""
    path = _path(spark, "ratings.csv")
    files.write_csv(ad.ratings(spark, d).select("user_id", "movie_id", "rating", "event_id"), path)
    return files.read_csv(spark, path, "user_id bigint, movie_id bigint, rating double, event_id bigint", ["movie_id"]).groupBy("movie_id").agg(F.count("*").alias("n"))


@query("src4_checked_csv", "SELECT CAST(user_id AS BIGINT) AS user_id, event_id FROM events WHERE event_id % 10 <> 3")
def checked_csv(spark, d):
    """SRC-4, VAL-9: strict header; rows that do not parse are set apart."""
    path = _path(spark, "checked.csv")
    bad = F.when(F.col("event_id") % 10 == 3, "x").otherwise(F.col("user_id").cast("string"))
    files.write_csv(ad.ratings(spark, d).select(bad.alias("user_id"), "event_id"), path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType())])
    return files.read_checked_csv(spark, path, schema)[0]


@query("src6_json_lines", "SELECT event_id, user_id, value FROM events")
def json_lines(spark, d):
    """SRC-5, SRC-6, SNK-3, SNK-4: JSON lines written in two appends and read back."""
    path = _path(spark, "events.jsonl")
    e = ad.load(spark, d, "events").select("event_id", "user_id", "value")
    files.write_json_lines(e.where("event_id % 2 = 0"), path)
    files.write_json_lines(e.where("event_id % 2 = 1"), path, append=True)
    return files.read_json_lines(spark, path, "event_id bigint, user_id bigint, value double")


@query("src7_user_sequences", f"WITH {RATINGS} SELECT user_id, event_id, movie_id, rating FROM ratings")
def user_sequences(spark, d):
    """SRC-7, SRC-8: one nested JSON record for each user, read and flattened again."""
    path = _path(spark, "sequences.jsonl")
    r = ad.ratings(spark, d)
    files.write_json_lines(r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "movie_id", "rating"))).alias("ratings")), path)
    back = files.read_json_lines(spark, path, "user_id bigint, ratings array<struct<event_id:bigint,movie_id:bigint,rating:double>>")
    return back.select("user_id", F.inline("ratings"))


CONTRACT = """
name: catalogue
columns:
  - {name: movie_id, physical_type: int64, nullable: false}
  - {name: title, physical_type: string, nullable: false}
  - {name: year, physical_type: int64, nullable: true}
  - {name: price, physical_type: float64, nullable: false}
constraints:
  - {type: unique, column: title}
  - {type: non_negative, column: price}
  - {type: range, column: year, min: 1955, max: 1990}
"""


@query("src10_required_columns", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def required_columns(spark, d):
    """SRC-10, SNK-6: a bundle of parallel columns with a check of the required ones."""
    return files.require(ad.load(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.size("embedding").cast("bigint").alias("dim"))


@query("src13_vocabulary_map", f"WITH {RATINGS} SELECT movie_id, row_number() OVER (ORDER BY movie_id) AS item_idx FROM (SELECT DISTINCT movie_id FROM ratings WHERE movie_id % 10 <> 7)")
def vocabulary_map(spark, d):
    """SRC-13, SET-7: distinct items in order, numbered from 1; 0 is padding."""
    from ..operators.sequences import vocabulary

    return vocabulary(ad.ratings(spark, d).where(ad.known()))


@query("snk5_by_extension", "SELECT movie_id, n FROM (SELECT p_partkey AS movie_id FROM part), (VALUES (1), (2), (3)) t(n)")
def by_extension(spark, d):
    """SNK-5, SNK-7: one frame in three formats; writing replaces what was there."""
    m = ad.movies(spark, d).select("movie_id")
    out = None
    for n, ext in enumerate(("parquet", "csv", "jsonl"), 1):
        path = _path(spark, f"frame.{ext}")
        files.write_frame(m.limit(1), path)
        files.write_frame(m, path)
        back = spark.read.parquet(path) if ext == "parquet" else files.read_csv(spark, path, "movie_id bigint") if ext == "csv" else files.read_json_lines(spark, path, "movie_id bigint")
        back = back.withColumn("n", F.lit(n))
        out = back if out is None else out.unionByName(back)
    return out


@query("str1_title_year", f"WITH {PARSED} SELECT movie_id, title, year, mode FROM parsed")
def title_year(spark, d):
    """STR-1, STR-2: titles split from their years."""
    return cl.parsed(ad.movies(spark, d)).drop("genres")


@query("str3_genres", f"WITH {PARSED} SELECT movie_id, unnest(genres) AS genre, generate_subscripts(genres, 1) - 1 AS place FROM parsed")
def genre_list(spark, d):
    """STR-3, STR-4, ARR-3: genres in order, one row each."""
    return cl.parsed(ad.movies(spark, d)).select("movie_id", F.posexplode("genres").alias("place", "genre")).withColumn("place", F.col("place").cast("bigint"))


@query(
    "str5_text_forms",
    """SELECT p_partkey AS movie_id, lower(regexp_replace(trim('  ' || p_type || '   ' || p_name || ' '), '\\s+', ' ', 'g')) AS tag,
         trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
         '[' || p_size || ', ' || p_partkey || ']' AS listed, printf('%.1f%%', 100.0 * p_size / 50) AS percent FROM part""".replace("\\\\", "\\"),
)
def text_forms(spark, d):
    """STR-5, STR-7, STR-8, ARR-2: normal tags, slugs, list and percent texts."""
    p = ad.load(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("movie_id"),
        txt.tag_text(F.concat(F.lit("  "), "p_type", F.lit("   "), "p_name", F.lit(" "))).alias("tag"),
        txt.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"),
        txt.list_text(F.array(F.col("p_size").cast("bigint"), "p_partkey")).alias("listed"),
        F.format_string("%.1f%%", F.lit(100.0) * F.col("p_size") / 50).alias("percent"),
    )


@query(
    "dat1_times",
    """SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(date_trunc('second', ts)) AS back,
         CAST(year(ts) AS BIGINT) AS y, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%dT%H') AS hour,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS days,
         CAST(CAST(ts AS DATE) - INTERVAL 730 DAY AS DATE) AS two_years_before
       FROM events""",
)
def times(spark, d):
    """DAT-1 to DAT-6, STR-6: epoch to ISO and back, prefixes and calendar arithmetic."""
    r = ad.ratings(spark, d).withColumn("whole", F.floor("ts_s").cast("bigint"))
    text = num.iso(F.col("whole"))
    return r.select(
        "event_id",
        text.alias("iso"),
        num.epoch(text).alias("back"),
        F.year("ts").cast("bigint").alias("y"),
        F.substring(text, 1, 7).alias("month"),
        F.substring(text, 1, 13).alias("hour"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"),
        F.date_sub(F.to_date("ts"), 730).alias("two_years_before"),
    )


@query("mth3_half_even", f"WITH {SUMMARY} SELECT * FROM summary")
def half_even(spark, d):
    """MTH-3, AGG-1: means to two digits, halves to even."""
    return cl.rating_summary(ad.stars(spark, d))


@query(
    "arr1_multi_hot",
    f"WITH {PARSED} SELECT movie_id, array_to_string(list_transform(['small','large','ring','bolt','ECONOMY','PROMO'], lambda g: CASE WHEN list_contains(genres, g) THEN 1 ELSE 0 END), ',') AS flags FROM parsed",
)
def multi_hot(spark, d):
    """ARR-1, ARR-4: a genre vector against a fixed list."""
    names = ["small", "large", "ring", "bolt", "ECONOMY", "PROMO"]
    return cl.parsed(ad.movies(spark, d)).select("movie_id", F.array_join(txt.multi_hot(F.col("genres"), names).cast("array<string>"), ",").alias("flags"))


@query(
    "arr6_genre_vocabulary",
    f"WITH {PARSED} SELECT genre, row_number() OVER (ORDER BY genre) AS genre_idx FROM (SELECT DISTINCT unnest(genres) AS genre FROM parsed)",
)
def genre_vocabulary(spark, d):
    """ARR-6: distinct genres in order, numbered from 1."""
    from ..operators.sequences import numbered

    return numbered(cl.parsed(ad.movies(spark, d)).select(F.explode("genres").alias("genre")).distinct(), "genre", "genre_idx")


@query("jsn1_lists", "SELECT p_partkey AS movie_id, to_json(string_split(p_name, ' ')) AS text, len(string_split(p_name, ' ')) AS n, p_partkey % 5 <> 0 AS valid FROM part")
def json_lists(spark, d):
    """JSN-1 to JSN-4: lists to JSON and back; what is no list is null and counted."""
    names = F.split("p_name", " ")
    t = ad.load(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), F.to_json(names).alias("text"))
    broken = F.when(F.col("movie_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("text"))
    return t.select("movie_id", "text", F.size(txt.json_list(F.col("text"))).cast("bigint").alias("n"), txt.json_list(broken).isNotNull().alias("valid"))


@query(
    "hsh1_signatures",
    "SELECT event_id, sha1(concat_ws(':', event_id, user_id, props)) AS signature, 'run:' || user_id || ':' || substr(sha1(props), 1, 12) AS request FROM events",
)
def signatures(spark, d):
    """HSH-1, HSH-2: signatures by which changes are noticed, and request ids."""
    e = ad.load(spark, d, "events")
    return e.select("event_id", F.sha1(F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "props")).alias("signature"), F.concat_ws(":", F.lit("run"), F.col("user_id").cast("string"), F.substring(F.sha1("props"), 1, 12)).alias("request"))


CATALOGUE = PARSED + ", " + RATINGS + ", " + STARS + """,
summary AS (SELECT movie_id, round_even(avg(rating) * 100, 0) / 100 AS rating_avg, count(*) AS rating_count FROM stars GROUP BY movie_id),
links AS (SELECT p_partkey AS movie_id, CASE WHEN p_size % 3 > 0 THEN p_size END AS imdb_id, CASE WHEN p_size % 4 > 0 THEN p_size END AS tmdb_id
          FROM part WHERE p_partkey % 6 > 0),
tagged AS (SELECT l_partkey AS movie_id, l_returnflag || l_linestatus AS tag, min(l_shipdate) AS shipped FROM lineitem WHERE l_partkey % 9 > 0 GROUP BY ALL),
taglists AS (SELECT movie_id, list(tag ORDER BY shipped, tag) AS tags, count(*) AS tag_count FROM tagged GROUP BY movie_id),
catalogue AS (
  SELECT p.movie_id, title, year, mode, genres, coalesce(tags, []) AS tags, coalesce(tag_count, 0) AS tag_count,
         l.movie_id IS NOT NULL AS has_links, imdb_id, tmdb_id, s.movie_id IS NOT NULL AS has_ratings, rating_avg,
         coalesce(rating_count, 0) AS rating_count
  FROM parsed p LEFT JOIN taglists t USING (movie_id) LEFT JOIN links l ON l.movie_id = p.movie_id LEFT JOIN summary s ON s.movie_id = p.movie_id)"""


def catalogue_of(spark, d):
    p = ad.load(spark, d, "part")
    odd = lambda k: F.when(F.col("p_size") % k > 0, F.col("p_size"))
    links = p.where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("movie_id"), odd(3).alias("imdb_id"), odd(4).alias("tmdb_id"))
    tags = cl.ordered_tags(ad.tags(spark, d).where("movie_id % 9 > 0"), F.col("at"))
    return cl.joined(cl.parsed(ad.movies(spark, d)), tags, links, cl.rating_summary(ad.stars(spark, d)))


@query("join1_catalogue", f"WITH {CATALOGUE} SELECT movie_id, title, year, array_to_string(genres, '|') AS genres, array_to_string(tags, '|') AS tags, tag_count, has_links, imdb_id, tmdb_id, has_ratings, rating_avg, rating_count FROM catalogue")
def catalogue(spark, d):
    """JOIN-1, PRJ-1 to PRJ-5, AGG-2: the catalogue with tags, links and ratings."""
    c = catalogue_of(spark, d)
    return c.withColumns({"genres": F.array_join("genres", "|"), "tags": F.array_join("tags", "|")}).drop("mode")


FLAGGED = CATALOGUE + """,
flagged AS (
  SELECT *, rating_count = 0 AS no_ratings, len(genres) = 0 AS no_genres, year IS NULL AS no_year FROM catalogue),
kept AS (SELECT * FROM flagged WHERE NOT (no_ratings OR no_genres OR no_year)),
why AS (
  SELECT movie_id, list_filter([CASE WHEN no_genres THEN 'no_genres' END, CASE WHEN no_ratings THEN 'no_ratings' END, CASE WHEN no_year THEN 'no_year' END], lambda x: x IS NOT NULL) AS reasons
  FROM flagged WHERE no_ratings OR no_genres OR no_year)"""


@query("flt2_drop_flags", f"WITH {FLAGGED} SELECT movie_id, no_ratings, no_genres, no_year, no_ratings OR no_genres OR no_year AS dropped FROM flagged")
def drop_flags(spark, d):
    """FLT-1 to FLT-3: quality flags, and their union."""
    return cl.drop_flags(catalogue_of(spark, d)).select("movie_id", "no_ratings", "no_genres", "no_year", "dropped")


@query("join2_kept_ratings", f"WITH {FLAGGED} SELECT event_id, movie_id, rating FROM ratings WHERE movie_id IN (SELECT movie_id FROM kept)")
def kept_ratings(spark, d):
    """JOIN-2, FLT-9: ratings of the kept movies."""
    kept = cl.drop_flags(catalogue_of(spark, d)).where("not dropped")
    return cl.kept_ratings(ad.ratings(spark, d), kept).select("event_id", "movie_id", "rating")


@query(
    "join3_dropped_ratings",
    f"WITH {FLAGGED} SELECT event_id, r.movie_id, array_to_string(reasons, '|') AS reasons FROM ratings r LEFT JOIN why USING (movie_id) WHERE r.movie_id NOT IN (SELECT movie_id FROM kept)",
)
def dropped_ratings(spark, d):
    """JOIN-3, JOIN-4: the other ratings, with the reasons."""
    flagged = cl.drop_flags(catalogue_of(spark, d))
    out = cl.dropped_ratings(ad.ratings(spark, d), flagged.where("not dropped"), cl.reasons(flagged))
    return out.select("event_id", "movie_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "set5_fallback_reasons",
    f"WITH {FLAGGED} SELECT movie_id, array_to_string(reasons, '|') AS reasons FROM why UNION ALL SELECT p_partkey, 'unlisted' FROM part WHERE p_size > 40 AND p_partkey NOT IN (SELECT movie_id FROM why)",
)
def fallback_reasons(spark, d):
    """SET-5: a second source of reasons where the first has none."""
    why = cl.reasons(cl.drop_flags(catalogue_of(spark, d)))
    more = ad.load(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("movie_id"), F.array(F.lit("unlisted")).alias("reasons"))
    return cl.with_fallback(why, more).select("movie_id", F.array_join("reasons", "|").alias("reasons"))


@query("agg3_reason_lists", f"WITH {FLAGGED} SELECT genre, array_to_string(list_sort(list(DISTINCT r)), '|') AS reasons FROM (SELECT genres[1] AS genre, unnest(reasons) AS r FROM why JOIN flagged USING (movie_id)) GROUP BY genre")
def reason_lists(spark, d):
    """AGG-3: sorted distinct reasons by leading genre."""
    flagged = cl.drop_flags(catalogue_of(spark, d))
    rows = cl.reasons(flagged).join(flagged.select("movie_id", F.col("genres")[0].alias("genre")), "movie_id").select("genre", F.explode("reasons").alias("r"))
    return rows.groupBy("genre").agg(F.array_join(F.array_sort(F.collect_set("r")), "|").alias("reasons"))


@query(
    "agg5_reason_totals",
    f"""WITH {FLAGGED}, x AS (SELECT r.*, reasons FROM ratings r LEFT JOIN why USING (movie_id) WHERE r.movie_id NOT IN (SELECT movie_id FROM kept))
    SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies,
           coalesce(sum(CAST(list_contains(reasons, 'no_year') AS BIGINT)), 0) AS no_year, coalesce(sum(CAST(list_contains(reasons, 'no_genres') AS BIGINT)), 0) AS no_genres FROM x""",
)
def reason_totals(spark, d):
    """AGG-4, AGG-5: one pass of counts; null lists count for nothing."""
    flagged = cl.drop_flags(catalogue_of(spark, d))
    x = cl.dropped_ratings(ad.ratings(spark, d), flagged.where("not dropped"), cl.reasons(flagged))
    has = lambda r: F.coalesce(F.sum(F.array_contains("reasons", r).cast("bigint")), F.lit(0)).alias(r)
    return x.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("movies"), has("no_year"), has("no_genres"))


@query(
    "agg6_by_reason_list",
    f"WITH {FLAGGED} SELECT coalesce(array_to_string(reasons, '|'), 'unknown') AS reasons, count(*) AS n, count(DISTINCT user_id) AS users FROM ratings r LEFT JOIN why USING (movie_id) WHERE r.movie_id NOT IN (SELECT movie_id FROM kept) GROUP BY 1",
)
def by_reason_list(spark, d):
    """AGG-6: grouped by the whole list; null is a group of its own."""
    flagged = cl.drop_flags(catalogue_of(spark, d))
    x = cl.dropped_ratings(ad.ratings(spark, d), flagged.where("not dropped"), cl.reasons(flagged))
    out = x.groupBy("reasons").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select(F.coalesce(F.array_join("reasons", "|"), F.lit("unknown")).alias("reasons"), "n", "users").orderBy(F.desc("n"), "reasons")


@query("agg7_issue_combinations", f"WITH {FLAGGED} SELECT array_to_string(reasons, '+') AS combination, len(reasons) AS size, count(*) AS n FROM why GROUP BY ALL")
def issue_combinations(spark, d):
    """AGG-7: movies by combination of reasons."""
    why = cl.reasons(cl.drop_flags(catalogue_of(spark, d)))
    return why.groupBy("reasons").agg(F.count("*").alias("n")).select(F.array_join("reasons", "+").alias("combination"), F.size("reasons").cast("bigint").alias("size"), "n").orderBy("size", "combination")


ISSUED = CATALOGUE + """,
issued AS (
  SELECT movie_id, unnest(list_filter([
    CASE WHEN title IS NULL OR trim(title) = '' THEN 'blank_title_after_parse' END, CASE WHEN mode = 'relaxed' THEN 'relaxed_title_year_match' END,
    CASE WHEN year IS NULL THEN 'title_without_year' END, CASE WHEN len(genres) = 0 THEN 'missing_genres' END,
    CASE WHEN len(tags) = 0 THEN 'missing_tags' END, CASE WHEN NOT has_links THEN 'missing_links_row' END,
    CASE WHEN has_links AND imdb_id IS NULL THEN 'missing_imdb_id' END, CASE WHEN has_links AND tmdb_id IS NULL THEN 'missing_tmdb_id' END,
    CASE WHEN NOT has_ratings THEN 'missing_ratings' END], lambda x: x IS NOT NULL)) AS issue FROM catalogue)"""


@query("val8_issues", f"WITH {ISSUED} SELECT movie_id, issue, CASE issue WHEN 'blank_title_after_parse' THEN 'error' WHEN 'relaxed_title_year_match' THEN 'info' WHEN 'missing_tags' THEN 'info' ELSE 'warning' END AS severity, 'movie ' || movie_id || ': ' || issue AS details FROM issued")
def issue_rows(spark, d):
    """VAL-8, SET-1, PRJ-6: data-quality issues, one row each."""
    return cl.issues(catalogue_of(spark, d))


@query("agg8_issue_samples", f"WITH {ISSUED} SELECT issue, count(*) AS n, array_to_string(list_sort(list(DISTINCT movie_id))[1:20], ',') AS sample FROM issued GROUP BY issue")
def issue_samples(spark, d):
    """AGG-8, SNK-8: issues with the first twenty ids (a report's sample)."""
    i = cl.issues(catalogue_of(spark, d))
    # ranked in the window, so no list of all ids is built
    from pyspark.sql import Window

    one = i.groupBy("issue", "movie_id").agg(F.count("*").alias("c"))
    first = one.withColumn("k", F.row_number().over(Window.partitionBy("issue").orderBy("movie_id"))).where("k <= 20")
    ids = first.groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list("movie_id")).cast("array<string>"), ",").alias("sample"))
    return one.groupBy("issue").agg(F.sum("c").alias("n")).join(ids, "issue")


@query(
    "set2_orphans",
    "SELECT 'ratings' AS side, movie_id FROM (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) * 3 AS movie_id FROM events) WHERE movie_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'tags', movie_id FROM (SELECT DISTINCT l_partkey AS movie_id FROM lineitem) WHERE movie_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
)
def orphans(spark, d):
    """SET-2: ids that the catalogue lacks, by source."""
    m = ad.movies(spark, d).where("p_size > 5")
    r = cl.orphans(ad.ratings(spark, d).select((F.col("movie_id") * 3).alias("movie_id")), m).withColumn("side", F.lit("ratings"))
    return r.unionByName(cl.orphans(ad.tags(spark, d), m).withColumn("side", F.lit("tags")))


@query("set3_overlap", f"WITH {RATINGS}, x AS (SELECT movie_id FROM ratings INTERSECT SELECT vec_id FROM embeddings WHERE label < 5) SELECT count(*) AS shared, (SELECT count(DISTINCT movie_id) FROM ratings) AS rated FROM x")
def overlap(spark, d):
    """SET-3: how many items two sources share."""
    r = ad.ratings(spark, d).select("movie_id").distinct()
    shared = r.intersect(ad.items(spark, d).where("label < 5").select("movie_id"))
    return shared.agg(F.count("*").alias("shared")).crossJoin(r.agg(F.count("*").alias("rated")))  # two single rows


@query("set4_user_union", f"WITH {RATINGS} SELECT user_id FROM ratings WHERE rating > 90 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def user_union(spark, d):
    """SET-4, SET-9: users of three stores, once each."""
    r = ad.ratings(spark, d).where("rating > 90").select("user_id")
    o = ad.load(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id"))
    c = ad.load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return r.union(o).union(c).distinct()


@query(
    "set6_id_sets",
    f"WITH {RATINGS} SELECT user_id, array_to_string(list_sort(list(DISTINCT event_id) FILTER (rating < 20)), ',') AS pending, array_to_string(list_sort(list(DISTINCT event_id) FILTER (rating >= 20 AND rating < 30)), ',') AS processed FROM ratings GROUP BY user_id",
)
def id_sets(spark, d):
    """SET-6, SET-8: sorted unique id sets; processed = those below 30 without the pending ones."""
    g = ad.ratings(spark, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("rating") < 20, F.col("event_id"))).alias("p"), F.collect_set(F.when(F.col("rating") < 30, F.col("event_id"))).alias("q"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c).cast("array<string>"), ","))
    return g.select("user_id", text(F.col("p")).alias("pending"), text(F.array_except("q", "p")).alias("processed"))


@query("join5_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def duplicates(spark, d):
    """JOIN-5, VAL-4: all rows that share a key, in one pass."""
    c = val.Contract("lines", T.StructType([]), unique=[["l_orderkey", "l_linenumber"]])
    return val.violations(ad.load(spark, d, "lineitem"), c).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "val3_violations",
    f"""WITH {PARSED}, c AS (SELECT movie_id, title, year, CASE WHEN movie_id % 11 = 0 THEN -p_price ELSE p_price END AS price
        FROM (SELECT movie_id, title, year FROM parsed) JOIN (SELECT p_partkey AS movie_id, p_retailprice AS p_price FROM part WHERE p_partkey % 13 > 0) USING (movie_id)
        UNION ALL SELECT movie_id, title, year, NULL FROM parsed WHERE movie_id % 13 = 0),
    v AS (SELECT movie_id, list_filter([CASE WHEN price IS NULL THEN 'null:price' END, CASE WHEN price < 0 THEN 'negative:price' END,
        CASE WHEN year < 1955 OR year > 1990 THEN 'range:year' END, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN 'duplicate:title' END], lambda x: x IS NOT NULL) AS v FROM c)
    SELECT movie_id, array_to_string(v, '|') AS violations FROM v WHERE len(v) > 0""",
)
def violations(spark, d):
    """VAL-1 to VAL-7: a catalogue against its contract, every broken constraint of each row."""
    price = F.when(F.col("movie_id") % 13 == 0, F.lit(None)).when(F.col("movie_id") % 11 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
    c = ad.movies(spark, d).select("movie_id", txt.title_year(F.col("raw_title")).alias("t"), price.alias("price")).select("movie_id", "t.title", "t.year", "price")
    return val.violations(c, files.contract(CONTRACT)).select("movie_id", F.array_join("violations", "|").alias("violations"))


@query(
    "agg9_user_records",
    f"WITH {RATINGS} SELECT user_id, count(*) AS rating_count, min(ts_s) AS first_s, max(ts_s) AS last_s, array_to_string(list(movie_id ORDER BY ts_s, movie_id, rating), ',') AS movies FROM ratings GROUP BY user_id",
)
def user_records(spark, d):
    """AGG-9: a record for each user: ordered list, number, first and last."""
    u = cl.user_records(ad.ratings(spark, d))
    return u.select("user_id", F.col("rating_count").cast("bigint").alias("rating_count"), "first_s", "last_s", F.array_join(F.transform("ratings", lambda x: x["movie_id"].cast("string")), ",").alias("movies"))


@query(
    "agg10_record_totals",
    f"WITH {RATINGS}, u AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id) SELECT count(*) AS users, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, sum(n) = (SELECT count(*) FROM ratings) AND count(*) > 0 AS reconciled FROM u",
)
def record_totals(spark, d):
    """AGG-10, VAL-10: totals over the records, checked against the input."""
    r = ad.ratings(spark, d)
    u = r.groupBy("user_id").agg(F.count("*").alias("n"))
    t = u.agg(F.count("*").alias("users"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return t.crossJoin(r.agg(F.count("*").alias("rows"))).select("users", "least", "most", "total", ((F.col("total") == F.col("rows")) & (F.col("users") > 0)).alias("reconciled"))  # two single rows


@query("srt3_order_check", f"WITH {RATINGS} SELECT user_id, count(*) AS regressions FROM (SELECT user_id, ts_s, lag(ts_s) OVER (PARTITION BY user_id ORDER BY rating, event_id) AS before FROM ratings) WHERE before > ts_s GROUP BY user_id")
def order_check(spark, d):
    """SRT-3: rows that come before their predecessor, here in an input sorted by rating."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("rating", "event_id")
    r = ad.ratings(spark, d).withColumn("before", F.lag("ts_s").over(w))
    return r.where("before > ts_s").groupBy("user_id").agg(F.count("*").alias("regressions"))
