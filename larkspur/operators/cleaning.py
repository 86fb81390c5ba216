"""Catalogue cleaning: parse, join, flag, drop, propagate to ratings, and report issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import even
from ..functions.text import genres, is_blank, strip, title_year

#: Severity of each data-quality issue, in report order.
ISSUES = {
    "blank_title_after_parse": "error",
    "relaxed_title_year_match": "info",
    "title_without_year": "warning",
    "missing_genres": "warning",
    "missing_tags": "info",
    "missing_links_row": "warning",
    "missing_imdb_id": "warning",
    "missing_tmdb_id": "warning",
    "missing_ratings": "warning",
}


def parsed(movies: DataFrame) -> DataFrame:
    """movie_id, title, year, mode, genres from raw_title and genres_text."""
    return movies.select("movie_id", title_year(F.col("raw_title")).alias("t"), genres(F.col("genres_text")).alias("genres")).select("movie_id", "t.title", "t.year", "t.mode", "genres")


def ordered_tags(tags: DataFrame, *order: Column) -> DataFrame:
    """movie_id, tags (distinct, in order of first appearance), tag_count."""
    first = tags.select("movie_id", strip(F.col("tag")).alias("tag"), F.struct(*order).alias("_at")).where(F.col("tag") != "").groupBy("movie_id", "tag").agg(F.min("_at").alias("_at"))
    lists = first.groupBy("movie_id").agg(F.array_sort(F.collect_list(F.struct("_at", "tag"))).alias("l"))
    return lists.select("movie_id", F.transform("l", lambda x: x["tag"]).alias("tags"), F.size("l").alias("tag_count"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    """movie_id, rating_avg (two digits, half to even), rating_count."""
    return ratings.groupBy("movie_id").agg(even(F.avg("rating"), 2).alias("rating_avg"), F.count("*").alias("rating_count"))


def joined(movies: DataFrame, tags: DataFrame, links: DataFrame, summary: DataFrame) -> DataFrame:
    """The catalogue with tags, links and ratings; defaults where a side is missing, and marks of it."""
    marked = lambda df, mark: df.withColumn(mark, F.lit(True))
    out = movies.join(tags, "movie_id", "left").join(marked(links, "has_links"), "movie_id", "left").join(marked(summary, "has_ratings"), "movie_id", "left")
    return out.withColumns(
        {
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "tag_count": F.coalesce("tag_count", F.lit(0)).cast("bigint"),
            "rating_count": F.coalesce("rating_count", F.lit(0)).cast("bigint"),
            "has_links": F.coalesce("has_links", F.lit(False)),
            "has_ratings": F.coalesce("has_ratings", F.lit(False)),
        }
    )


def drop_flags(movies: DataFrame) -> DataFrame:
    """movies with no_ratings, no_genres, no_year and dropped; an unknown flag counts as false."""
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = {"no_ratings": no(F.col("rating_count") == 0), "no_genres": no(F.size("genres") == 0), "no_year": F.col("year").isNull()}
    return movies.withColumns(flags).withColumn("dropped", F.col("no_ratings") | F.col("no_genres") | F.col("no_year"))


def reasons(flagged: DataFrame) -> DataFrame:
    """movie_id, reasons (sorted) of the dropped movies."""
    names = F.array(*(F.when(F.col(c), c) for c in ("no_genres", "no_ratings", "no_year")))
    return flagged.where("dropped").select("movie_id", F.array_compact(names).alias("reasons"))


def kept_ratings(ratings: DataFrame, kept: DataFrame) -> DataFrame:
    return ratings.join(kept.select("movie_id"), "movie_id", "left_semi")


def dropped_ratings(ratings: DataFrame, kept: DataFrame, why: DataFrame) -> DataFrame:
    """Ratings of movies that were not kept, with the reasons; null where the movie is unknown."""
    return ratings.join(kept.select("movie_id"), "movie_id", "left_anti").join(why, "movie_id", "left")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of first, and those of second whose movie first does not have."""
    return first.unionByName(second.join(first.select("movie_id"), "movie_id", "left_anti"))


def issues(catalogue: DataFrame) -> DataFrame:
    """One row for each movie and issue, from one pass over the joined catalogue."""
    tests = {
        "blank_title_after_parse": is_blank(F.col("title")),
        "relaxed_title_year_match": F.col("mode") == "relaxed",
        "title_without_year": F.col("year").isNull(),
        "missing_genres": F.size("genres") == 0,
        "missing_tags": F.size("tags") == 0,
        "missing_links_row": ~F.col("has_links"),
        "missing_imdb_id": F.col("has_links") & F.col("imdb_id").isNull(),
        "missing_tmdb_id": F.col("has_links") & F.col("tmdb_id").isNull(),
        "missing_ratings": ~F.col("has_ratings"),
    }
    names = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items())))
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in ISSUES.items() for x in kv)), F.col("issue"))
    return catalogue.select("movie_id", F.explode(names).alias("issue")).withColumn("severity", severity).withColumn("details", F.format_string("movie %d: %s", "movie_id", "issue"))


def orphans(side: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct movie ids of a side table that the catalogue lacks."""
    return side.select("movie_id").distinct().join(movies.select("movie_id"), "movie_id", "left_anti")


def user_records(ratings: DataFrame) -> DataFrame:
    """One row for each user: ratings as an ordered list, their number, first and last."""
    lists = ratings.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts_s", "movie_id", "rating"))).alias("ratings"))
    return lists.select("user_id", "ratings", F.size("ratings").alias("rating_count"), F.element_at("ratings", 1)["ts_s"].alias("first_s"), F.element_at("ratings", -1)["ts_s"].alias("last_s"))


def out_of_order(rows: DataFrame, position: str) -> DataFrame:
    """Rows that come before their predecessor in (user_id, ts_s, movie_id); none in a sorted input."""
    from pyspark.sql import Window

    key = F.struct("user_id", "ts_s", "movie_id")
    # neighbours within ranges of the position, and the first of each range against the last before it
    w = Window.partitionBy("user_id").orderBy(position)
    return rows.withColumn("_before", F.lag(key).over(w)).where(F.col("_before") > key).drop("_before")
