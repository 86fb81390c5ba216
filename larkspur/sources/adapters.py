"""The driver tables as interaction data: ratings, catalogue, item vectors, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_of(text: str, key: str) -> Column:
    """The whole number of a key of a JSON text. A text that holds nothing else is cut, others are parsed."""
    before = f'{{"{key}": '
    cut = F.substring(text, F.lit(len(before) + 1), F.length(text) - F.lit(len(before) + 1))
    number = cut.try_cast("bigint")
    alone = F.startswith(text, F.lit(before)) & F.endswith(text, F.lit("}")) & (number.cast("string") == cut)
    return F.when(alone, number).otherwise(F.get_json_object(text, f"$.{key}").cast("bigint"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ratings: user_id, movie_id, rating, ts, ts_s (epoch seconds), event_id."""
    e = load(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")  # NTZ columns do not pass through watermarks
    return e.select(
        "user_id", number_of("props", "k").alias("movie_id"), F.col("value").alias("rating"), ts.alias("ts"), (F.unix_micros(ts) / F.lit(1e6)).alias("ts_s"), "event_id"
    )


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings on the half-star scale from 0.5 to 5."""
    return ratings(spark, sf_dir).withColumn("rating", F.least(F.lit(5.0), F.lit(0.5) + F.lit(0.5) * F.floor(F.col("rating") / 20)))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a raw catalogue: a title with or without a year, and genres joined by pipes."""
    p = load(spark, sf_dir, "part")
    title = F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")")))
    genres = F.concat_ws("|", "p_type", F.replace("p_name", F.lit(" "), F.lit("|")))
    return p.select(F.col("p_partkey").alias("movie_id"), title.alias("raw_title"), genres.alias("genres_text"), "p_size", "p_brand", "p_retailprice")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors: movie_id, vec (doubles), label."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tags of parts."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("movie_id"), F.concat("l_returnflag", "l_linestatus").alias("tag"), F.col("l_shipdate").alias("at"))


def known(movie: str = "movie_id"):
    """Whether the vocabulary holds an item: all but one in ten."""
    return F.col(movie) % 10 != 7
