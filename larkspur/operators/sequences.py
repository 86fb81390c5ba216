"""User sequences: positives, event numbers, context and training windows, splits."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def numbered(df: DataFrame, order: str | list[str], name: str, start: int = 1) -> DataFrame:
    """df with a dense global number in an order, without one task that holds all rows.

    Ranges of the order are sorted apart; a row's number is its place in the range plus the rows of
    the ranges before. The sorted rows are written once, so that the two readings agree.
    """
    keys = [order] if isinstance(order, str) else order
    spark = df.sparkSession
    path = f"{scratch(spark)}/numbered-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": place}).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # a row for each range
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_start") + start).drop("_part", "_at", "_start")


def running(df: DataFrame, order: str, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the running sum of a column in an order, over all or by group; no task holds all rows.

    As numbered(): sums within ranges of the order, and the sums of the ranges before. The order's
    values should be distinct, so that no range holds most rows.
    """
    by, spark = by or [], df.sparkSession
    path = f"{scratch(spark)}/running-{uuid.uuid4().hex}"
    df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.groupBy("_part", *by).agg(F.sum(value).alias("_n"))
    # a row for each range, or for each range of a group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", *by, before.alias("_start"))
    own = F.sum(value).over(Window.partitionBy("_part", *by).orderBy(order))
    return rows.withColumn("_own", own).join(starts, ["_part", *by]).withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")


def vocabulary(rows: DataFrame, item: str = "movie_id") -> DataFrame:
    """(item, item_idx): distinct items in order, from 1; 0 is padding."""
    return numbered(rows.select(item).distinct(), item, "item_idx")


def exact_mean(x: str) -> Column:
    """The mean of a column of doubles as the decimals that they are written as, to 18 places; in doubles where one has no such form.

    A sum of doubles hangs on the order of its rows, so that of equal values some would exceed their mean in one run and not in another.
    """
    # up to three places, sums of whole thousandths are as exact as those of decimals
    value = F.col(x)
    whole = F.rint(value * 1000.0)
    short = (whole / 1000.0 == value) & (F.abs(whole) < 1e12)
    written = F.when(short, F.lit(None)).otherwise(value.try_cast("decimal(38,18)"))
    thousandths = F.coalesce(F.try_sum(F.when(short, whole.cast("bigint"))), F.when(F.count_if(short) == 0, F.lit(0).cast("bigint")))
    total = F.coalesce(F.try_sum(written), F.when(F.count(written) == 0, F.lit(0).cast("decimal(38,18)"))) + thousandths.cast("decimal(35,15)") * F.lit(Decimal("0.001"))
    return F.coalesce(F.when(F.count(written) + F.count_if(short) == F.count(x), (total.cast("decimal(38,18)") / F.nullif(F.count(x), F.lit(0))).cast("double")), F.avg(x))


def moments(ratings: DataFrame) -> DataFrame:
    """user_id, mean, std (population), n, first_s, last_s."""
    return ratings.groupBy("user_id").agg(exact_mean("rating").alias("mean"), F.stddev_pop("rating").alias("std"), F.count("*").alias("n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


def zscored(ratings: DataFrame) -> DataFrame:
    """ratings with mean, std, n and z = (rating - mean) / (std + 1e-8) of their user."""
    return ratings.join(moments(ratings).drop("first_s", "last_s"), "user_id").withColumn("z", (F.col("rating") - F.col("mean")) / (F.col("std") + F.lit(1e-8)))


def positive_online(z: DataFrame) -> DataFrame:
    """z with positive and reason under the online policy: few ratings or no spread make all positive."""
    reason = F.when(F.col("n") < 3, "cold_start").when(F.col("std") <= 1e-8, "zero_std").when(F.col("z") > 0, "zscore")
    shown = F.when((F.col("n") >= 3) & (F.col("std") > 1e-8), F.col("z"))
    return z.withColumns({"reason": reason, "positive": reason.isNotNull(), "shown_z": shown})


def seen_batch(z: DataFrame) -> DataFrame:
    """(user_id, movie_id) seen under the batch rule: no spread means nothing was seen."""
    return z.where((F.col("std") > 1e-8) & (F.col("z") > 0)).select("user_id", "movie_id").distinct()


BY_EVENT = ["ts_s", "movie_id", "event_id"]


def positives(ratings: DataFrame) -> DataFrame:
    """Ratings above their user's mean, with event_idx from 0 in order of (ts, movie, event)."""
    w = Window.partitionBy("user_id").orderBy(*BY_EVENT)
    return zscored(ratings).where("z > 0").withColumn("event_idx", (F.row_number().over(w) - 1).cast("bigint"))


def context_windows(events: DataFrame, known: Column, length: int) -> DataFrame:
    """For each known positive: the last `length` known items that end with it.

    event_idx counts unknown items too, so context_start_idx + history_len may leave a gap.
    """
    w = Window.partitionBy("user_id").orderBy(*BY_EVENT).rowsBetween(-(length - 1), 0)
    return events.where(known).select("user_id", "event_id", "event_idx", F.collect_list("movie_id").over(w).alias("items"), F.first("event_idx").over(w).alias("context_start_idx")).withColumn("history_len", F.size("items").cast("bigint"))


def sequences(events: DataFrame) -> DataFrame:
    """(user_id, items): each user's items in order of the events."""
    return events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*BY_EVENT))), lambda x: x["movie_id"]).alias("items"))


def sample_windows(events: DataFrame, length: int, stride: int) -> DataFrame:
    """Training windows of length + 1 items: starts 0, stride, ... below n - length; the whole
    sequence when it is no longer than one window; none for fewer than three items."""
    seq = sequences(events)
    n = F.size("items")
    starts = F.when(n <= length + 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - length - 1, F.lit(stride)))
    cut = seq.where(n >= 3).select("user_id", "items", F.explode(starts).alias("start"))
    return cut.select("user_id", F.col("start").cast("bigint").alias("start"), F.slice("items", F.col("start") + 1, length + 1).alias("items"))


def shifted(windows: DataFrame, length: int) -> DataFrame:
    """windows with input (all but the last item) and label (all but the first), left-padded with 0."""
    from ..functions.numbers import pad_left

    n = F.size("items")
    return windows.withColumns({"input": pad_left(F.slice("items", F.lit(1), n - 1), length), "label": pad_left(F.slice("items", F.lit(2), n - 1), length)})


def eligible(ratings: DataFrame, cutoff_s: float | None = None, min_days: float = 30.0, min_positives: int = 200) -> DataFrame:
    """user_id, n, positives, span_days of the users that are active and rated enough before the cutoff."""
    r = ratings if cutoff_s is None else ratings.where(F.col("ts_s") < cutoff_s)
    spans = r.groupBy("user_id").agg(((F.max("ts_s") - F.min("ts_s")) / 86400.0).alias("span_days"))
    u = zscored(r).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("z") > 0).alias("positives"))
    return u.join(spans, "user_id").where((F.col("span_days") >= min_days) & (F.col("positives") >= min_positives))


def temporal_split(rows: DataFrame, train: float = 0.8, valid: float = 0.9) -> DataFrame:
    """rows with split (train, val, test) by their place in time over the whole table."""
    placed = numbered(rows, ["ts_s", "event_id"], "place", start=0)
    n = rows.count()
    cut = F.when(F.col("place") < int(n * train), "train").when(F.col("place") < int(n * valid), "val").otherwise("test")
    return placed.withColumn("split", cut)


def split_pairs(split: DataFrame) -> DataFrame:
    """(user_id, movie_id, split): a repeated pair stands in each split that it touches; val holds
    train too, and test holds all."""
    pairs = split.select("user_id", "movie_id", "split").distinct()
    into = F.when(F.col("split") == "train", F.array(*map(F.lit, ("train", "val", "test")))).when(F.col("split") == "val", F.array(F.lit("val"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    return pairs.select("user_id", "movie_id", F.explode(into).alias("split")).distinct()


def every_nth(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """rows with ordinal (from 1 by user) and due, true at every n-th."""
    w = Window.partitionBy("user_id").orderBy(*order)
    return rows.withColumn("ordinal", F.row_number().over(w).cast("bigint")).withColumn("due", F.col("ordinal") % n == 0)
