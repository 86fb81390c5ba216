"""Replay: the ordered event log, the trace clock, ingestion as a stream, and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import even, iso
from ..operators.sequences import numbered

EVENT = "replay_order bigint, user_seq bigint, event_id bigint, user_id bigint, movie_id bigint, rating double, rated_at string, ts_s double"


def event_log(ratings: DataFrame, first_s: float, last_s: float, users: int | None = None, most: int | None = None) -> DataFrame:
    """The replay log: users admitted before the time range is applied, both ends inclusive, ordered by
    (ts, user, movie, event) and numbered densely from 0, over all and by user (user_seq); event ids keep their gaps."""
    if users is not None:
        first = ratings.groupBy("user_id").agg(F.min("event_id").alias("_first")).orderBy("_first").limit(users)
        ratings = ratings.join(first, "user_id", "left_semi")
    rows = ratings.where(F.col("ts_s").between(first_s, last_s))
    log = numbered(rows.select("event_id", "user_id", "movie_id", "rating", "ts_s"), ["ts_s", "user_id", "movie_id", "event_id"], "replay_order", start=0)
    log = log.where(F.col("replay_order") < most) if most is not None else log
    by_user = Window.partitionBy("user_id").orderBy("replay_order")
    log = log.withColumn("user_seq", F.row_number().over(by_user).cast("bigint") - 1)
    return log.withColumn("rated_at", iso(F.floor("ts_s").cast("bigint"))).select(*(c.split()[0] for c in EVENT.split(", ")))


def user_log(ratings: DataFrame) -> DataFrame:
    """The log by user only, as a fold takes it: user_seq as in event_log(), without numbers over all users, which need a
    sort of the whole table. A user's rows are in one partition."""
    rows = ratings.where("user_id is not null").select("event_id", "user_id", "movie_id", "rating", "ts_s")
    by_user = Window.partitionBy("user_id").orderBy("ts_s", "movie_id", "event_id")
    return rows.withColumn("user_seq", F.row_number().over(by_user).cast("bigint") - 1)


def write_log(log: DataFrame, path: str, files: int, append: bool = False) -> None:
    """The log as JSON lines in files of consecutive events, one micro-batch each.

    The files are written side by side, so a stream may read them in any order; user_seq tells it
    what to wait for.
    """
    log.repartitionByRange(files, "replay_order").sortWithinPartitions("replay_order").write.mode("append" if append else "overwrite").json(path)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(path)


def scheduled(log: DataFrame, speed: float, service_s: float) -> DataFrame:
    """The trace clock: when each event is due at so many times the speed, when a server that takes
    service_s for each emits it, and whether it is more than a millisecond late.

    done = max(due, done before) + service: the largest over earlier events of
    due_j + (i - j + 1) * service, a running maximum of due - place * service.
    """
    if speed <= 0:
        raise ValueError("speed must be positive")
    start = log.agg(F.min("ts_s")).first()[0]
    due = (F.col("ts_s") - F.lit(start)) / speed
    base = log.withColumn("due_s", due).withColumn("_lead", F.col("due_s") - F.col("replay_order") * service_s)
    # running maximum in ranges of the order, then the maximum of the ranges before
    size = 100_000
    parts = base.withColumn("_part", F.floor(F.col("replay_order") / size))
    tops = parts.groupBy("_part").agg(F.max("_lead").alias("_top"))
    before = tops.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each range
    own = F.max("_lead").over(Window.partitionBy("_part").orderBy("replay_order"))
    emitted = F.greatest(F.col("_own"), F.coalesce("_before", F.lit(float("-inf")))) + F.col("replay_order") * service_s
    out = parts.withColumn("_own", own).join(before, "_part").withColumn("emitted_s", emitted)
    lag = F.col("emitted_s") - F.col("due_s")
    return out.select("replay_order", "event_id", "user_id", "due_s", "emitted_s", lag.alias("lag_s"), (lag > 0.001).alias("behind"))


def run_summary(progress: DataFrame, speed: float, span_s: float) -> DataFrame:
    """One row for a run: events, target and actual rate, mean and largest lag, events behind."""
    a = progress.agg(F.count("*").alias("events"), F.max("emitted_s").alias("elapsed_s"), F.avg("lag_s").alias("mean_lag_s"), F.max("lag_s").alias("max_lag_s"), F.count_if("behind").alias("behind"))
    return a.select("events", even(F.col("events") * F.lit(speed) / F.lit(span_s)).alias("target_eps"), even(F.col("events") / F.col("elapsed_s")).alias("actual_eps"), even(F.col("mean_lag_s")).alias("mean_lag_s"), even(F.col("max_lag_s")).alias("max_lag_s"), "behind")


def run_stream(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of records to its end into Parquet, and return what it wrote."""
    q = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return events.sparkSession.read.schema(events.schema).parquet(path)
