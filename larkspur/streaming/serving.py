"""Point queries over tables laid out by user, kept up epoch by epoch from the fold's history.

What an epoch of the history adds is laid out in a part of its own: folders by bucket of users, rows in order of user and
place. A repeated epoch replaces its part. A lookup reads the folders of the user's bucket and, of their files, the row groups
that may hold the user; what one event shows lies in one epoch, so no state is folded again. Many small
parts are merged by publishing their epochs together to another base.

A user or event that the tables do not have gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import compact

#: Columns of the tables; the last named is their order within a user.
TABLES = {
    "timeline": ("user_id bigint, event_id bigint, replay_order bigint, batch bigint, refit bigint, k_count bigint, noise bigint, assigned bigint", "replay_order"),
    "spells": ("user_id bigint, batch bigint, refit bigint, raw_id bigint, kind string, label bigint, from_order bigint, to_order bigint", "from_order"),
    "recommended": ("user_id bigint, event_id bigint, rank bigint, movie_id bigint, score double", "event_id"),
}


class Serving:
    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def put(self, rows: DataFrame, name: str, part: int) -> None:
        schema, order = TABLES[name]
        columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]
        compact.lay_out(rows.select(*columns), f"{self.base}/{name}/part={part}", "user_id", order, self.buckets)

    def publish(self, history: compact.History, part: int, epochs: list[int] | None = None) -> None:
        """Timeline and spells of the epochs (all, if none are named) as one part."""
        for name in ("timeline", "spells"):
            rows = history.read(name)
            if rows is not None:
                self.put((rows if epochs is None else rows.where(F.col("epoch").isin(epochs))).withColumnRenamed("epoch", "batch"), name, part)

    def table(self, name: str) -> DataFrame:
        schema = f"{TABLES[name][0]}, part int, bucket int"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def rows(self, name: str, user: int) -> DataFrame:
        here = F.col("bucket") == compact.bucket(F.lit(user).cast("bigint"), self.buckets)
        return self.table(name).where(here & (F.col("user_id") == F.lit(user))).drop("part", "bucket")

    def users(self) -> DataFrame:
        """API-1: users that have had a refit."""
        return self.table("timeline").where("refit is not null").select("user_id").distinct()

    def timeline(self, user: int) -> DataFrame:
        """API-2: a user's events in order, with cluster counts."""
        t = self.rows("timeline", user)
        return t.select("event_id", "replay_order", "refit", "k_count", "noise", "assigned", F.coalesce(F.col("refit") == F.col("replay_order"), F.lit(False)).alias("is_refit")).orderBy("replay_order")

    def points(self, user: int, event: int) -> DataFrame:
        """API-3: (raw_id, kind, label) of the points drawn after an event."""
        at = self.rows("timeline", user).where(F.col("event_id") == event).select("batch", "refit", "replay_order")
        met = self.rows("spells", user).join(F.broadcast(at), ["batch", "refit"])  # one row: the event
        return met.where("from_order <= replay_order and (to_order is null or to_order > replay_order)").select("raw_id", "kind", "label").orderBy("raw_id")

    def segment(self, user: int, refit: int) -> DataFrame:
        """API-4: (event_id, replay_order, raw_id, change, kind, label) of the segment that a refit begins: points drawn and removed at
        each of its events. Its first event draws all base points; played in order, the changes give every frame."""
        e = self.rows("timeline", user).where(F.col("refit") == refit).select("event_id", "replay_order")
        w = Window.partitionBy("raw_id").orderBy("batch", "from_order")
        s = self.rows("spells", user).where(F.col("refit") == refit).withColumn("_next", F.lead(F.struct("batch", "from_order")).over(w))
        # what an epoch found drawn when it began (place -1) is no change; a point drawn anew where it ends only changes its label
        drawn = s.where("from_order >= 0").select(F.col("from_order").alias("replay_order"), "raw_id", F.lit("drawn").alias("change"), "kind", "label")
        again = F.coalesce(F.col("_next") == F.struct("batch", F.col("to_order").alias("from_order")), F.lit(False))
        gone = s.where(F.col("to_order").isNotNull() & ~again).select(F.col("to_order").alias("replay_order"), "raw_id", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("label"))
        return e.join(drawn.unionByName(gone), "replay_order").select("event_id", "replay_order", "raw_id", "change", "kind", "label").orderBy("replay_order", "raw_id")

    def clusters(self, user: int, event: int) -> DataFrame:
        """API-5: (label, size, base, assigned) of the clusters after an event."""
        p = self.points(user, event).where("label >= 0")
        counts = (F.count_if(F.col("kind") == k).alias(k) for k in ("base", "assigned"))
        return p.groupBy("label").agg(F.count("*").alias("size"), *counts).orderBy("label")

    def recommendations(self, user: int, event: int, movies: DataFrame) -> DataFrame:
        """API-6: an event's ranked rows with their movies' columns, null where the movie is not known."""
        r = self.rows("recommended", user).where(F.col("event_id") == event).select("rank", "movie_id", "score")
        known = movies.join(F.broadcast(r.select("movie_id")), "movie_id", "left_semi")  # the ranks of one event
        return r.join(known, "movie_id", "left").orderBy("rank")

    def frame(self, user: int, event: int, movies: DataFrame) -> DataFrame:
        """API-7: one row with the event's counts, its clusters and its recommendations as lists."""
        listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("event_id", F.lit(event).cast("bigint"))
        ranked = self.recommendations(user, event, movies)
        ranked = ranked.select("rank", *(c for c in ranked.columns if c != "rank"))
        at = self.timeline(user).where(F.col("event_id") == event)
        return at.join(listed(self.clusters(user, event), "clusters"), "event_id", "left").join(listed(ranked, "recommendations"), "event_id", "left")
