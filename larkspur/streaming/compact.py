"""The fold's decisions as a history, its compact projection kept up epoch by epoch, and a layout to serve it from.

An epoch is a micro-batch. Its records go into a folder of its own, which a repeated epoch overwrites, so
nothing is counted twice. The projection reads only the new epoch and, of its users, the points that were drawn
when their last epoch ended (the carry); it writes the spells of points, the cluster counts of the new events and the new
carry, again under the epoch. The union over all epochs is what a projection of the whole history gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as hs

CARRY = "user_id bigint, refit bigint, raw_id bigint, kind string, label bigint"


class History:
    """Tables of decisions, spells, timeline and carry under a folder, by epoch."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str, epoch: int) -> str:
        return f"{self.base}/{name}/epoch={epoch}"

    def put(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, epoch))
        return self.spark.read.schema(df.schema).parquet(self.path(name, epoch))

    def read(self, name: str) -> DataFrame | None:
        """All epochs of a table, with their number; None before the first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.base}/{name}")

    def append(self, records: DataFrame, epoch: int) -> None:
        """One epoch of records (with decisions): history, projection and carry. A user's records of an epoch come after those
        of earlier ones, as the fold gives them; a record's version is its place."""
        told = records.where("status <> 'duplicate'").select("user_id", "event_id", F.col("version").alias("replay_order"), "refit", "decisions")
        new = self.put(told, "decisions", epoch)
        old = self.carried(new.select("user_id").distinct(), epoch)
        known = old.groupBy("user_id").agg(F.max("refit").alias("_before"))

        refits = new.where("refit = 'closed'").select("user_id", "replay_order", F.col("replay_order").alias("epoch"))
        events = hs.as_of(new.select("user_id", "replay_order", "event_id"), refits, "user_id", "replay_order", ["epoch"])
        events = events.join(known, "user_id", "left").withColumn("epoch", F.coalesce("epoch", "_before")).drop("_before")

        single = new.select("user_id", "replay_order", F.inline("decisions"))
        # what happens at a refit's own event came before the refit
        later = refits.withColumn("replay_order", F.col("replay_order") + 1)
        moves = hs.as_of(single.where("kind <> 'base'"), later, "user_id", "replay_order", ["epoch"]).join(known, "user_id", "left")
        moves = moves.withColumn("epoch", F.coalesce("epoch", "_before")).where("epoch is not null")
        gone = F.col("kind") == "inactivate"
        rows = (
            old.where("raw_id is not null")
            .select("user_id", F.col("refit").alias("epoch"), "raw_id", F.lit(-1).cast("bigint").alias("order"), F.lit(-1).alias("_n"), "kind", "label")
            .unionByName(single.where("kind = 'base'").select("user_id", F.col("replay_order").alias("epoch"), "raw_id", F.col("replay_order").alias("order"), F.lit(-1).alias("_n"), "kind", "label"))
            .unionByName(moves.select("user_id", "epoch", "raw_id", F.col("replay_order").alias("order"), F.when(gone, 0).otherwise(1).alias("_n"), F.when(gone, "removed").otherwise("assigned").alias("kind"), "label"))
        )
        spells = self.put(hs.spells_of(rows).withColumnRenamed("epoch", "refit"), "spells", epoch).withColumnRenamed("refit", "epoch")
        self.put(hs.timeline(events, spells).withColumnRenamed("epoch", "refit"), "timeline", epoch)
        last = events.groupBy("user_id").agg(F.max("epoch").alias("refit")).where("refit is not null")
        drawn = spells.where("to_order is null").join(last, (spells["user_id"] == last["user_id"]) & (spells["epoch"] == last["refit"]), "left_semi")
        mark = last.select("user_id", "refit", F.lit(None).cast("bigint").alias("raw_id"), F.lit("refit").alias("kind"), F.lit(None).cast("bigint").alias("label"))
        self.put(mark.unionByName(drawn.select("user_id", F.col("epoch").alias("refit"), "raw_id", "kind", "label")), "carry", epoch)

    def carried(self, users: DataFrame, epoch: int) -> DataFrame:
        """The points that users had drawn when their last epoch before this one ended; a row without a point names the refit."""
        carry = self.read("carry")
        if carry is None:
            return self.spark.createDataFrame([], CARRY)
        own = carry.where(F.col("epoch") < epoch).join(users, "user_id", "left_semi")
        last = own.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
        return own.join(last, ["user_id", "epoch"]).select(*(c.split()[0] for c in CARRY.split(", ")))

    def follow(self, records: DataFrame, checkpoint: str) -> None:
        """Append a stream of records to its end, an epoch for each micro-batch."""
        q = records.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def lay_out(rows: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> None:
    """rows as a table to be read by key: a folder for each bucket of keys, its rows in order of key and place.

    Tasks take ranges of bucket, key and place, so that a key with very many rows is written by several.
    """
    tasks = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.withColumn("bucket", bucket(F.col(key), buckets))
    cut.repartitionByRange(tasks, "bucket", key, order).sortWithinPartitions("bucket", key, order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def served(spark: SparkSession, path: str, key: str, value: int, buckets: int = 64) -> DataFrame:
    """The rows of one key: one bucket's folder is read, and of its files the row groups that may hold the key."""
    kind = spark.read.parquet(path).schema[key].dataType
    here = (F.col("bucket") == bucket(F.lit(value).cast(kind), buckets)) & (F.col(key) == F.lit(value))
    return spark.read.parquet(path).where(here).drop("bucket")
