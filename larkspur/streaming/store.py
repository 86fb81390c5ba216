"""State tables as folds of append-only logs: upserts, replacement, request lifecycles, change logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch


def upsert(changes: DataFrame, keys: list[str], seq: str, columns: list[str], coalesce: bool = False) -> DataFrame:
    """The current row of each key: its last row, or the last value of each column that is not null.

    A fold by aggregates: rows of one key are combined before the shuffle.
    """
    last = F.max_by(F.struct(*columns), seq).alias("_r")
    aggs = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    out = changes.groupBy(*keys).agg(*(aggs if coalesce else [last]), F.max(seq).alias(seq))
    return out if coalesce else out.select(*keys, "_r.*", seq)


def first_of(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(key, origin, columns) of each key from the first of the sources that has it."""
    rows = None
    for place, (origin, df) in enumerate(sources.items()):
        one = df.select(key, F.lit(place).alias("_place"), F.lit(origin).alias("origin"), *columns)
        rows = one if rows is None else rows.unionByName(one)
    found = rows.groupBy(key).agg(F.min_by(F.struct("origin", *columns), "_place").alias("_r"))
    return found.select(key, "_r.*")


def since_last(rows: DataFrame, key: str, seq: str, mark: Column) -> DataFrame:
    """A key's rows from its last marked one on; all rows where none is marked."""
    cuts = rows.where(mark).groupBy(key).agg(F.max(seq).alias("_cut"))
    return rows.join(cuts, key, "left").where(F.col("_cut").isNull() | (F.col(seq) >= F.col("_cut"))).drop("_cut")


def lifecycle(log: DataFrame) -> DataFrame:
    """(key, request, status, attempts) from a log of (key, seq, status).

    'open' starts a request; later rows move the newest. A request left open or running when a newer
    one starts is superseded.
    """
    w = Window.partitionBy("key").orderBy("seq")
    rows = log.withColumn("request", F.sum(F.when(F.col("status") == "open", 1).otherwise(0)).over(w)).where("request > 0")
    folded = rows.groupBy("key", "request").agg(F.max_by("status", "seq").alias("final"), F.count_if(F.col("status") == "running").alias("attempts"))
    older = F.col("request") < F.max("request").over(Window.partitionBy("key"))
    return folded.select("key", "request", F.when(older & F.col("final").isin("open", "running"), "superseded").otherwise(F.col("final")).alias("status"), "attempts")


def signatures(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, signature): a digest of a key's values in order."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, value))).alias("_l"))
    return lists.select(key, F.md5(F.array_join(F.transform("_l", lambda x: x[value].cast("string")), ",")).alias("signature"))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of the rows that differ: insert, update or inactive."""
    both = old.withColumnRenamed("signature", "_old").join(new.withColumnRenamed("signature", "_new"), key, "full")
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "inactive").otherwise("update")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, kind.alias("change"))


class Table:
    """A keyed table kept as versions of Parquet in the shared folder, upserted from foreachBatch."""

    def __init__(self, spark: SparkSession, keys: list[str], seq: str):
        self.spark, self.keys, self.seq = spark, keys, seq
        self.base, self.version = f"{scratch(spark)}/table-{uuid.uuid4().hex}", 0

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.base}/{self.version}") if self.version else None

    def merge(self, batch: DataFrame, _epoch: int = 0) -> None:
        """The newer row of each key; a replayed batch changes nothing."""
        columns = [c for c in batch.columns if c not in (*self.keys, self.seq)]
        old = self.read()
        rows = batch if old is None else old.unionByName(batch)
        upsert(rows, self.keys, self.seq, columns).write.mode("overwrite").parquet(f"{self.base}/{self.version + 1}")
        self.version += 1

    def clear(self) -> None:
        """The table is empty from here on; what was read from it before stays."""
        self.base, self.version = f"{scratch(self.spark)}/table-{uuid.uuid4().hex}", 0
