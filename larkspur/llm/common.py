"""Helpers shared by the corpus operators: shared-folder tables, ranking, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the corpus contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only local masters get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends here."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As table(), with the path, so that it can be dropped when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of kept(), in whatever store the shared folder is."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized_broadcast(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of ids, to be broadcast if it has at most so many rows, else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(col: Column) -> Column:
    """60 bits of the MD5 of a value's text as a long; null counts as the empty text."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """df with `position`, its 0-based place in the order, without one task holding all rows."""
    parts = table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "positions",
    )
    # One row for each partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        parts.join(starts, "_part")
        .withColumn("position", F.col("_at") + F.col("_start"))
        .drop("_part", "_at", "_start")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of (src, dst) edges, component = smallest node.

    Alternates large-star and small-star steps on tables in the shared folder until the edge set no
    longer changes, which takes a number of rounds that grows with the logarithm of the nodes. Each
    step keeps every edge's connectivity and adds no pair expansion: the number of edges never grows.
    A round's tables are dropped when the next one has been written.
    """
    spark = edges.sparkSession
    now, path = kept(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        # large-star: neighbours above a node go to the smallest node around it, itself if none is smaller;
        # written, so that a hub's edges can be split in the join that follows
        low, low_path = kept(now.groupBy("u").agg(F.min("v").alias("m")), "stars")
        around = now.select(F.col("v").alias("_at"), "u").join(low.withColumnRenamed("u", "_at"), "_at", "left")
        large, large_path = kept(around.select("u", F.coalesce("m", "_at").alias("v")).distinct(), "edges")
        drop(spark, path, low_path)
        # small-star: u and its smaller neighbours go to the smallest of them
        low, low_path = kept(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        joined = large.join(low, "u")
        now, path = kept(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct(),
            "edges",
        )
        drop(spark, large_path, low_path)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
