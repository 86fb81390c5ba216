"""Operator 1: mix sources to target weights by nested hash thresholds.

Every document has a 60-bit hash of its id. The sizes are summed by source and hash bucket; the
bucket in which a source's budget ends is split again, 4096 ways a level, until it holds one hash
value. What is below the threshold is taken once more; no document is sorted. A larger budget
keeps all that a smaller one takes.

Results in odd cases: a null text or id counts as an empty text or id; a null source is a source
of its own and the last; rows of the same id share their hash and are taken together, so a source of one id
takes all of it or nothing; very long texts are counted whole; a tie between two places of a threshold goes to the later; an empty
table gives an empty result; other columns pass through, but those named like a result (size,
source_size, target, taken) are replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, hash60, kept, positions, table, unused

BITS, LEVEL = 60, 12


def sized(docs: DataFrame, hash_name: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with size (words of the whole text) and the hash of the id."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, hash_name: hash60(F.col(key))})


def targets(narrow: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): total size shared by weight, no target over most x size.

    Only sums reach the driver, so any number of sources will do.
    """
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = table(positions(sums, F.col("source").asc_nulls_last()).withColumn("weight", weight.cast("long")), "sources")
    big = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, share = total, sources.agg(F.sum("weight")).first()[0] or 1
    while True:
        # decimal products: exact beyond the range of a long
        over = F.col("weight").cast("decimal(12,0)") * F.lit(Decimal(left)).cast("decimal(20,0)") > cap.cast("decimal(20,0)") * F.lit(Decimal(share)).cast("decimal(15,0)")
        used, rest = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if (total - (used or 0), rest or share) == (left, share) or not rest:
            break
        left, share = total - (used or 0), rest
    target = F.when(over, cap.cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(share).cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def thresholds(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with whole (repeats of every document) and last (hash up to which one more is taken)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    spark = goals.sparkSession
    state, path = kept(
        goals.withColumn("whole", whole)
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("last", F.when(F.col("budget") <= 0, F.lit(-1)).cast("long")),
        "mix-state",
    )
    rows = narrow.where("size > 0")
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        open_ = state.where("last is null").select(F.col("source").alias("_s"), "prefix", "budget", "below")
        inside = rows.join(open_, rows.source.eqNullSafe(open_._s) & (F.shiftright("_hash", shift + LEVEL) == F.col("prefix")))
        cells = inside.groupBy("source", F.shiftright("_hash", shift).alias("cell")).agg(
            F.sum("size").alias("n"), F.min("_hash").alias("lo"), F.max("_hash").alias("hi"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        # at most 4096 cells a source
        run = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.col("below") + F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        edge = (
            cells.where("upto >= budget")
            .groupBy("source")
            .agg(F.min_by(F.struct("cell", "n", "lo", "hi", "upto"), "cell").alias("e"))
            .select(F.col("source").alias("_s"), F.col("e.*"))
        )
        joined = state.drop("_s").join(edge, state.source.eqNullSafe(edge._s), "left")
        under = F.col("upto") - F.col("n")
        single = F.when(F.col("upto") - F.col("budget") <= F.col("budget") - under, F.col("hi")).otherwise(F.col("lo") - 1)
        last = F.when(F.col("last").isNotNull(), F.col("last")).when(F.col("cell").isNull(), F.lit((1 << BITS) - 1)).when(F.col("lo") == F.col("hi"), single)
        before = path
        state, path = kept(
            joined.select("source", "source_size", "target", "whole", "budget", F.coalesce(under, "below").alias("below"), F.coalesce("cell", "prefix").alias("prefix"), last.cast("long").alias("last")),
            "mix-state",
        )
        drop(spark, before)
        if state.where("last is null").isEmpty():
            break
    return state.select(F.col("source").alias("_s"), "source_size", "target", "whole", "last")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, text: str = "text", key: str = "doc_id", narrow_only: bool = False) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each document.

    narrow_only returns the id and source alone, without a second read of the texts.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    hashed, found = unused(docs, "_hash"), unused(docs, "_mix")
    full = sized(docs, hashed, text, key)
    narrow = table(full.select(key, "source", "size", F.col(hashed).alias("_hash")), "mix-sizes")
    budgets = thresholds(narrow, targets(narrow, weights, most)).select(F.struct("*").alias(found))
    base, hashed = (narrow, "_hash") if narrow_only else (full, hashed)
    of = lambda name: F.col(f"{found}.{name}")
    taken = F.col("size") * (of("whole") + F.when(F.col(hashed) <= of("last"), 1).otherwise(0))
    keep = [c for c in base.columns if c != hashed]
    joined = base.join(budgets, base.source.eqNullSafe(of("_s")), "left")
    return joined.select(*keep, of("source_size").alias("source_size"), of("target").alias("target"), taken.cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents mixed; size, source_size, target and taken of each."""
    from .common import documents

    return mix(documents(spark, sf_dir), narrow_only=True).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting: the running size in hash order, cut at the nearest place to the budget.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
         sum(w) OVER after AS ws
  FROM s
  WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT rest, ws FROM o WHERE w * rest <= 3 * source_size * ws
  ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN w * level.rest > 3 * source_size * level.ws THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * level.rest AS DOUBLE) / CAST(level.ws AS DOUBLE) END AS target
  FROM s, level),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - whole * source_size AS budget FROM t),
c AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM d WHERE size > 0 GROUP BY source, h),
e AS (
  SELECT c.source, min_by(CASE WHEN upto - budget <= budget - (upto - n) THEN h ELSE h - 1 END, h) AS last
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
  WHERE upto >= budget AND budget > 0 GROUP BY c.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN b.budget > 0 AND d.h <= coalesce(e.last, 1152921504606846975) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
