"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, source mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; run() writes each result
as Parquet in the shared folder and reads it back for the next stage. SQL cannot express the
classifier nor the SimHash groups, so ORACLE_SQL is None and the stages are tested one by one.

Results in odd cases, of every stage: a null text counts as empty, is no duplicate but of other
texts without words, holds no benchmark item and no secret, and passes on as null; null ids, and ids that rows share, do not
make rows one: near-duplicates are told by their texts, of which the smallest id stays, nulls last;
whether a row is toxic hangs on its own text; but a benchmark item found in one row of an id takes all rows of that id along,
and mixing takes all rows of an id or none; nulls in other columns pass through; very long texts
are taken whole; an empty table gives an empty one; columns beside those of documents pass through,
whatever their names, but the last stage replaces those named size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, mixing, secrets, simhash, toxicity
from larkspur.llm.common import documents, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labelled rows of docs."""
    return toxicity.keep_clean(docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken words."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
