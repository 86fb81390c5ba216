"""Readers and writers: CSV, JSON lines, Parquet, contracts in YAML, reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validation import Contract

TYPES = {"int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and given types; empty fields are null; only the named columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a CSV whose header must equal the schema's names.

    All fields are read as text and converted leniently; a bad row keeps its text and its reasons.
    """
    header = spark.read.text(path).first()
    names = [f.name for f in schema]
    if header is None or [x.strip('"') for x in header[0].split(",")] != names:
        raise ValueError(f"{path}: header {header and header[0]!r} is not {','.join(names)}")
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).csv(path)
    tested = raw.select("*", *(F.col(f.name).try_cast(f.dataType).alias(f"_{f.name}") for f in schema))
    why = F.array_compact(F.array(*(F.when(F.col(f"_{n}").isNull(), F.lit(f"invalid:{n}")) for n in names)))
    tested = tested.withColumn("reasons", why)
    good = tested.where(F.size("reasons") == 0).select(*(F.col(f"_{n}").alias(n) for n in names))
    return good, tested.where(F.size("reasons") > 0).select(*names, "reasons")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines give no row."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_frame(df: DataFrame, path: str) -> None:
    """Parquet, CSV or JSON lines, by the path's extension."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == ".csv":
        write_csv(df, path)
    elif kind in (".jsonl", ".ndjson"):
        write_json_lines(df, path)
    else:
        raise ValueError(f"no format for {path}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def contract(text: str) -> Contract:
    """A contract from YAML: name, columns with physical_type and nullable, and constraints."""
    d = yaml.safe_load(text)
    fields = []
    for c in d["columns"]:
        kind = T.ArrayType(T.StringType()) if c.get("logical_type") == "list[string]" else TYPES[c.get("physical_type") or c["logical_type"]]
        fields.append(T.StructField(c["name"], kind, bool(c.get("nullable", True))))
    out = Contract(d["name"], T.StructType(fields))
    for k in d.get("constraints") or []:
        kind, cols = k["type"], k.get("columns") or [k["column"]]
        if kind == "unique":
            out.unique.append(cols)
        elif kind == "non_negative":
            out.non_negative += cols
        elif kind == "range":
            out.ranges |= {c: (k["min"], k["max"]) for c in cols}
        else:
            raise ValueError(f"unknown constraint {kind}")
    return out


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists in whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths}")


def vocabulary_map(text: str, spark: SparkSession) -> DataFrame:
    """{"movie": index} JSON as (movie_id, item_idx)."""
    rows = [(int(k), int(v)) for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, "movie_id bigint, item_idx bigint")


def digests(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """(path, bytes, too_large, digest): the SHA-256 of each file, null beyond a size; files are read by the executors."""
    listed = spark.read.format("binaryFile").load(path)
    large = F.col("length") > most
    small = listed.where(~large).select("path", F.col("length").alias("bytes"), F.lit(False).alias("too_large"), F.sha2("content", 256).alias("digest"))
    return small.unionByName(listed.where(large).select("path", F.col("length").alias("bytes"), F.lit(True).alias("too_large"), F.lit(None).cast("string").alias("digest")))


def attached(spark: SparkSession, stores: dict[str, DataFrame]) -> Callable[[str], DataFrame]:
    """Run statements over several stores, each named in braces."""
    return lambda statement: spark.sql(statement, **stores)


def write_report(summary: DataFrame, issues: DataFrame, path: str) -> None:
    """A validation report (one JSON row) and its bad rows (CSV), side by side."""
    write_json_lines(summary, f"{path}/report.jsonl")
    write_csv(issues, f"{path}/bad_rows.csv")
