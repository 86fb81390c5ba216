"""Checks of a table against a contract: columns, types, nulls, uniqueness and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE = "issue string, column string, details string"


@dataclass
class Contract:
    """A table's columns in order, and its constraints."""

    name: str
    schema: T.StructType
    unique: list[list[str]] = field(default_factory=list)
    non_negative: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


def schema_issues(df: DataFrame, contract: Contract) -> list[tuple[str, str, str]]:
    """Missing, unexpected, reordered and mistyped columns."""
    want, have = [f.name for f in contract.schema], df.columns
    out = [("missing_column", c, "") for c in want if c not in have]
    out += [("unexpected_column", c, "") for c in have if c not in want]
    if not out and want != have:
        out.append(("column_order", ",".join(have), ",".join(want)))
    kinds = {f.name: f.dataType for f in df.schema}
    out += [("dtype_mismatch", f.name, f"{kinds[f.name].simpleString()} for {f.dataType.simpleString()}") for f in contract.schema if f.name in kinds and kinds[f.name] != f.dataType]
    return out


def schema_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(issue, column, details, affected): schema_issues() with the values of the column, or for a missing one the rows, in one pass."""
    found = schema_issues(df, contract)
    if not found:
        return df.sparkSession.createDataFrame([], f"{ISSUE}, affected bigint")
    counts = df.agg(*(F.count(F.col(f"`{c}`") if c in df.columns else F.lit(1)).alias(f"_{k}") for k, (_, c, _) in enumerate(found)))
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(issue, ("issue", "column", "details"), strict=True)), F.col(f"_{k}").alias("affected")) for k, issue in enumerate(found)))
    return counts.select(F.inline(rows))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """df's rows with an array of the constraints that each breaks; rows that break none are left out.

    All checks but uniqueness are expressions of one pass; uniqueness is a count over the key.
    """
    tests = [F.when(F.col(f.name).isNull(), F.lit(f"null:{f.name}")) for f in contract.schema if not f.nullable]
    tests += [F.when(F.col(c) < 0, F.lit(f"negative:{c}")) for c in contract.non_negative]
    tests += [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(f"range:{c}")) for c, (lo, hi) in contract.ranges.items()]
    for key in contract.unique:
        tests.append(F.when(F.count("*").over(Window.partitionBy(*key)) > 1, F.lit(f"duplicate:{','.join(key)}")))
    return df.withColumn("violations", F.array_compact(F.array(*tests))).where(F.size("violations") > 0)


class ContractError(ValueError):
    """A table that does not meet its contract."""


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """df, or an error that names the schema's issues or the number of rows that break a constraint."""
    if found := schema_issues(df, contract):
        raise ContractError(f"{contract.name}: {found}")
    if bad := violations(df, contract).count():
        raise ContractError(f"{contract.name}: {bad} rows break a constraint")
    return df


def other_dimensions(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, wrong): how many vectors of a group have another length than most of them."""
    sizes = rows.groupBy(group, F.size(vec).alias("_n")).agg(F.count("*").alias("_rows"))
    own = sizes.groupBy(group).agg(F.sum("_rows").alias("_all"), F.max("_rows").alias("_most"))
    return own.select(group, (F.col("_all") - F.col("_most")).alias("wrong"))


def option_issues(speed: str, top_k: str, skip_refit: str, forced_every: str) -> Column:
    """Names of a run's options (columns) that are out of bounds or contradict each other; an interval of 0 or none is no forced refit."""
    every = F.coalesce(F.col(forced_every), F.lit(0))
    tests = {"speed": F.col(speed) <= 0, "top_k": F.col(top_k) <= 0, "refit": F.col(skip_refit) & (every > 0)}
    return F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in tests.items())))

