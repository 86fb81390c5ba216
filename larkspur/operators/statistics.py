"""Distribution statistics: counts, quantiles, concentration, buckets, running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import even
from .sequences import numbered, running


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def user_spans(ratings: DataFrame) -> DataFrame:
    """user_id, n, first_s, last_s, days."""
    g = ratings.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    return g.withColumn("days", (F.col("last_s") - F.col("first_s")) / 86400.0)


def calendar_counts(ratings: DataFrame, prefixes: dict[str, int]) -> DataFrame:
    """(unit, slot, n): counts by prefix of the ISO time, all from one aggregation by hour."""
    hours = ratings.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count("*").alias("n"))
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.substring("hour", 1, k).alias("slot")) for u, k in prefixes.items())))
    return hours.select(units.alias("s"), "n").groupBy("s.unit", "s.slot").agg(F.sum("n").alias("n"))


def by_candidate(ratings: DataFrame, cutoffs: list[str]) -> DataFrame:
    """(user_id, cutoff, before, after): conditional sums of one pass, then one row for each cutoff."""
    at = [F.lit(c).cast("timestamp") for c in cutoffs]
    sums = [f(k) for k in range(len(cutoffs)) for f in (lambda k: F.count_if(F.col("ts") <= at[k]).alias(f"b{k}"), lambda k: F.count_if(F.col("ts") > at[k]).alias(f"a{k}"))]
    wide = ratings.groupBy("user_id").agg(*sums)
    rows = F.array(*(F.struct(at[k].cast("timestamp_ntz").alias("cutoff"), F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after")) for k in range(len(cutoffs))))
    return wide.select("user_id", F.inline(rows))


#: Distinct values that one task may sort.
SMALL = 100_000


def summed_up(by_value: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """by_value (groups, column, _k) with _upto, the running sum of _k by value: in one go while the values are few, else by ranges."""
    if by_value.limit(SMALL + 1).count() > SMALL:
        return running(by_value, column, "_k", "_upto", groups)
    return by_value.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*groups).orderBy(column)))


def picked(df: DataFrame, column: str, at: dict[str, float], by: str | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours, picked by rank from the counts of the distinct values."""
    groups = [by] if by else []
    by_value = df.groupBy(*groups, column).agg(F.count("*").alias("_k"))
    upto = summed_up(by_value, column, groups)
    whole = upto.groupBy(*groups).agg(F.max("_upto").alias("_n"))
    rows = upto.join(whole, by) if by else upto.crossJoin(F.broadcast(whole))  # one row
    place = lambda q: (F.col("_n") - 1) * F.lit(q)
    value = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(column).cast("double")))
    ends = rows.groupBy(*groups).agg(F.first("_n").alias("_n"), *(f(place(q)).alias(f"{side}{k}") for k, q in enumerate(at.values()) for side, f in (("lo", lambda p: value(F.floor(p))), ("hi", lambda p: value(F.ceil(p))))))
    between = lambda k, q: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (place(q) - F.floor(place(q)))
    return ends.select(*groups, *(even(between(k, q)).alias(name) for k, (name, q) in enumerate(at.items())))


def quantiles(df: DataFrame, column: str, at: dict[str, float], total: bool = False, by: str | None = None) -> DataFrame:
    """count, mean, max, exact quantiles (linear between neighbours) and perhaps the sum; nulls and
    values that are not finite are left out."""
    x = F.col(column).cast("double")
    good = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    aggs = [F.count("*").alias("count"), even(F.avg(column)).alias("mean"), F.max(column).alias("max")]
    aggs += [F.sum(column).alias("total")] * total
    q = picked(good, column, at, by)
    out = good.groupBy(by).agg(*aggs).join(q, by) if by else good.agg(*aggs).join(F.broadcast(q), how="left")  # single rows
    return out.withColumn("max", even(F.col("max").cast("double"))) if dict(df.dtypes)[column] == "double" else out


def eight_numbers(df: DataFrame, column: str, by: str) -> DataFrame:
    """min, p25, p50, p75, p90, p99, max and mean by group."""
    q = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    return df.groupBy(by).agg(F.min(column).alias("min"), F.max(column).alias("max"), even(F.avg(column)).alias("mean")).join(picked(df.where(F.col(column).isNotNull()), column, q, by), by, "left")


def lags(ratings: DataFrame) -> DataFrame:
    """event_id, user_id, lag_s: seconds since the user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts_s", "movie_id", "event_id")
    return ratings.select("event_id", "user_id", (F.col("ts_s") - F.lag("ts_s").over(w)).alias("lag_s"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient of a column, from ranks by value: equal values share the sum of their ranks,
    so only one row for each distinct value is ranked."""
    ranked = summed_up(df.groupBy(column).agg(F.count("*").alias("_k")), column, [])
    x, k = F.col(column), F.col("_k")
    weighted = F.sum(x * (k * (F.col("_upto") - k) + k * (k + 1) / 2))
    n, total = F.sum("_k"), F.sum(x * k)
    return ranked.agg(even((2.0 * weighted - (n + 1) * total) / (n * total)).alias("gini"))


def concentration(df: DataFrame, column: str, key: str, fractions: list[float]) -> DataFrame:
    """(fraction, top_n, held, share) of the largest ceil(n * fraction) rows, one at least."""
    placed = numbered(df.withColumn("_down", -F.col(column)), ["_down", key], "_i")
    n, total = df.agg(F.count("*"), F.sum(column)).first()
    import math

    tops = [(f, max(1, math.ceil(n * f))) for f in fractions]
    rows = placed.agg(*(F.sum(F.when(F.col("_i") <= top, F.col(column))).alias(f"h{k}") for k, (_, top) in enumerate(tops)))
    out = F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(top).cast("bigint").alias("top_n"), F.col(f"h{k}").alias("held")) for k, (f, top) in enumerate(tops)))
    return rows.select(F.inline(out)).withColumn("share", even(F.col("held") / F.lit(total)))


def coverage(df: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """(threshold, items, item_share, ratings, rating_share) of rows with at least so much, in one pass."""
    x = F.col(column)
    one = df.agg(F.count("*").alias("n"), F.sum(x).alias("t"), *(F.count_if(x >= k).alias(f"i{k}") for k in thresholds), *(F.coalesce(F.sum(F.when(x >= k, x)), F.lit(0)).alias(f"r{k}") for k in thresholds))
    rows = F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(f"i{k}").alias("items"), even(F.col(f"i{k}") / F.col("n")).alias("item_share"), F.col(f"r{k}").alias("ratings"), even(F.col(f"r{k}") / F.col("t")).alias("rating_share")) for k in thresholds))
    return one.select(F.inline(rows))


def at_most(df: DataFrame, column: str, thresholds: list[int], name: str) -> DataFrame:
    one = df.agg(*(F.count_if(F.col(column) <= k).alias(f"n{k}") for k in thresholds))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(f"n{k}").alias(name)) for k in thresholds))))


def buckets(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """(bucket, count) with buckets (a, b]; all buckets are listed."""
    text = lambda x: f"{x:g}"
    labels = [f"<={text(edges[0])}d", *(f"{text(a)}-{text(b)}d" for a, b in zip(edges, edges[1:], strict=False)), f">{text(edges[-1])}d"]
    x = F.col(column)
    tests = [x <= edges[0], *((x > a) & (x <= b) for a, b in zip(edges, edges[1:], strict=False)), x > edges[-1]]
    one = df.agg(*(F.count_if(t).alias(f"n{k}") for k, t in enumerate(tests)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(label).alias("bucket"), F.col(f"n{k}").alias(name)) for k, label in enumerate(labels)))))


def running_days(ratings: DataFrame) -> DataFrame:
    """(day, n, upto, share): one row for each day, so the running sum is over days, not ratings."""
    g = ratings.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.select("day", "n", F.sum("n").over(w).alias("upto"), (F.sum("n").over(w) / whole).alias("share"))


def quantile_days(ratings: DataFrame, shares: list[float]) -> DataFrame:
    """(q, day): the first day whose running count reaches ceil(total * q)."""
    r = running_days(ratings)
    total = ratings.count()
    import math

    firsts = r.agg(*(F.min(F.when(F.col("upto") >= math.ceil(total * q), F.col("day"))).alias(f"d{k}") for k, q in enumerate(shares)))
    return firsts.select(F.inline(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"d{k}").alias("day")) for k, q in enumerate(shares)))))
