"""The temporal-cutoff study: candidates, what stands before and after each, and roles."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import even
from .sequences import zscored
from .statistics import quantile_days


def candidates(ratings: DataFrame, shares: list[float], calendar: list[str], recent: list[int]) -> list[tuple[str, str]]:
    """(day, source) candidates: quantile days, then calendar days, then so many days before the last;
    the first of a day counts, and days outside [first day, last day) are left out."""
    lo, hi = ratings.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    named = [(r.day, f"quantile_{r.q:g}") for r in sorted(quantile_days(ratings, shares).collect())]  # a row for each share
    named += [(c, "calendar") for c in calendar]
    named += [((hi - timedelta(days=n)).isoformat(), f"recent_{n}") for n in recent]
    out: dict[str, str] = {}
    for day, source in named:
        if day is not None and lo <= date.fromisoformat(day) < hi:
            out.setdefault(day, source)
    return list(out.items())


def day_end(day: str):
    return F.lit(f"{day} 23:59:59").cast("timestamp")


def volumes(ratings: DataFrame, days: list[tuple[str, str]]) -> DataFrame:
    """One row for each candidate: ratings, users and movies before and after, new and cold ones.

    One aggregation by user and one by movie serve all candidates: first and last times, and one
    conditional count each.
    """
    n = range(len(days))
    ends = [day_end(day) for day, _ in days]

    def side(key: str) -> DataFrame:
        g = ratings.groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), *(F.count_if(F.col("ts") <= ends[k]).alias(f"b{k}") for k in n), F.count("*").alias("n"))
        aggs = []
        for k in n:
            fresh, after = F.col("lo") > ends[k], F.col("hi") > ends[k]
            aggs += [F.sum(f"b{k}").alias(f"b{k}"), F.sum(F.col("n") - F.col(f"b{k}")).alias(f"a{k}"), F.count_if(F.col("lo") <= ends[k]).alias(f"u{k}"), F.count_if(after).alias(f"v{k}"), F.count_if(fresh).alias(f"w{k}"), F.sum(F.when(fresh, F.col("n")).otherwise(0)).alias(f"x{k}")]
        rows = F.array(*(F.struct(F.lit(days[k][0]).alias("day"), F.lit(days[k][1]).alias("source"), *(F.col(f"{c}{k}").alias(c) for c in "bauvwx")) for k in n))
        return g.agg(*aggs).select(F.inline(rows))

    u, m = side("user_id"), side("movie_id")
    both = u.alias("u").join(m.alias("m"), "day")
    return both.select("day", F.col("u.source").alias("source"), F.col("u.b").alias("before"), F.col("u.a").alias("after"), F.col("u.u").alias("users_before"), F.col("u.v").alias("users_after"), F.col("u.w").alias("new_users"), F.col("m.w").alias("cold_movies"), F.col("m.x").alias("cold_ratings"))


def roles(volume: DataFrame, share: float = 0.8) -> DataFrame:
    """volume with role: the candidate whose share before is nearest to `share` is main, the latest is
    stress, others are spare. A row for each candidate."""
    from pyspark.sql import Window

    part = F.col("before") / (F.col("before") + F.col("after"))
    w = Window.partitionBy(F.lit(1))
    near = F.row_number().over(w.orderBy(F.abs(part - share), "day")) == 1
    last = F.row_number().over(w.orderBy(F.desc("day"))) == 1
    return volume.select("day", even(part).alias("share_before"), F.when(near, "main").when(last, "stress").otherwise("spare").alias("role"))


def user_kinds(ratings: DataFrame, cutoff: str, least: int) -> DataFrame:
    """(kind, users, after): users by what they had before and have after a cutoff: ready (enough
    positives before), warm (some ratings), new, gone (none after)."""
    end = day_end(cutoff)
    before = ratings.where(F.col("ts") <= end)
    pos = zscored(before).groupBy("user_id").agg(F.count_if(F.col("z") > 0).alias("p"), F.count("*").alias("n"))
    after = ratings.where(F.col("ts") > end).groupBy("user_id").agg(F.count("*").alias("a"))
    both = pos.join(after, "user_id", "full")
    kind = F.when(F.col("a").isNull(), "gone").when(F.col("n").isNull(), "new").when(F.col("p") >= least, "ready").otherwise("warm")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("users"), F.coalesce(F.sum("a"), F.lit(0)).alias("after"))


def recompute_estimate(ratings: DataFrame, cutoff: str, least: int) -> DataFrame:
    """One row: ready users, their ratings after, known and unknown items among them, and the rows
    embedded again: after * (active before + active in the end) / 2, summed over users."""
    end = day_end(cutoff)
    vocab = ratings.where(F.col("ts") <= end).select("movie_id").distinct().withColumn("known", F.lit(True))
    z = zscored(ratings.where(F.col("ts") <= end)).groupBy("user_id").agg(F.count_if(F.col("z") > 0).alias("pre"))
    whole = zscored(ratings).groupBy("user_id").agg(F.count_if(F.col("z") > 0).alias("final"))
    later = ratings.where(F.col("ts") > end).join(vocab, "movie_id", "left")
    post = later.groupBy("user_id").agg(F.count("*").alias("post"), F.count_if(F.col("known").isNotNull()).alias("known"))
    u = z.where(F.col("pre") >= least).join(post, "user_id").join(whole, "user_id")
    return u.agg(F.count("*").alias("users"), F.sum("post").alias("post"), F.sum("known").alias("known"), F.sum(F.col("post") - F.col("known")).alias("unknown"), even(F.sum(F.col("post") * (F.col("pre") + F.col("final")) / 2)).alias("recomputed"), F.count_if(F.col("post") >= 20).alias("refit_candidates"))
