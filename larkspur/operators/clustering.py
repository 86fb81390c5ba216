"""Hierarchical density clusters of users' vectors in the space of their leading directions, by user and by window.

A cluster's labels run from 0 in order of its first member; noise is -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import density
from .sequences import numbered


def dims(wanted: int, n: int) -> int:
    return max(1, min(wanted, n - 2))


#: Share of the largest spread (squared) down to which directions are taken from products of rows.
SPREAD = 1e-6


def pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the k leading directions; a direction's largest weight is positive."""
    mean = x.mean(axis=0)
    axes = leading(x - mean, k)
    flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * flip[:, None]


def leading(off: np.ndarray, k: int) -> np.ndarray:
    """The k leading directions of rows around 0: of few rows from their products, unless a spread is too small for that."""
    if k < len(off) < off.shape[1]:
        values, vectors = np.linalg.eigh(off @ off.T)
        top = values[-k:][::-1]
        if top[-1] > SPREAD * top[0]:
            return vectors[:, -k:].T[::-1] @ off / np.sqrt(top)[:, None]
    return np.linalg.svd(off, full_matrices=False)[2][:k]


def project(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes.T


def cluster(x: np.ndarray, least: int = 3, wanted: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, mean, axes): clusters in the space of the leading directions."""
    if len(x) < 2:
        return np.full(len(x), -1), x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.eye(x.shape[1])[:1]
    mean, axes = pca(x, dims(wanted, len(x)))
    return density.density_labels(project(x, mean, axes), least), mean, axes


POINT = "user_id bigint, event_id bigint, label bigint, x double, y double, z double"


def cluster_users(members: DataFrame, least: int = 3, wanted: int = 3, skip_under: int | None = None, stride: int = 1, tile: int | None = None) -> DataFrame:
    """(user_id, event_id, label, x, y, z) of each user's vectors in order of event_idx, every stride-th of them if that is asked for.

    Users with fewer than skip_under rows are left out. A user of up to `tile` rows is clustered in one task; the rows of
    larger ones are spread over tasks, with the same labels.
    """
    tile = tile or density.TILE
    rows = members.select("user_id", "event_id", "event_idx", "vec")
    if stride > 1:
        ordered = Window.partitionBy("user_id").orderBy("event_idx", "event_id")
        rows = rows.withColumn("_at", F.row_number().over(ordered) - 1).where(F.col("_at") % stride == 0).drop("_at")
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    large = sizes.where((F.col("n") > tile) & (F.col("n") >= (skip_under or 0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["event_idx", "event_id"])
        if skip_under is not None and len(pdf) < skip_under:
            return pd.DataFrame({"user_id": [], "event_id": [], "label": [], "x": [], "y": [], "z": []})
        x = np.stack(pdf["vec"].to_numpy())
        labels, _, _ = cluster(x, least, wanted)
        mean, axes = pca(x, min(3, len(x)))
        at = np.zeros((len(x), 3))
        at[:, : len(axes)] = project(x, mean, axes)
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "label": labels, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    if large.limit(1).count() == 0:
        return rows.groupBy("user_id").applyInPandas(run, POINT)
    few = large.select("user_id").withColumn("_large", F.lit(True))
    told = written(rows.join(few, "user_id", "left"), "members")
    small = told.where("_large is null").drop("_large").groupBy("user_id").applyInPandas(run, POINT)
    return small.unionByName(cluster_large(told.where("_large").drop("_large"), least, wanted, tile))


def principal(rows: DataFrame, k: int) -> DataFrame:
    """(user_id, mean, axes) of each user: as pca(), from sums that tasks make of their rows."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for user, part in pdf.groupby("user_id"):
                x = np.stack(part["vec"].to_numpy()) - np.stack(part["mean"].to_numpy())
                s = x.T @ x
                yield pd.DataFrame({"user_id": user, "row": np.arange(len(s)), "sums": list(s), "mean": [part["mean"].iloc[0]] * len(s)})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((len(pdf["mean"].iloc[0]),) * 2)
        np.add.at(s, pdf["row"].to_numpy(), np.stack(pdf["sums"].to_numpy()))
        values, vectors = np.linalg.eigh(s)
        axes = vectors[:, np.argsort(-values)[:k]].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[:1], "mean": [pdf["mean"].iloc[0]], "axes": [list(axes)]})

    cells = rows.select("user_id", F.posexplode("vec").alias("pos", "x")).groupBy("user_id", "pos").agg(F.avg("x").alias("x"))
    means = cells.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("mean"))
    parts = rows.join(means, "user_id").select("user_id", "vec", "mean").mapInPandas(products, "user_id bigint, row bigint, sums array<double>, mean array<double>")
    return parts.groupBy("user_id").applyInPandas(solved, "user_id bigint, mean array<double>, axes array<array<double>>")


def cluster_large(rows: DataFrame, least: int, wanted: int, tile: int) -> DataFrame:
    """As cluster_users(), for users whose rows no task should hold."""
    at = numbered(rows, ["user_id", "event_idx", "event_id"], "number", start=0)
    at = at.join(at.groupBy("user_id").agg(F.min("number").alias("start")), "user_id").withColumn("place", F.col("number") - F.col("start"))
    dim = max(wanted, 3)
    space = written(principal(rows, dim), "axes")
    # as its axes are in order of their spread, the plane of the clusters is the first of the point's components
    point = F.transform("axes", lambda axis: F.aggregate(F.zip_with(F.zip_with("vec", "mean", lambda v, m: v - m), axis, lambda v, a: v * a), F.lit(0.0), lambda s, x: s + x))
    points = written(at.join(space, "user_id").select("user_id", "event_id", "place", point.alias("point")), "points")
    labels = density.clustered(points.select(F.col("user_id").alias("group"), "place", F.slice("point", 1, wanted).alias("vec")), least, tile)
    named = points.join(labels.withColumnRenamed("group", "user_id"), ["user_id", "place"])
    return named.select("user_id", "event_id", "label", *(F.coalesce(F.get("point", F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate("xyz")))


def sliding_counts(members: DataFrame, width: int = 100, step: int = 10, least: int = 3) -> DataFrame:
    """(user_id, centre, k): clusters in sliding windows of a user's rows; centre is an event_idx."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["event_idx", "event_id"])
        x, at = np.stack(pdf["vec"].to_numpy()), pdf["event_idx"].to_numpy()
        rows = []
        for s in range(0, max(1, len(x) - width + 1), step):
            e = min(s + width, len(x))
            labels = cluster(x[s:e], least)[0]
            rows.append((pdf["user_id"].iloc[0], at[(s + e) // 2 if (s + e) // 2 < len(at) else -1], len(set(labels[labels >= 0].tolist()))))
        return pd.DataFrame(rows, columns=["user_id", "centre", "k"])

    return members.select("user_id", "event_id", "event_idx", "vec").groupBy("user_id").applyInPandas(run, "user_id bigint, centre bigint, k bigint")
