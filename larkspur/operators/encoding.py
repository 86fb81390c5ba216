"""Embeddings of contexts by an encoder: any function of a context's item vectors, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[np.ndarray], np.ndarray]
ManyEncoder = Callable[[list[np.ndarray]], np.ndarray]


@lru_cache(maxsize=1024)
def recency(n: int) -> tuple[np.ndarray, float]:
    """The weights of n items, one below the other, and their sum."""
    w = 0.8 ** np.arange(n - 1, -1, -1)
    return w[:, None], w.sum()


def recency_mean(items: np.ndarray) -> np.ndarray:
    """The default encoder: a mean of the context's item vectors, each weighing 0.8 of the next."""
    w, total = recency(len(items))
    return (items * w).sum(axis=0) / total


def recency_means(contexts: np.ndarray) -> np.ndarray:
    """recency_mean of each of many contexts of one length."""
    w, total = recency(contexts.shape[1])
    return (contexts * w).sum(axis=1) / total


#: Encoders that take contexts of one length together.
TOGETHER = {recency_mean: recency_means}


def encoded(contexts: DataFrame, items: DataFrame, encode: Encoder = recency_mean, many: ManyEncoder | None = None, batch: int = 512) -> DataFrame:
    """(user_id, event_id, vec) of contexts (user_id, event_id, items), whose items all have vectors.

    Items are joined with their vectors, not collected; a context's vectors come together in one row.
    many encodes up to `batch` contexts at once, in the place of encode.
    """
    parts = contexts.select("user_id", "event_id", F.posexplode("items").alias("_at", "movie_id")).join(items.select("movie_id", "vec"), "movie_id")
    rows = parts.groupBy("user_id", "event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "vec"))), lambda x: x["vec"]).alias("vecs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.stack(v) for v in pdf["vecs"]]
            if many is None:
                vecs = [encode(v) for v in own]
            else:
                # contexts of like length together, so that little is padded
                order = np.argsort([len(v) for v in own], kind="stable")
                vecs = [None] * len(own)
                for at in range(0, len(own), batch):
                    rows = order[at : at + batch].tolist()
                    for i, v in zip(rows, many([own[i] for i in rows]), strict=True):
                        vecs[i] = v
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "vec": vecs})

    return rows.mapInPandas(run, "user_id bigint, event_id bigint, vec array<double>")
