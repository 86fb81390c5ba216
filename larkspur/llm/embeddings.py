"""Operator 5: embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector of a label is scaled to length one in double precision, turned by a random
rotation and encoded once. Its code is the signs of its turned components, packed in 64-bit words;
beside it stand the turned components in PLANES bits each, packed as bit planes, and correction
factors: the inner product of the turned vector with its code's direction, and what the planes leave
of it. For two vectors, <code, planes> / factor estimates the cosine without bias, by bitwise and and
bit counts only.

What the estimate can be off by is bounded: the error is the inner product of what the code's
direction and the other vector have beside the first vector, so for a cosine c it is at most
sqrt(1 - factor^2) * sqrt(1 - c^2) / factor, plus the planes' rest (Cauchy and Schwarz). A pair whose
estimate stays under the threshold by more than that cannot link, so nothing is missed. With `sigmas`
the bound is that many standard deviations of the error under a random rotation instead, which is
tighter for long vectors and no longer certain.

1. The codes of a label are dealt to tiles of bounded size, and each task compares two tiles of codes.
   It returns the rows that have a partner the bound does not rule out.
2. Only these rows' vectors are fetched to their tiles, and the cosines of the pairs that the bound
   left are computed exactly. A task returns the number of links of each row and a spanning forest.
3. Connected components over the forests give the groups.

Codes, not vectors, are what is sent to many tasks; no label meets in one task, and no pair leaves one. All pairs of codes of one label are compared,
so the work still grows with the square of a label's distinct vectors.

Results in odd cases: vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing, and neither do those with a null label; vectors of different lengths do not link;
equal vectors of a label are encoded once and link with each other; rows of one vec_id are rows of
their own, each other's links included, and share a component; components near the limits of a double
are scaled first; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, table

TILE, BLOCK = 2048, 512
#: Bits of a turned component.
PLANES = 6
FACTORS = ["factor", "rest", "low", "step", "total"]


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component: exact, and far from overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def packed(bits: np.ndarray) -> np.ndarray:
    """(rows, words) of 64 bits."""
    pad = np.zeros((len(bits), -bits.shape[1] % 64), dtype=bool)
    return np.packbits(np.concatenate([bits, pad], axis=1), axis=1, bitorder="little").view(np.uint64)


class Codes:
    """Codes of vectors: (rows, 1 + PLANES, words) bits and the factors of each row."""

    def __init__(self, dim: int, bits: np.ndarray, factors: np.ndarray):
        self.dim, self.bits, self.factors = dim, bits, factors

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        x = scaled(x)
        turned = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ rotation(x.shape[1])
        n, dim = turned.shape
        low = np.abs(turned).max(axis=1)
        step = 2 * low / (2**PLANES - 1)
        units = np.rint((turned + low[:, None]) / step[:, None]).astype(np.int64)
        rest = np.sqrt(((units * step[:, None] - low[:, None] - turned) ** 2).sum(axis=1))
        factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        bits = np.stack([packed(turned >= 0), *(packed((units >> k & 1).astype(bool)) for k in range(PLANES))], axis=1)
        return cls(dim, bits, np.stack([factor, rest, low, step, units.sum(axis=1).astype(np.float64)], axis=1))

    def part(self, rows) -> Codes:
        return Codes(self.dim, self.bits[rows], self.factors[rows])

    def __len__(self) -> int:
        return len(self.bits)

    def estimates(self, other: Codes) -> np.ndarray:
        """(rows, other's rows) unbiased estimates of the cosines."""
        # sum of the units where the code's sign is positive, plane by plane
        positive = np.zeros((len(self), len(other)), dtype=np.int32)
        for k in range(PLANES):
            for w in range(self.bits.shape[2]):
                positive += np.bitwise_count(self.bits[:, 0, w, None] & other.bits[None, :, 1 + k, w]).astype(np.int32) << k
        _, _, low, step, total = other.factors.T
        signs = 2 * np.bitwise_count(self.bits[:, 0]).sum(axis=1, dtype=np.int64) - self.dim
        inner = step * (2.0 * positive - total) - low * signs[:, None].astype(np.float64)
        return inner / (np.sqrt(self.dim) * self.factors[:, 0, None])

    def near(self, other: Codes, least: float, sigmas: float | None = None) -> np.ndarray:
        """Where a cosine of `least` is not ruled out."""
        factor, rest = self.factors[:, 0, None], other.factors[None, :, 1]
        off = np.sqrt(np.maximum(1 - factor**2, 0)) * np.sqrt(max(1 - least**2, 0.0))
        if sigmas is not None:
            off *= sigmas / np.sqrt(max(self.dim - 1, 1))
        return self.estimates(other) >= least - (off + rest) / factor - 1e-9


def encoded(distinct: DataFrame) -> DataFrame:
    """(label, dim, node, bits, factors) of (label, dim, node, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                c = Codes.of(rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                bits = pa.array([b.tobytes() for b in c.bits], pa.binary())
                factors = pa.FixedSizeListArray.from_arrays(pa.array(c.factors.ravel()), len(FACTORS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("dim"), rows.column("node"), bits, factors], ["label", "dim", "node", "bits", "factors"])

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.select("label", "dim", "node", "embedding").mapInArrow(run, f"label {kind}, dim int, node bigint, bits binary, factors array<double>")


def sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the one tile, rows of the other, and whether they are the same."""
    left = (pdf["tile"] == pdf["i"]).to_numpy()
    same = bool((pdf["i"] == pdf["j"]).all())
    return np.flatnonzero(left), np.flatnonzero(left if same else ~left), same


def codes_of(pdf: pd.DataFrame) -> Codes:
    dim = int(pdf["dim"].iloc[0])
    bits = np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), 1 + PLANES, -1)
    return Codes(dim, bits, np.stack(pdf["factors"].to_numpy()))


def survivors(pdf: pd.DataFrame, least: float, sigmas: float | None) -> np.ndarray:
    """Whether each row of two tiles has a partner that the bound leaves."""
    a, b, same = sides(pdf)
    codes, out = codes_of(pdf), np.zeros(len(pdf), dtype=bool)
    for p in range(0, len(a), BLOCK):
        rows = a[p : p + BLOCK]
        one = codes.part(rows)
        for q in range(p if same else 0, len(b), BLOCK):
            cols = b[q : q + BLOCK]
            near = one.near(codes.part(cols), least, sigmas)
            if same and p == q:
                near = np.triu(near, 1)
            out[rows[near.any(axis=1)]] = True
            out[cols[near.any(axis=0)]] = True
    return out


def compare(pdf: pd.DataFrame, least: float, sigmas: float | None) -> pd.DataFrame:
    """(node, links, other): for each row with links their number, copies counted, and forest edges.

    Exact cosines of the pairs of rows that the bound leaves.
    """
    a, b, same = sides(pdf)
    codes, node, copies = codes_of(pdf), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    x = scaled(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
    norm = np.sqrt((x * x).sum(axis=1))
    links, root, edges = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf)), []
    for p in range(0, len(a), BLOCK):
        rows = a[p : p + BLOCK]
        for q in range(p if same else 0, len(b), BLOCK):
            cols = b[q : q + BLOCK]
            near = codes.part(rows).near(codes.part(cols), least, sigmas)
            if same and p == q:
                near = np.triu(near, 1)
            if not near.any():
                continue
            near &= x[rows] @ x[cols].T / (norm[rows][:, None] * norm[cols][None, :]) >= least
            links[rows] += near @ copies[cols]
            links[cols] += copies[rows] @ near
            # a row's first partner outside its own tree, for all rows at once
            while True:
                open_ = near & (root[rows][:, None] != root[cols][None, :])
                found = np.flatnonzero(open_.any(axis=1))
                if not len(found):
                    break
                for u, v in zip(rows[found].tolist(), cols[open_[found].argmax(axis=1)].tolist(), strict=True):
                    if root[u] != root[v]:
                        root[root == root[v]] = root[u]
                        edges.append((node[u], node[v]))
    met = links > 0
    ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame(
        {
            "node": np.concatenate([node[met], ends[:, 0]]),
            "links": np.concatenate([links[met], np.zeros(len(ends), dtype=np.int64)]),
            "other": pd.array([None] * int(met.sum()) + ends[:, 1].tolist(), dtype="Int64"),
        }
    )


def near_duplicates(vectors: DataFrame, least: float = 0.98, sigmas: float | None = None, key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("_key"), "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    # -0.0 and 0.0 are one value in a grouping
    rows = rows.withColumn("digest", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")), F.col("label").cast("string")), 256)))
    one = (
        rows.where("sound")
        .groupBy("digest")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("_key").alias("first"), F.count("*").alias("copies"))
    )
    # numbers that name the written rows
    distinct = table(one.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding"), "embedding": v}), "vectors")
    codes = table(encoded(distinct), "vector-codes")
    # one row for each label and length
    kinds = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = codes.join(F.broadcast(kinds) if kinds.count() < 10_000 else kinds, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    tasks = dealt.select("label", "dim", "tile", "node", "bits", "factors", F.inline(pairs))
    by = ["label", "dim", "i", "j"]

    def rule_out(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[survivors(pdf, least, sigmas)]

    fields = ", ".join(f"{c} {tasks.schema[c].dataType.simpleString()}" for c in tasks.columns)
    left = table(tasks.groupBy(*by).applyInPandas(rule_out, fields), "vector-survivors")
    met = left.join(distinct.select("node", "copies", "embedding"), "node")
    out = table(met.groupBy(*by).applyInPandas(lambda pdf: compare(pdf, least, sigmas), "node bigint, links bigint, other bigint"), "vector-links")
    links = out.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(out.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    by_node = distinct.select("node", "digest", "first", "copies").join(links, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written, so that a large group can be split in the join that follows
    least_key = table(by_node.groupBy("component").agg(F.min("first").alias("least")), "vector-least")
    by_node = table(by_node.join(least_key, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least"), "vector-groups")
    # rows that cannot link do not go through the join
    alone = rows.where("not sound").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("least"))
    linked = rows.where("sound").join(by_node, "digest").select("_key", "n_links", "least")
    return alone.unionByName(linked).select(F.col("_key").alias(key), "n_links", F.col("least").alias("component_id"), F.col("_key").eqNullSafe(F.col("least")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: links and group of every vector."""
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


#: All pairs of a label by brute force, and the smallest id reachable.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       min(r.reached) AS component_id, e.vec_id = min(r.reached) AS kept
FROM embeddings e JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id
"""
