"""Operator 9: quality by voting of the nearest labelled texts.

A text becomes a latent-semantic vector: hashed words, and signs of its form (word shapes, shares
of repeated words and lines, of capitals and of punctuation), weighted by tf-idf and projected on the
leading singular vectors of the labelled texts. The labelled texts' vectors are broadcast; every document is compared with
all of them by exact cosines, in blocks, and the nearest vote with their labels, weighted by
similarity. The fit sees at most `most_docs` labelled texts of the training folds (its documented
bound, with `most_terms` terms in all); every document is scored on its whole text, however long.

The score is the weighted vote of the labels, moved so that 0.3 is the cut that suits the training
labels best.

Results in odd cases: a null or empty text has no direction and gets the share of good labels;
null labels are ignored, and repeated labels of a document count by their mean, a tie as good; of rows that
share a labelled id one is learned; neighbours that tie with the last one vote too; without labels of
both kinds every score is 0.5; repeated rows get the same score; an empty table gives an empty result;
other columns pass through, but for the text and one named score, which is replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .text import WordIds, texts
from .toxicity import bounded, fold, labelled

WORDS, SHAPES = 1 << 15, 1 << 11
RANK, NEIGHBOURS, BLOCK = 48, 25, 512
CUT = 0.3
_LETTERS, _CAPITALS, _DIGITS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")


def term(word: bytes) -> int:
    """Bucket of a word's letters, and above it the bucket of its shape."""
    shape = _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word)))[:12]
    plain = word.lower().strip(b".,;:!?()[]\"'*$%&#|")
    return zlib.crc32(plain) % WORDS | (zlib.crc32(shape) % SHAPES) << 15


def terms(text: bytes, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a whole text: words from 0, forms from WORDS."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    both = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    w, n = np.unique(both & WORDS - 1, return_counts=True)
    s, m = np.unique(both >> 15, return_counts=True)
    lines = [x for x in text.split(b"\n") if x]
    capitals = sum(x.isupper() for x in words)
    marks = len(text) - len(text.translate(None, b".,;:!?()[]\"'*$%&#|@<>{}=+/\\~^_-"))
    signs = (
        len(set(words)) / len(words),
        len(set(lines)) / max(1, len(lines)),
        capitals / len(words),
        min(1.0, 4 * marks / len(text)),
        min(1.0, len(text) / len(words) / 20),
        min(1.0, np.log2(len(words)) / 16),
    )
    # each sign as a term of its tenth
    form = [SHAPES + 11 * k + int(10 * x) for k, x in enumerate(signs)]
    places = np.concatenate([w, s + WORDS, np.array(form) + WORDS])
    weights = np.concatenate([np.sqrt(n / len(words)), np.sqrt(m / len(words)), np.full(len(form), 0.5)])
    return places, weights


SPACE = WORDS + SHAPES + 11 * 6


class Space:
    """idf, projection and the labelled vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3):
        n = len(rows)
        df = np.bincount(np.concatenate([p for p, _ in rows]), minlength=SPACE)
        self.idf = np.where(df > 0, np.log((n + 1) / (df + 0.5)).clip(0.05), 0.0).astype(np.float32)
        matrix = [(p, self.weigh(p, w)) for p, w in rows]

        def times(m: np.ndarray) -> np.ndarray:  # A m, a row at a time
            return np.stack([v @ m[p] for p, v in matrix])

        def back(m: np.ndarray) -> np.ndarray:  # A' m; the terms of a row are distinct
            out = np.zeros((SPACE, m.shape[1]))
            for (p, v), x in zip(matrix, m):
                out[p] += v[:, None] * x
            return out

        # randomised singular vectors with two power steps
        rank = min(RANK, n)
        q = np.linalg.qr(times(np.random.default_rng(seed).normal(size=(SPACE, rank + 8))))[0]
        for _ in range(2):
            q = np.linalg.qr(times(np.linalg.qr(back(q))[0]))[0]
        _, _, vt = np.linalg.svd(back(q).T, full_matrices=False)
        self.axes = vt[:rank].T.astype(np.float32)
        self.vectors = np.stack([self.vector(p, w) for p, w in rows])
        self.labels = y.astype(np.float32)
        self.prior = float(y.mean())
        self.shift = 0.0
        # every labelled text judged by the others
        votes = self.vote(self.vectors, leave=np.arange(n))
        self.shift = best_cut(votes, y) - CUT

    def weigh(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """tf-idf with the words' part and the forms' part of fixed lengths."""
        v = weights * self.idf[places]
        form = places >= WORDS
        for part, length in ((~form, 0.4), (form, 1.0)):
            norm = np.sqrt((v[part] ** 2).sum())
            v[part] *= length / norm if norm else 0.0
        return v

    def vector(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        v = (self.axes[places] * self.weigh(places, weights)[:, None]).sum(axis=0)
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).astype(np.float32)

    def vote(self, x: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
        """Weighted votes of the nearest labelled vectors, before the shift; nan without direction."""
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.vectors) - (leave is not None))
        for at in range(0, len(x), BLOCK):
            near = x[at : at + BLOCK] @ self.vectors.T
            if leave is not None:
                near[np.arange(len(near)), leave[at : at + BLOCK]] = -2
            if not k:
                out[at : at + BLOCK] = np.nan
                continue
            # all that are as near as the last of the k vote, so that ties do not hang on an order
            last = np.partition(near, -k, axis=1)[:, -k, None]
            weight = np.where(near >= last, np.clip(near, 1e-6, None) ** 4, 0)
            out[at : at + BLOCK] = weight @ self.labels / np.maximum(weight.sum(axis=1), 1e-30)
        out[~x.any(axis=1)] = np.nan
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        v = self.vote(x)
        cut = CUT + self.shift
        # a line through (0, 0), (cut, CUT) and (1, 1)
        v = np.where(v < cut, v * CUT / max(cut, 1e-6), CUT + (v - cut) * (1 - CUT) / max(1 - cut, 1e-6))
        return np.where(np.isnan(v), self.prior, np.clip(v, 0, 1))


def best_cut(votes: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best mean of both labels' shares of right calls."""
    votes = np.nan_to_num(votes, nan=float(y.mean()))
    tries = np.linspace(0.1, 0.9, 33)
    right = [((votes >= c) & (y == 1)).sum() / max(1, (y == 1).sum()) + ((votes < c) & (y == 0)).sum() / max(1, (y == 0).sum()) for c in tries]
    good = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    return float(tries[good[len(good) // 2]])


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 2000, most_terms: int = 4_000_000) -> Space | None:
    """The space of at most most_docs labelled texts with most_terms distinct terms in all, the shortest that these allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(term)
        for batch in batches:
            rows = [terms(t, ids) for t in texts(batch, "text")]
            cols = [batch.column("_order"), batch.column("label"), pa.array([p for p, _ in rows], pa.list_(pa.int64())), pa.array([w for _, w in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["_order", "label", "places", "weights"])

    got = labelled(docs, labels, "quality", most_docs).mapInArrow(run, "_order bigint, label double, places array<bigint>, weights array<double>")
    sized = bounded(got.withColumn("n", F.size("places").cast("long")).where("n > 0"), "n", most_terms)
    pool = sorted((r["_order"], r["label"], r["places"], r["weights"]) for r in sized.drop("n").toLocalIterator())
    y = np.array([r[1] for r in pool])
    if not len(y) or y.min() == y.max():
        return None
    return Space([(np.array(r[2]), np.array(r[3])) for r in pool], y)


def score(docs: DataFrame, labels: DataFrame, most_docs: int = 2000) -> DataFrame:
    """docs without the text, with score (0 to 1)."""
    space = fit(docs, labels, most_docs)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(space))  # SPACE x RANK and most_docs x RANK floats
    keep = [c for c in docs.columns if c not in ("score", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = pickle.loads(shared.value), WordIds(term)
        for batch in batches:
            if own is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                x = [own.vector(*terms(t, ids)) for t in texts(batch, "text")]
                scores = own.score(np.stack(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the quality score of every document."""
    scored = score(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
