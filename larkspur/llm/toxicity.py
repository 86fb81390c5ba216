"""Operator 10: a convolutional text classifier, trained in numpy.

Words (runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased) are hashed
twice into two embedding tables; a word's embedding is the pair. Filters of one, two and three
words run over the whole text, each filter keeps its largest activation, and a logistic layer scores
them. The first component of a word's embedding starts at its log odds in the training texts, so
that a few hundred labels are enough; words of fewer than three training texts, or spread as chance would have it, stay at zero. Training sees at most `most_docs` labelled texts and `most_words` words (the bound of the
fit); scoring sees every word of every text, long ones in overlapping pieces, which gives the same
maxima.

The threshold is calibrated by language. The language is guessed from the words themselves (lists
of function words), never read from a column; every language's threshold is moved to a score of
0.5. Labels are learned only from rows in the training folds.

Results in odd cases: a null or empty text has the score of a text without any word; labels that
are null are ignored, and repeated labels of a document count by their mean, a tie as toxic; of rows that share a
labelled id one is learned; a table without labels of both kinds gives the score 0 everywhere; repeated rows
get the same score; an empty table gives an empty result; other columns pass through, but one named
like the score is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, table, unused
from .text import ALNUM, WordIds, hash_ids, texts, two_hashes

BITS = 16
SIZE = 1 << BITS
DIM, WIDTHS, FILTERS = 4, (1, 2, 3), 8
PIECE = 50_000

# Fixed lists of function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with this be at by from".split(),
    "fr": "le la les des et un une est que qui dans pour pas au aux du avec".split(),
    "de": "der die das und ist nicht ein eine den dem mit von zu im auch für".split(),
    "es": "el los las del que en un una es por con para se no al lo como".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]
#: Word (as bytes) -> set of languages as bits.
_LANG_BITS: dict[bytes, int] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words:
        _LANG_BITS[_w.encode()] = _LANG_BITS.get(_w.encode(), 0) | 1 << _i


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


def word_id(word: bytes, hashed=two_hashes(BITS)) -> int:
    """Both hashes, and above them the languages that the word speaks for."""
    return hashed(word) | _LANG_BITS.get(word, 0) << 2 * BITS


def language(ids: np.ndarray) -> int:
    """The language with most function words; the last for none."""
    bits = ids >> 2 * BITS
    bits = bits[bits > 0]
    if not len(bits):
        return len(LANGS) - 1
    return int(np.argmax([np.count_nonzero(bits >> i & 1) for i in range(len(FUNCTION_WORDS))]))


def embed(tables: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Both tables' rows side by side."""
    return np.concatenate([tables[0][ids & SIZE - 1], tables[1][ids >> BITS & SIZE - 1]], axis=1)


def convolve(model: dict, x: np.ndarray, width: int) -> np.ndarray:
    """Activations of the filters of a width at every place, from padded embeddings."""
    w, n = model[f"w{width}"], len(x) - width + 1
    out = x[:n] @ w[0]
    for j in range(1, width):
        out += x[j : n + j] @ w[j]
    return out


def pooled(model: dict, ids: np.ndarray) -> np.ndarray:
    """The largest activation of every filter over a whole text, piece by piece."""
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
    pad = np.zeros((WIDTHS[-1] - 1, 2 * DIM), dtype=np.float32)
    for at in range(0, max(1, len(ids)), PIECE):
        x = embed(model["tables"], ids[at : at + PIECE + WIDTHS[-1] - 1])
        if at + PIECE >= len(ids):
            x = np.concatenate([x, pad])
        for k, width in enumerate(WIDTHS):
            top = convolve(model, x, width).max(axis=0) if len(x) >= width else pad[0, :0]
            if len(top):
                best[k * FILTERS : (k + 1) * FILTERS] = np.maximum(best[k * FILTERS : (k + 1) * FILTERS], top)
    return np.maximum(best + model["bias"], 0)


def logit(model: dict, ids: np.ndarray) -> float:
    return float(pooled(model, ids) @ model["out"] + model["out_bias"])


def train(samples: list[tuple[np.ndarray, float]], steps: int = 12_000, seed: int = 7) -> dict | None:
    """Fit on (word ids, label) pairs; Adam over single texts, gradients through the maxima only."""
    y = np.array([s[1] for s in samples], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, 2, SIZE))  # table, label, bucket: texts with a word in it
    for ids, label in samples:
        both = np.unique(ids & SIZE * SIZE - 1)
        for t, b in enumerate((both & SIZE - 1, both >> BITS)):
            seen[t, int(label), np.unique(b)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((seen[:, 1] + 0.25) / (n1 + 0.5)) - np.log((seen[:, 0] + 0.25) / (n0 + 0.5))
    # likelihood ratio of each bucket against chance: what chance explains is left at zero
    n = seen.sum(axis=1)
    tail = lambda k, m: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(m, 1e-9)), 0)
    ratio = 2 * (tail(seen[:, 1], n * n1 / len(y)) + tail(seen[:, 0], n * n0 / len(y)))
    known = (n >= 3) & (ratio > 8)
    odds *= np.clip((ratio - 8) / 16, 0, 1)
    tables = np.zeros((2, SIZE, DIM), dtype=np.float32)
    tables[..., 0] = np.where(known, np.clip(odds, -4, 4), 0)
    tables[..., 1:] = np.where(known[..., None], rng.normal(0, 0.05, (2, SIZE, DIM - 1)), 0)
    model = {"tables": tables, "bias": np.full(len(WIDTHS) * FILTERS, -1.0, dtype=np.float32)}
    for width in WIDTHS:
        w = rng.normal(0, 0.1, (width, 2 * DIM, FILTERS)).astype(np.float32)
        # a filter begins by summing the odds of both tables, at one of its places
        for f in range(FILTERS):
            w[f % width, 0, f] += 0.5
            w[f % width, DIM, f] += 0.5
        model[f"w{width}"] = w
    model["out"] = np.full(len(WIDTHS) * FILTERS, 0.15, dtype=np.float32)
    model["out_bias"] = np.float32(-2.0)
    names = ["bias", "out", *(f"w{w}" for w in WIDTHS)]
    first, second = ({n: np.zeros_like(model[n]) for n in names} for _ in range(2))
    pad = np.zeros((WIDTHS[-1] - 1, 2 * DIM), dtype=np.float32)
    weight = {1.0: float(min(3.0, n0 / n1)), 0.0: 1.0}
    step = 0
    for epoch in range(min(14, max(3, steps // len(samples)))):
        rate = 0.02 / (1 + 0.3 * epoch)
        for i in rng.permutation(len(samples)):
            ids, label = samples[i]
            x = np.concatenate([embed(tables, ids), pad])
            tops, places = [], []
            for width in WIDTHS:
                z = convolve(model, x, width)
                at = z.argmax(axis=0)
                places.append(at)
                tops.append(z[at, np.arange(FILTERS)])
            raw = np.concatenate(tops) + model["bias"]
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_bias"], -30, 30)))
            d = np.float32((p - label) * weight[float(label)])
            grads = {"out": d * hidden + 1e-4 * model["out"], "bias": d * model["out"] * (raw > 0)}
            back = np.zeros_like(x)
            for k, width in enumerate(WIDTHS):
                g = grads["bias"][k * FILTERS : (k + 1) * FILTERS]
                gw = np.empty_like(model[f"w{width}"])
                for j in range(width):
                    rows = x[places[k] + j]  # filters x inputs
                    gw[j] = (rows * g[:, None]).T
                    np.add.at(back, places[k] + j, model[f"w{width}"][j].T * g[:, None])
                grads[f"w{width}"] = gw + 1e-4 * model[f"w{width}"]
            step += 1
            for n in names:
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.001 * (grads[n] ** 2 - second[n])
                model[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-6)
            model["out_bias"] -= np.float32(0.1 * rate * d)
            touched = np.flatnonzero(np.abs(back[: len(ids)]).sum(axis=1))
            for at in touched:
                for t, b in enumerate((ids[at] & SIZE - 1, ids[at] >> BITS & SIZE - 1)):
                    if known[t, b]:
                        tables[t, b] -= rate * back[at, t * DIM : (t + 1) * DIM]
    calibrate(model, samples, y)
    return model


def calibrate(model: dict, samples: list[tuple[np.ndarray, float]], y: np.ndarray) -> None:
    """Thresholds of the logit by language, each drawn to the common one as its positives are few."""
    z = np.array([logit(model, ids) for ids, _ in samples])
    lang = np.array([language(ids) for ids, _ in samples])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        zs, ys = z[order], y[order]
        # F1 of calling everything from place i on toxic
        hits = ys[::-1].cumsum()[::-1]
        f1 = 2 * hits / (np.arange(len(ys), 0, -1) + ys.sum())
        i = int(np.argmax(f1))
        return float(zs[i] if i == 0 else (zs[i] + zs[i - 1]) / 2)

    common = best(z, y)
    cuts = []
    for k in range(len(LANGS)):
        own = lang == k
        positives = y[own].sum()
        share = positives / (positives + 20)
        cuts.append(common if share == 0 else share * best(z[own], y[own]) + (1 - share) * common)
    model["cuts"] = np.array(cuts)


def probability(model: dict | None, ids: np.ndarray) -> float:
    if model is None:
        return 0.0
    z = (logit(model, ids) if len(ids) else float(np.maximum(model["bias"], 0) @ model["out"] + model["out_bias"])) - model["cuts"][language(ids)]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_order, label, n, ids): the word ids of whole texts, for the fit."""
    ids = WordIds(word_id)
    for batch in batches:
        rows = [hash_ids(t.translate(ALNUM).split(), ids) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("label"), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["_order", "label", "n", "ids"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most_docs: int, key: str = "doc_id") -> DataFrame:
    """(text, label, _order) of the first most_docs labelled ids of the training folds, in hash order; one row
    for each id, whatever rows share it."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    order = F.xxhash64(F.col("_key"))
    chosen = marks.where(F.crc32(F.col("_key").cast("string")) % 5 != 0).orderBy(order, "_key").limit(most_docs)
    rows = docs.select(F.col(key).alias("_key"), "text").join(chosen, "_key")
    one = rows.groupBy("_key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("t.text", "label", F.xxhash64("_key", "t.text").alias("_order"))


def bounded(rows: DataFrame, size: str, most: int) -> DataFrame:
    """The rows, shortest first, whose sizes add up to no more than most. rows has a row for each labelled text at most."""
    w = Window.orderBy(size, "_order").rowsBetween(Window.unboundedPreceding, 0)
    placed = table(rows, "labelled-texts")
    upto = placed.select("_order", size).withColumn("_upto", F.sum(size).over(w)).where(F.col("_upto") <= most)
    return placed.join(F.broadcast(upto.select("_order").distinct()), "_order", "left_semi")  # most_docs numbers


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 3000, most_words: int = 2_000_000) -> dict | None:
    """Train on at most most_docs texts and most_words words in all: the shortest texts that these allow.

    Both bounds hold before anything is collected, so the driver gets most_words numbers at most.
    """
    got = labelled(docs, labels, "toxic", most_docs).mapInArrow(features, "_order bigint, label double, n bigint, ids array<bigint>").where("n > 0")
    pool = bounded(got, "n", most_words).orderBy("n", "_order").toArrow()
    ids = pool.column("ids").combine_chunks()
    flat, ends = ids.flatten().to_numpy(), np.cumsum(pool.column("n").to_numpy())
    return train([(flat[b - n : b], y) for n, b, y in zip(pool.column("n").to_pylist(), ends.tolist(), pool.column("label").to_pylist(), strict=True)])


def score(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, most_docs: int = 3000, name: str = "score") -> DataFrame:
    """docs with a column for the score (0 to 1); other columns pass through."""
    model = fit(docs if train_docs is None else train_docs, labels, most_docs)
    # two tables of 2^16 rows: a fixed size
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    keep = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = pickle.loads(shared.value), WordIds(word_id)
        for batch in batches:
            scores = [probability(own, hash_ids(t.translate(ALNUM).split(), ids)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, name])

    fields = docs.select(*keep).schema
    return docs.select(*keep).mapInArrow(run, fields.add(name, "double"))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents that score below the cut."""
    name = unused(docs, "_toxicity")
    return score(docs, labels, name=name).where(F.col(name) < cut).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the toxicity score of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
