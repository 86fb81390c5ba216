"""A causal transformer over item sequences: encoding of contexts, its losses with gradients, and its training.

An item enters as a vector of its own and one of its genres, both through one projection, with a vector of its
place. Layers of masked attention and of two dense maps follow, each normalised after its sum with what went in;
a last norm gives a vector for each position, which sees the items up to it. Scores are inner products with the
items' own vectors; item 0 is padding, whose vector is zero.

Training adds the cross entropy of every position's next item and the contrastive loss between two
readings of a sequence with a share of its items masked. Tasks compute losses and gradients of their
windows in batches; gradients come in chunks, which Spark adds up by chunk, so that one sum of the
model's size reaches the driver, where Adam steps. Masks and dropped cells are drawn from hashes of epoch and window.
The weights are sent to every task: MOST_NUMBERS bounds them, and a larger model is refused.
Encoding does not need the items' table in a task: items are joined with what they enter as, and only
the layers are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .sequences import BY_EVENT

Weights = dict[str, np.ndarray]
#: Numbers of a model that is sent to tasks, and of a chunk of its gradient.
MOST_NUMBERS, CHUNK = 64_000_000, 1 << 16
EPS = 1e-5


@dataclass(frozen=True)
class Shape:
    """Sizes of the model, and what its training uses."""

    items: int
    genres: int
    width: int = 128
    heads: int = 2
    layers: int = 2
    length: int = 100
    dropout: float = 0.2
    masked: float = 0.2
    temperature: float = 0.1
    contrast: float = 0.1
    rate: float = 1e-3
    clip: float = 5.0
    patience: int = 10


def drawn(s: Shape, seed: int = 42) -> Weights:
    """Weights to start from."""
    rng, d = np.random.default_rng(seed), s.width
    dense = lambda i, o: rng.normal(0, (2 / (i + o)) ** 0.5, (i, o))
    w = {"item": rng.normal(0, d**-0.5, (s.items + 1, d)), "genre": dense(s.genres, d), "genre_b": np.zeros(d), "into": dense(2 * d, d), "into_b": np.zeros(d), "place": rng.normal(0, d**-0.5, (s.length, d))}
    w["item"][0] = 0
    for k in range(s.layers):
        w |= {f"{k}.qkv": dense(d, 3 * d), f"{k}.qkv_b": np.zeros(3 * d), f"{k}.out": dense(d, d), f"{k}.out_b": np.zeros(d)}
        w |= {f"{k}.up": dense(d, 4 * d), f"{k}.up_b": np.zeros(4 * d), f"{k}.down": dense(4 * d, d), f"{k}.down_b": np.zeros(d)}
        w |= {f"{k}.norm1": np.ones(d), f"{k}.norm1_b": np.zeros(d), f"{k}.norm2": np.ones(d), f"{k}.norm2_b": np.zeros(d)}
    w |= {"norm": np.ones(d), "norm_b": np.zeros(d)}
    if (n := sum(x.size for x in w.values())) > MOST_NUMBERS:
        raise ValueError(f"a model of {n} numbers is not sent to tasks; {MOST_NUMBERS} is the most")
    return w


def normed(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    mean = x.mean(axis=-1, keepdims=True)
    off = x - mean
    size = 1 / np.sqrt((off * off).mean(axis=-1, keepdims=True) + EPS)
    unit = off * size
    return unit * g + b, (unit, size, g)


def normed_back(dy: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unit, size, g = kept
    du = dy * g
    dx = size * (du - du.mean(axis=-1, keepdims=True) - unit * (du * unit).mean(axis=-1, keepdims=True))
    axes = tuple(range(dy.ndim - 1))
    return dx, (dy * unit).sum(axis=axes), dy.sum(axis=axes)


def add(g: Weights, name: str, value: np.ndarray) -> None:
    g[name] = g[name] + value if name in g else value


def kept_cells(shape: tuple, share: float, rng: np.random.Generator | None) -> np.ndarray | float:
    """1 / (1 - share) where a cell stays, else 0; 1 when nothing is dropped."""
    return 1.0 if rng is None or not share else (rng.random(shape) >= share) / (1 - share)


def split(x: np.ndarray, heads: int) -> np.ndarray:
    n, length, d = x.shape
    return x.reshape(n, length, heads, d // heads).transpose(0, 2, 1, 3)


def joined(x: np.ndarray) -> np.ndarray:
    n, h, length, d = x.shape
    return x.transpose(0, 2, 1, 3).reshape(n, length, h * d)


def body(w: Weights, s: Shape, x: np.ndarray, real: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """(n, length, width) vectors of all positions, from what items enter as; padded positions are not real.

    A position sees the real ones up to it, and itself. Also returns what body_back() needs.
    """
    n, length, d = x.shape
    drop = kept_cells(x.shape, s.dropout, rng)
    x = (x + w["place"][:length]) * drop
    tape = [drop]
    seen = np.tril(np.ones((length, length), dtype=bool)) & (real[:, None, None, :] | np.eye(length, dtype=bool))
    for k in range(s.layers):
        q, key, v = (split(p, s.heads) for p in np.split(x @ w[f"{k}.qkv"] + w[f"{k}.qkv_b"], 3, axis=-1))
        scores = np.where(seen, q @ key.transpose(0, 1, 3, 2) / (d // s.heads) ** 0.5, -np.inf)
        a = np.exp(scores - scores.max(axis=-1, keepdims=True))
        a /= a.sum(axis=-1, keepdims=True)
        heads = joined(a @ v)
        drop1, drop2 = kept_cells(x.shape, s.dropout, rng), kept_cells(x.shape, s.dropout, rng)
        y, norm1 = normed(x + (heads @ w[f"{k}.out"] + w[f"{k}.out_b"]) * drop1, w[f"{k}.norm1"], w[f"{k}.norm1_b"])
        up = np.maximum(y @ w[f"{k}.up"] + w[f"{k}.up_b"], 0)
        z, norm2 = normed(y + (up @ w[f"{k}.down"] + w[f"{k}.down_b"]) * drop2, w[f"{k}.norm2"], w[f"{k}.norm2_b"])
        tape.append((x, q, key, v, a, heads, drop1, norm1, y, up, drop2, norm2))
        x = z
    out, norm = normed(x, w["norm"], w["norm_b"])
    return out, [*tape, norm]


def dense_back(g: Weights, name: str, x: np.ndarray, dy: np.ndarray, w: Weights) -> np.ndarray:
    flat, grad = x.reshape(-1, x.shape[-1]), dy.reshape(-1, dy.shape[-1])
    add(g, name, flat.T @ grad)
    add(g, f"{name}_b", grad.sum(axis=0))
    return dy @ w[name].T


def body_back(w: Weights, s: Shape, tape: list, dout: np.ndarray, g: Weights) -> np.ndarray:
    """Gradient by what items enter as; those by the weights are added to g."""
    drop, *layers, norm = tape
    dx, dg, db = normed_back(dout, norm)
    add(g, "norm", dg)
    add(g, "norm_b", db)
    for k in range(s.layers - 1, -1, -1):
        x, q, key, v, a, heads, drop1, norm1, y, up, drop2, norm2 = layers[k]
        dy, dg, db = normed_back(dx, norm2)
        add(g, f"{k}.norm2", dg)
        add(g, f"{k}.norm2_b", db)
        dup = dense_back(g, f"{k}.down", up, dy * drop2, w) * (up > 0)
        dy = dy + dense_back(g, f"{k}.up", y, dup, w)
        dx, dg, db = normed_back(dy, norm1)
        add(g, f"{k}.norm1", dg)
        add(g, f"{k}.norm1_b", db)
        dheads = split(dense_back(g, f"{k}.out", heads, dx * drop1, w), s.heads)
        da = dheads @ v.transpose(0, 1, 3, 2)
        ds = a * (da - (da * a).sum(axis=-1, keepdims=True)) / q.shape[-1] ** 0.5
        parts = [ds @ key, ds.transpose(0, 1, 3, 2) @ q, a.transpose(0, 1, 3, 2) @ dheads]
        dx = dx + dense_back(g, f"{k}.qkv", x, np.concatenate([joined(p) for p in parts], axis=-1), w)
    dx = dx * drop
    place = np.zeros_like(w["place"])
    place[: dx.shape[1]] = dx.sum(axis=0)
    add(g, "place", place)
    return dx


def entered(w: Weights, ids: np.ndarray, genres: np.ndarray) -> np.ndarray:
    """What items enter as: (..., width) of item numbers and their genres' flags."""
    return np.concatenate([w["item"][ids], genres @ w["genre"] + w["genre_b"]], axis=-1) @ w["into"] + w["into_b"]


def entered_back(w: Weights, ids: np.ndarray, genres: np.ndarray, dx: np.ndarray, g: Weights) -> None:
    d = w["item"].shape[1]
    both = np.concatenate([w["item"][ids], genres @ w["genre"] + w["genre_b"]], axis=-1)
    dboth = dense_back(g, "into", both, dx, w)
    dense_back(g, "genre", genres, dboth[..., d:], w)
    item = np.zeros_like(w["item"])
    np.add.at(item, ids.ravel(), dboth[..., :d].reshape(-1, d))
    add(g, "item", item)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def cross_entropy(w: Weights, s: Shape, ids: np.ndarray, genres: np.ndarray, labels: np.ndarray, g: Weights | None = None, rng: np.random.Generator | None = None) -> tuple[float, int]:
    """(sum over positions with a label, their number); gradients of the sum are added to g."""
    h, tape = body(w, s, entered(w, ids, genres[ids]), ids != 0, rng)
    told = labels != 0
    own = h[told]
    logs = log_softmax(own @ w["item"].T)
    at = labels[told]
    loss = -float(logs[np.arange(len(at)), at].sum())
    if g is not None:
        dlogits = np.exp(logs)
        dlogits[np.arange(len(at)), at] -= 1
        dh = np.zeros_like(h)
        dh[told] = dlogits @ w["item"]
        add(g, "item", dlogits.T @ own)
        entered_back(w, ids, genres[ids], body_back(w, s, tape, dh, g), g)
    return loss, int(told.sum())


def contrastive(w: Weights, s: Shape, one: np.ndarray, other: np.ndarray, last: np.ndarray, genres: np.ndarray, g: Weights | None = None, scale: float = 1.0, rng: np.random.Generator | None = None) -> float:
    """Sum over both readings of the loss of finding a sequence's other reading among all of the batch; last: its last position."""
    ids = np.concatenate([one, other])
    n, at = len(one), np.concatenate([last, last])
    h, tape = body(w, s, entered(w, ids, genres[ids]), ids != 0, rng)
    v = h[np.arange(2 * n), at]
    size = np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    unit = v / size
    sims = unit @ unit.T / s.temperature
    np.fill_diagonal(sims, -np.inf)
    pair = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    logs = log_softmax(sims)
    loss = -float(logs[np.arange(2 * n), pair].sum())
    if g is not None:
        ds = np.exp(logs)
        ds[np.arange(2 * n), pair] -= 1
        ds *= scale / s.temperature
        du = (ds + ds.T) @ unit
        dv = (du - unit * (du * unit).sum(axis=1, keepdims=True)) / size
        dh = np.zeros_like(h)
        dh[np.arange(2 * n), at] = dv
        entered_back(w, ids, genres[ids], body_back(w, s, tape, dh, g), g)
    return loss


def batched(sequences: list, length: int) -> np.ndarray:
    """(n, longest) item numbers, padded with 0 on the right; of longer sequences the last `length`."""
    cut = [np.asarray(x, dtype=np.int64)[-length:] for x in sequences]
    out = np.zeros((len(cut), max(map(len, cut), default=0)), dtype=np.int64)
    for i, x in enumerate(cut):
        out[i, : len(x)] = x
    return out


# --- encoding


def entries(items: DataFrame, w: Weights, item: str = "movie_id") -> DataFrame:
    """(item, vec) of items (item, item_idx, genres): what each enters as. genres are the numbers of its genres, from 0."""
    shared = items.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flags = np.zeros((len(pdf), len(shared.value["genre"])))
            for i, many in enumerate(pdf["genres"]):
                flags[i, np.asarray(many, dtype=np.int64)] = 1
            yield pd.DataFrame({item: pdf[item], "vec": list(entered(shared.value, pdf["item_idx"].to_numpy(), flags))})

    return items.select(item, "item_idx", "genres").mapInPandas(run, f"{item} bigint, vec array<double>")


def layers(w: Weights) -> Weights:
    """The weights that encoding sends to tasks: all but those of items and genres."""
    return {k: v for k, v in w.items() if k not in ("item", "genre", "genre_b", "into", "into_b")}


def encode_all(w: Weights, s: Shape, contexts: list[np.ndarray]) -> np.ndarray:
    """(n, width): the last position's vector of each context of entered items, one padded batch for all."""
    sizes = np.array([len(c) for c in contexts])
    x = np.zeros((len(contexts), sizes.max(initial=0), s.width))
    for i, c in enumerate(contexts):
        x[i, : len(c)] = c
    h, _ = body(w, s, x, np.arange(x.shape[1]) < sizes[:, None])
    return h[np.arange(len(contexts)), sizes - 1]


# --- training


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradient(w: Weights, s: Shape, ids: np.ndarray, labels: np.ndarray, genres: np.ndarray, rng: np.random.Generator | None, masks: np.ndarray | None) -> tuple[Weights, np.ndarray]:
    """Sums over a batch: gradients, and (cross entropy, positions, contrastive, readings); masks: (2, n, length) masked cells.

    The gradients of the two losses stand apart, as each is divided by its own number.
    """
    g: Weights = {}
    ce, n = cross_entropy(w, s, ids, genres, labels, g, rng)
    h: Weights = {}
    cl = 0.0
    if masks is not None:
        last = (ids != 0).sum(axis=1) - 1
        cl = contrastive(w, s, np.where(masks[0], 0, ids), np.where(masks[1], 0, ids), last, genres, h, 1.0, rng)
    return {**{f"a/{k}": v for k, v in g.items()}, **{f"b/{k}": v for k, v in h.items()}}, np.array([ce, n, cl, 2 * len(ids) * (masks is not None)])


def summed(windows: DataFrame, w: Weights, s: Shape, genres: np.ndarray, epoch: int, batch: int) -> tuple[Weights, np.ndarray]:
    """The gradient of the mean losses over all windows (window, input, label), and their sums; the windows'
    order in a task is that of their hash, as batches and draws hang on it."""
    shared = windows.sparkSession.sparkContext.broadcast((w, genres))
    both = 2 * sum(x.size for x in w.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, flags = shared.value
        total, told, first = np.zeros(both), np.zeros(4), None
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                first = int(part["window"].iloc[0]) if first is None else first
                ids, labels = batched(part["input"].tolist(), s.length), batched(part["label"].tolist(), s.length)
                rng = np.random.default_rng([epoch, int(part["window"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
                masks = rng.random((2, *ids.shape)) < s.masked if s.contrast else None
                g, sums = gradient(own, s, ids, labels, flags, rng if s.dropout else None, masks)
                zero = {k: np.zeros_like(v) for k, v in own.items()}
                total[: both // 2] += flat(zero | {k[2:]: v for k, v in g.items() if k[0] == "a"})
                total[both // 2 :] += flat(zero | {k[2:]: v for k, v in g.items() if k[0] == "b"})
                told += sums
        if first is not None:
            values = np.concatenate([told, total])
            yield pd.DataFrame({"chunk": np.arange(-(-len(values) // CHUNK)), "task": first, "values": [values[k : k + CHUNK] for k in range(0, len(values), CHUNK)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        # in the order of tasks, so that the sum is the same in every run
        rows = pdf.sort_values("task")["values"]
        out = np.zeros(len(rows.iloc[0]))
        for x in rows:
            out += x
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "values": [out]})

    parts = windows.mapInPandas(run, "chunk bigint, task bigint, values array<double>")
    # one sum of the model's size
    rows = parts.groupBy("chunk").applyInPandas(added, "chunk bigint, values array<double>").orderBy("chunk").collect()
    shared.unpersist()
    if not rows:
        return {k: np.zeros_like(v) for k, v in w.items()}, np.zeros(4)
    values = np.concatenate([r["values"] for r in rows])
    told, total = values[:4], values[4:]
    grads = total[: both // 2] / max(told[1], 1) + s.contrast * total[both // 2 :] / max(told[3], 1)
    out = shaped(grads, w)
    out["item"][0] = 0
    return out, told


class Adam:
    """Steps by gradients whose size is clipped."""

    def __init__(self, s: Shape, n: int):
        self.s, self.m, self.v, self.t = s, np.zeros(n), np.zeros(n), 0

    def step(self, w: Weights, g: Weights) -> Weights:
        d = flat(g)
        d *= min(1.0, self.s.clip / (np.sqrt(d @ d) + 1e-6))
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * d
        self.v = 0.999 * self.v + 0.001 * d * d
        step = self.s.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return shaped(flat(w) - step, w)


def measured(windows: DataFrame, w: Weights, s: Shape, genres: np.ndarray, k: int = 10, batch: int = 256) -> tuple[float, float]:
    """Recall and NDCG at k of the last position's next item, over all windows."""
    shared = windows.sparkSession.sparkContext.broadcast((w, genres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, flags = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                ids = batched(part["input"].tolist(), s.length)
                want = np.array([x[-1] for x in part["label"]])
                last = (ids != 0).sum(axis=1) - 1
                h, _ = body(own, s, entered(own, ids, flags[ids]), ids != 0)
                scores = h[np.arange(len(ids)), last] @ own["item"].T
                mine = scores[np.arange(len(ids)), want][:, None]
                # ties go by the item's number
                rank = (scores > mine).sum(axis=1) + ((scores == mine) & (np.arange(scores.shape[1]) < want[:, None])).sum(axis=1)
                yield pd.DataFrame({"hit": (rank < k).astype(float), "gain": np.where(rank < k, 1 / np.log2(rank + 2), 0.0)})

    r = windows.mapInPandas(run, "hit double, gain double").agg(F.avg("hit"), F.avg("gain")).first()
    return (r[0] or 0.0), (r[1] or 0.0)


def pairs(windows: DataFrame) -> DataFrame:
    """(input, label) of windows (items) of item numbers: all but the last, and all but the first."""
    n = F.size("items")
    return windows.select(F.slice("items", F.lit(1), n - 1).alias("input"), F.slice("items", F.lit(2), n - 1).alias("label"))


def last_pairs(events: DataFrame, length: int, held) -> DataFrame:
    """(input, label) of each user's last `length` + 1 events (movie_id being item numbers), where the last one is held out."""
    latest = Window.partitionBy("user_id").orderBy(*(F.desc(c) for c in BY_EVENT))
    rows = events.withColumn("held", held).withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= length + 1)
    seq = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "movie_id"))).alias("e"), F.max(F.when(F.col("_n") == 1, F.col("held"))).alias("held"))
    return pairs(seq.where(F.col("held") & (F.size("e") > 1)).select(F.transform("e", lambda x: x["movie_id"]).alias("items")))


def spread(windows: DataFrame, tasks: int) -> DataFrame:
    """windows (input, label) dealt to tasks by a hash, in its order, and written: every epoch reads the same."""
    named = windows.select(F.xxhash64("input", "label").bitwiseAND(F.lit((1 << 62) - 1)).alias("window"), "input", "label")
    return written(named.repartition(tasks, "window").sortWithinPartitions("window"), "windows")


def trained(windows: DataFrame, valid: DataFrame, s: Shape, genres: np.ndarray, epochs: int, every: int = 5, steps: int = 4, batch: int = 64, tasks: int | None = None, seed: int = 42) -> tuple[Weights, list[dict]]:
    """(weights of the best epoch, history) of windows (input, label) of item numbers without padding.

    An epoch takes its windows in `steps` parts by their hash, a step of Adam for each. Every `every`-th epoch
    is measured on the valid windows; after `patience` measurements without a better recall training ends.
    genres: (items + 1, genres) flags, row 0 of zeros.
    """
    tasks = tasks or windows.sparkSession.sparkContext.defaultParallelism
    rows, held = spread(windows, tasks), spread(valid, tasks)
    w = drawn(s, seed)
    adam = Adam(s, sum(x.size for x in w.values()))
    best, least, waited, history = w, -1.0, 0, []
    for epoch in range(1, epochs + 1):
        told = np.zeros(4)
        for part in range(steps):
            own = rows.where(F.pmod(F.xxhash64("window", F.lit(epoch)), F.lit(steps)) == part)
            g, sums = summed(own, w, s, genres, epoch, batch)
            if sums[1]:
                w = adam.step(w, g)
            told += sums
        line = {"epoch": epoch, "ce": told[0] / max(told[1], 1), "cl": told[2] / max(told[3], 1), "recall": None, "ndcg": None}
        if epoch % every == 0 or epoch == epochs:
            line["recall"], line["ndcg"] = measured(held, w, s, genres)
            if line["recall"] > least:
                best, least, waited = w, line["recall"], 0
            else:
                waited += 1
        history.append(line)
        if waited >= s.patience:
            break
    return best, history


def popular(windows: DataFrame, valid: DataFrame, k: int = 10) -> float:
    """Recall at k of the k items most common in the windows' labels, to compare with."""
    top = windows.select(F.explode("label").alias("item")).groupBy("item").count().orderBy(F.desc("count"), "item").limit(k).select("item")
    last = valid.select(F.element_at("label", -1).alias("item"))
    hits = last.join(F.broadcast(top.withColumn("hit", F.lit(1.0))), "item", "left")  # k rows
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0] or 0.0


def as_arrow(history: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(history, pa.schema([("epoch", pa.int64()), *((c, pa.float64()) for c in ("ce", "cl", "recall", "ndcg"))]))
