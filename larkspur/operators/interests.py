"""Interest vectors: centroids, refits, projection, assignment by cosine, items ranked by the best interest.

Vectors that are compared as a table are spread to (pos, value) rows and summed: the join and the
sums then run as hash joins and partial aggregates on any number of executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, dot


def spread(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("pos", "x"))


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec) from (keys, pos, x) rows, in order of pos."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda p: p["x"]).alias("vec"))


#: Components up to which a group's means are the columns of one row; of longer vectors each component is a row.
WIDE = 256


def centroids(members: DataFrame, *keys: str, least: int = 1, dim: int | None = None) -> DataFrame:
    """(keys, size, vec): element-wise means of the members' vectors; label -1 (noise) is left out.

    Sums of each component are partial aggregates, so no group's vectors come together. dim is the length of
    the longest vector, where it is known: the members then stay single rows instead of one for each component.
    """
    own = members.where("label >= 0")
    if dim is not None and dim <= WIDE:
        means = F.array(*(F.avg(F.get("vec", F.lit(i))) for i in range(dim))).cast("array<double>")
        return own.groupBy(*keys).agg(F.count("*").alias("size"), F.slice(means, F.lit(1), F.max(F.size("vec"))).alias("vec")).where(F.col("size") >= least).select(*keys, "vec", "size")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    means = spread(own, "vec", *keys).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return gathered(means, *keys).join(sizes, list(keys))


def top_genres(members: DataFrame, genres: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, label, genre, hits, place): a cluster's most frequent genres; ties keep the first seen."""
    rows = members.where("label >= 0").join(genres, "movie_id").select("user_id", "label", "event_idx", F.posexplode("genres").alias("at", "genre"))
    hits = rows.groupBy("user_id", "label", "genre").agg(F.count("*").alias("hits"), F.min(F.struct("event_idx", "at")).alias("first"))
    w = Window.partitionBy("user_id", "label").orderBy(F.desc("hits"), "first")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("first")


def assigned(rows: DataFrame, interests: DataFrame, threshold: float = 0.2) -> DataFrame:
    """rows (user_id, event_id, vec) with status, interest and similarity.

    The best interest is the first of the highest cosine; below the threshold a row is an outlier that
    still names its nearest interest; a similarity that is not finite makes it an outlier of none; a
    user without interests leaves it pending.
    """
    # a user's interests are few: they travel as one array, and each row is judged by itself
    lists = interests.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("label", F.col("vec").alias("v")))).alias("of"))
    scored = rows.join(lists, "user_id", "left").withColumn("sims", F.transform("of", lambda i: cosine(F.col("vec"), i["v"])))
    bad = F.exists("sims", lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    best = F.array_max("sims")
    status = (
        F.when(F.col("of").isNull(), "pending_no_interest")
        .when(bad, "outlier_invalid")
        .when(best < threshold, "outlier")
        .otherwise("assigned")
    )
    at = F.array_position("sims", best)
    clear = F.col("of").isNotNull() & ~bad
    return scored.select("user_id", "event_id", status.alias("status"), F.when(clear, F.element_at("of", at.cast("int"))["label"]).alias("interest"), F.when(clear, best).alias("similarity"))


def refitted(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, size, vec): interests from labelled rows; where all are noise, one of the mean of all, label 0."""
    named = members.groupBy(*keys).agg(F.max("label").alias("_top"))
    rows = members.join(named, list(keys))
    rows = rows.withColumn("label", F.when(F.col("_top") < 0, F.lit(0)).otherwise(F.col("label")).cast("bigint")).drop("_top")
    return centroids(rows, *keys, "label")


def projected(rows: DataFrame, reducers: DataFrame) -> DataFrame:
    """rows (user_id, event_id, vec) with the point that their user's fitted reducer (user_id, mean, axes)
    gives them; null where the user has none."""
    off = F.zip_with("vec", "mean", lambda x, m: x - m)
    return rows.join(reducers, "user_id", "left").select("user_id", "event_id", F.transform("axes", lambda a: dot(off, a)).alias("point"))


def user_queries(interests: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, labels, vecs, seen): what best_items asks for each user with interests."""
    i = interests.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("label", F.col("vec").alias("v")))).alias("_i"))
    s = seen.groupBy("user_id").agg(F.collect_set("movie_id").alias("seen"))
    return i.join(s, "user_id", "left").select("user_id", F.transform("_i", lambda x: x["label"]).alias("labels"), F.transform("_i", lambda x: x["v"]).alias("vecs"), "seen")


#: Numbers of the item matrix that each task may hold, and of one block of scores.
MATRIX, SCORES = 16_000_000, 4_000_000


class Catalogue:
    """Item vectors as a matrix, in order of the id; items with components that are not finite take no part."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        order = np.argsort(ids, kind="stable")
        order = order[np.isfinite(vecs[order]).all(axis=1)]
        self.ids, self.vecs = ids[order], vecs[order]
        self.single = bool((np.diff(self.ids) != 0).all())

    @classmethod
    def of(cls, ids: pd.Series, vecs: pd.Series) -> Catalogue:
        return cls(ids.to_numpy(dtype=np.int64), np.stack(vecs.to_numpy()) if len(ids) else np.zeros((0, 1)))

    def best(self, labels: list, vecs: list, seen: list, k: int) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        """(query, its k best unseen items as (id, score, label)), scores to nine digits; the first label and
        the smaller id win ties."""
        alike, at = self.alike(labels, vecs), 0
        while at < len(alike) and len(self.ids):
            end, rows = at, 0
            while end < len(alike) and (end == at or (rows + len(alike[end][2])) * len(self.ids) <= SCORES):
                rows += len(alike[end][2])
                end += 1
            own = [run for run in alike[at:end] if run[2]]
            if own:
                matrix = np.stack([v for *_, sound in own for _, v in sound])
                names = np.array([lab for *_, sound in own for lab, _ in sound])
                left_out = [[] if s is None else s for first, last, _ in own for s in seen[first:last]]
                alone = [np.asarray([] if last - first > 1 or seen[first] is None else seen[first], dtype=np.int64) for first, last, _ in own]
                # queries with the same vectors are ranked once, as far as what they have seen may reach
                most = max(map(len, left_out)) if any(last - first > 1 for first, last, _ in own) else 0
                found = self.top(matrix @ self.vecs.T, names, np.array([len(sound) for *_, sound in own]), spans_of(self.ids, alone), k + most)
                left = iter(left_out)
                for (first, last, _), few in zip(own, found, strict=True):
                    for q in range(first, last):
                        gone = next(left)
                        gone = set(gone.tolist() if isinstance(gone, np.ndarray) else gone) if last - first > 1 else ()
                        yield q, list(islice((r for r in few if r[0] not in gone), k))
            at = end

    def alike(self, labels: list, vecs: list) -> list[tuple[int, int, list]]:
        """(first, end, labels and finite vectors) of queries that follow each other and ask for the same; each alone where ids repeat."""
        out: list[tuple[int, int, list]] = []
        for q, (ls, vs) in enumerate(zip(labels, vecs, strict=True)):
            if out and self.single and len(vs) == len(vecs[q - 1]) and list(ls) == list(labels[q - 1]) and all(map(np.array_equal, vs, vecs[q - 1])):
                out[-1] = (out[-1][0], q + 1, out[-1][2])
            else:
                out.append((q, q + 1, [(lab, v) for lab, v in zip(ls, vs, strict=True) if np.isfinite(v).all()]))
        return out

    def top(self, products: np.ndarray, names: np.ndarray, counts: np.ndarray, gone: tuple[np.ndarray, np.ndarray], k: int) -> list[list[tuple[int, float, int]]]:
        """For each query, which has so many rows of products, its k best items but those that are gone.

        Rounding keeps the order of products, so only what lies near the k-th best of all is rounded.
        """
        first, n = np.cumsum(counts) - counts, len(self.ids)
        best = np.maximum.reduceat(products, first, axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            best[~np.isfinite(best * 1e9)] = -np.inf
        best[gone] = -np.inf
        least = np.partition(best, n - min(k, n), axis=1)[:, n - min(k, n)]
        query, item = np.nonzero((best >= (least - 4e-9 - 1e-12 * np.abs(least))[:, None]) & (best > -np.inf))
        score = np.rint(best[query, item] * 1e9) / 1e9
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        query, item, score = query[place < k], item[place < k], score[place < k]
        # the first row whose rounded product is the largest
        many = counts[query]
        starts = np.cumsum(many) - many
        pick = np.repeat(np.arange(len(query)), many)
        rows = first[query][pick] + np.arange(len(pick)) - starts[pick]
        equal = np.flatnonzero(np.rint(products[rows, item[pick]] * 1e9) / 1e9 == score[pick])
        label = names[rows[equal[np.searchsorted(pick[equal], np.arange(len(query)))]]] if len(query) else names[:0]
        found = list(zip(self.ids[item].tolist(), score.tolist(), label.tolist(), strict=True))
        ends = np.searchsorted(query, np.arange(len(counts) + 1)).tolist()
        return [found[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def spans_of(ids: np.ndarray, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the list, place) of all ids, which are sorted, that are in lists of wanted ones."""
    row, every = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted)
    low = np.searchsorted(ids, every)
    n = np.searchsorted(ids, every, side="right") - low
    return np.repeat(row, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Cells(Catalogue):
    """Items in cells around pivots, of which a query visits those that can still matter.

    No item of a cell scores more than vec . centre + |vec| * radius. Cells are visited in order of this bound
    until the k-th best score is above that of all others, so the result is that of all items.
    """

    #: Room for the rounding of scores, which are compared to nine digits.
    ROOM = 1e-8

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        super().__init__(ids, vecs)
        n = len(self.ids)
        self.products = self.pairs = 0
        if not n:
            return
        unit = self.vecs / np.maximum(np.linalg.norm(self.vecs, axis=1, keepdims=True), 1e-300)
        # pivots from all over: each the item that is furthest from those before, from the first on
        pivots, near = [0], unit @ unit[0]
        while len(pivots) < int(n**0.5):
            pivots.append(int(near.argmin()))
            near = np.maximum(near, unit @ unit[pivots[-1]])
        cell = (unit @ unit[pivots].T).argmax(axis=1)
        order = np.argsort(cell, kind="stable")
        self.parts = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
        self.centres = np.stack([self.vecs[p].mean(axis=0) for p in self.parts])
        self.radius = np.array([np.linalg.norm(self.vecs[p] - c, axis=1).max() for p, c in zip(self.parts, self.centres, strict=True)])

    def best(self, labels: list, vecs: list, seen: list, k: int) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        asked = []
        for q, (ls, vs) in enumerate(zip(labels, vecs, strict=True)):
            sound = [(lab, v) for lab, v in zip(ls, vs, strict=True) if np.isfinite(v).all()]
            if sound:
                asked.append((q, np.array([lab for lab, _ in sound]), np.stack([v for _, v in sound]), [] if seen[q] is None else seen[q]))
        n = len(self.ids)
        together = max(1, SCORES // max(n, 1))
        for at in range(0, len(asked) if n else 0, together):
            yield from self.visited(asked[at : at + together], k)

    def visited(self, asked: list[tuple], k: int) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        """best() of a few queries (number, labels, vectors, seen), which visit a cell together."""
        n, counts = len(self.ids), np.array([len(names) for _, names, *_ in asked])
        first, matrix = np.cumsum(counts) - counts, np.concatenate([m for *_, m, _ in asked])
        gone = spans_of(self.ids, [np.asarray(s, dtype=np.int64) for *_, s in asked])
        bound = np.maximum.reduceat(matrix @ self.centres.T + np.linalg.norm(matrix, axis=1)[:, None] * self.radius, first, axis=0) + self.ROOM
        order = np.argsort(-bound, axis=1, kind="stable")
        best, least = np.full((len(asked), n), -np.inf), np.full(len(asked), -np.inf)
        going, at, width = np.arange(len(asked)), 0, 1
        while at < order.shape[1]:
            # one cell, then as many again as before
            ahead = order[going, at : at + width]
            open_ = bound[going[:, None], ahead] >= least[going, None]
            some = open_.any(axis=1)
            going, ahead, open_ = going[some], ahead[some], open_[some]
            if not len(going):
                break
            query, cell = np.repeat(going, open_.sum(axis=1)), ahead[open_]
            by = np.argsort(cell, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
                part, who = self.parts[cell[own[0]]], query[own]
                starts = np.cumsum(counts[who]) - counts[who]
                rows = np.repeat(first[who] - starts, counts[who]) + np.arange(counts[who].sum())
                scores = np.rint(matrix[rows] @ self.vecs[part].T * 1e9) / 1e9
                self.products += scores.size
                top = np.maximum.reduceat(scores, starts, axis=0)
                top[~np.isfinite(top)] = -np.inf
                best[who[:, None], part] = top
            best[gone] = -np.inf
            if k <= n:
                least[going] = np.partition(best[going], n - k, axis=1)[:, n - k]
            at, width = at + width, 2 * width
        self.pairs += n * len(matrix)
        for i, (q, names, own, _) in enumerate(asked):
            near = np.flatnonzero((best[i] >= least[i]) & (best[i] > -np.inf))
            near = near[np.lexsort((near, -best[i, near]))][:k]
            label = names[np.rint(own @ self.vecs[near].T * 1e9).argmax(axis=0)]
            yield q, list(zip(self.ids[near].tolist(), best[i, near].tolist(), label.tolist(), strict=True))

    @property
    def share_skipped(self) -> float:
        """Of the products of all queries with all items, those that were not computed."""
        return 1 - self.products / self.pairs if self.pairs else 0.0


def best_items(queries: DataFrame, items: DataFrame, k: int, *keys: str, prune: bool = False) -> DataFrame:
    """(keys, movie_id, score, label, rank): for each query (keys, labels, vecs, seen) the k unseen items
    of the largest dot product with any of its vectors. Equal scores go to the smaller id.
    With prune, cells of items that cannot be among them are left out, which pays where items lie in groups.

    Each query row scores the item matrix block by block and keeps k rows, so neither pairs of
    interests and items nor unseen items leave a task. A matrix of at most MATRIX numbers is
    broadcast, and the queries stay where they are; a larger one is dealt to a grid of query and item
    parts, each cell of which keeps k rows a query.
    """
    fields = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{fields}, movie_id bigint, score double, label bigint"
    narrow = queries.select(*keys, "labels", "vecs", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
    own = items.select("movie_id", "vec")
    size = own.agg(F.sum(F.size("vec"))).first()[0] or 0
    kind = Cells if prune else Catalogue

    def rows_of(pdf: pd.DataFrame, catalogue: Catalogue) -> pd.DataFrame:
        out = [(q, *r) for q, found in catalogue.best(pdf["labels"].tolist(), pdf["vecs"].tolist(), pdf["seen"].tolist(), k) for r in found]
        at = pdf.iloc[[r[0] for r in out]]
        return pd.DataFrame({**{c: at[c].to_numpy() for c in keys}, **{name: [r[n] for r in out] for n, name in enumerate(("movie_id", "score", "label"), 1)}})

    if size <= MATRIX:
        shared = queries.sparkSession.sparkContext.broadcast(kind.of(*(c for _, c in own.toPandas().items())))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield rows_of(pdf, shared.value)

        found = narrow.mapInPandas(run, schema)
    else:
        across = -(-size // MATRIX)
        down = max(1, -(-narrow.count() // QUERIES))
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        left = narrow.withColumns({"_q": F.pmod(F.xxhash64(*keys), F.lit(int(down))), "_i": cells(across)})
        right = own.withColumns({"_i": F.pmod(F.xxhash64("movie_id"), F.lit(int(across))).cast("int"), "_q": cells(down)})
        left, right = left.withColumn("_q", F.col("_q").cast("int")), right.withColumn("_q", F.col("_q").cast("int"))
        cell = lambda a, b: rows_of(a, kind.of(b["movie_id"], b["vec"]))
        found = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(cell, schema)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "movie_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Members:
    """Items with labels, from which users' interests are made where they are scored."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, labels: np.ndarray, catalogue: Catalogue):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vecs, self.labels, self.catalogue = ids[order], vecs[order], labels[order], catalogue

    def interests(self, movies: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[list, list]:
        """(labels, vectors) of each user: means of its items by label, each item counted so many times."""
        n = len(movies)
        names, vecs = [[] for _ in range(n)], [[] for _ in range(n)]
        user = np.repeat(np.arange(n), [len(m) for m in movies])
        movie, weight = np.concatenate(movies), np.concatenate(counts)
        at = np.minimum(np.searchsorted(self.ids, movie), len(self.ids) - 1)
        own = (self.ids[at] == movie) & (weight > 0) & (self.labels[at] >= 0)
        user, at, weight = user[own], at[own], weight[own]
        if len(at):
            order = np.lexsort((self.labels[at], user))
            user, at, weight = user[order], at[order], weight[order]
            label = self.labels[at]
            first = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (label[1:] != label[:-1])])
            size = np.add.reduceat(weight, first)
            means = np.add.reduceat(self.vecs[at] * weight[:, None], first) / size[:, None]
            for i in np.flatnonzero(size >= least).tolist():
                names[user[first[i]]].append(int(label[first[i]]))
                vecs[user[first[i]]].append(means[i])
        return names, vecs


#: Users whose interests are made at once.
USERS = 500


def best_of_members(rows: DataFrame, items: DataFrame, k: int, least: int, known: Column, seen: bool = True, prune: bool = False) -> DataFrame | None:
    """As best_items() for each user of rows (user_id, movie_id) whose interests are the means, by label, of at least `least`
    of its rows of known items (movie_id, vec, label); what a user has rows of counts as seen.

    A user's items travel with their counts, without vectors, which every task holds. None if the items are too
    many for that, or an id has several.
    """
    if (items.agg(F.sum(F.size("vec"))).first()[0] or 0) > MATRIX:
        return None
    own = items.select("movie_id", "vec", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label")).toPandas()
    if not len(own) or own["movie_id"].duplicated().any():
        return None
    catalogue = (Cells if prune else Catalogue).of(own["movie_id"], own["vec"])
    shared = rows.sparkSession.sparkContext.broadcast(Members(own["movie_id"].to_numpy(dtype=np.int64), np.stack(own["vec"].to_numpy()), own["label"].to_numpy(dtype=np.int64), catalogue))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), USERS):
                part = pdf.iloc[start : start + USERS]
                movies, users = part["movies"].tolist(), part["user_id"].tolist()
                labels, vecs = shared.value.interests(movies, part["counts"].tolist(), least)
                found = shared.value.catalogue.best(labels, vecs, movies if seen else [None] * len(movies), k)
                out = [(users[q], *r) for q, best in found for r in best]
                yield pd.DataFrame(out, columns=["user_id", "movie_id", "score", "label"])

    times = rows.groupBy("user_id", "movie_id").agg(F.count("*").alias("_n"))
    lists = times.groupBy("user_id").agg(F.collect_list(F.struct("movie_id", F.when(known, F.col("_n")).otherwise(F.lit(0)).alias("n"))).alias("_l"))
    asked = lists.select("user_id", F.col("_l")["movie_id"].alias("movies"), F.col("_l")["n"].alias("counts"))
    # little data, long work: by its bytes alone all users would be put into a few tasks
    asked = asked.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "user_id")
    found = asked.mapInPandas(run, "user_id bigint, movie_id bigint, score double, label bigint")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "movie_id")
    return found.withColumn("rank", F.row_number().over(w))


#: Queries of one part of the grid.
QUERIES = 50_000


def skip_reason(n: Column, sound: Column) -> Column:
    """Why a user gets no recommendation: null if there is none."""
    return F.when(n.isNull(), "no_interest_state").when(n == 0, "empty_interests").when(sound == 0, "all_interest_vectors_non_finite")


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall and NDCG at k with one relevant item for each user."""
    r = relevant.join(ranked.where(F.col("rank") <= k), ["user_id", "movie_id"], "left")
    gain = F.coalesce(1.0 / F.log2(F.col("rank") + 1), F.lit(0.0))
    return r.agg(F.count("*").alias("users"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(gain).alias("ndcg"))
