"""Hierarchical density clustering: clusters of unlike density, by excess of mass.

A row's core distance is that to its `least`-th neighbour. Two rows are as far apart as the largest of
their distance and their core distances; the spanning tree of least weight over these distances, cut
at falling distances, gives a hierarchy of components. Of it only the splits stay that leave two parts of
`least` rows or more; smaller parts fall out as noise. A cluster's mass is how long its rows stay,
counted in 1/distance; the clusters chosen are those whose mass is no less than that of what they
split into, the whole never being one. Rows that fall out of no chosen cluster have label -1. Edges of one
weight merge at once, so the labels depend on the distances only, not on the order of rows or edges.

A group of up to TILE rows is clustered in one task. The rows of a larger one are dealt to tiles of that size, boxes in
their first three components. For core distances a row visits the tiles whose boxes lie within the distance
that its own tile gives. The spanning trees of neighbouring tiles hold a tree of the group; in it nearly
all rows are joined up to some weight, each other row at a weight of its own. An edge of the whole tree is
lighter than the larger of its ends' weights (or it would be the heaviest of a cycle), so a row visits the
tiles whose boxes lie within its own weight, and what visits a tile gives a spanning tree with its rows. So no task
holds the pairs of a group; its last step holds the edges of its tree, a few rows for each row of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .sequences import numbered

#: Rows of a group that one task compares with each other, and rows of a block of distances.
TILE, BLOCK = 4096, 256
#: Rows of a group whose pairs are weighed at once.
FEW = 128
#: Share of a group's rows that count as joined together.
JOINED = 0.95
#: A distance below this share of the heaviest edge counts as that much.
NEAREST = 1e-9


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all of y, a component at a time."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(out)


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """(rows of x, k) least distances to the rows of y, rising; infinite where y has fewer rows."""
    out = np.full((len(x), k), np.inf)
    for a in range(0, len(x), BLOCK):
        d = apart(x[a : a + BLOCK], y)
        m = min(k, d.shape[1])
        out[a : a + BLOCK, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1) if m else 0
    return out


def core_distances(x: np.ndarray, least: int) -> np.ndarray:
    """To the least-th other row; a row is at distance 0 from itself."""
    return nearest(x, x, least + 1)[:, least]


def spanning(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one end, other end, weight) of the edges of a spanning tree of least weight."""
    n = len(x)
    best, link, open_ = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    ends, weights, at = np.zeros((max(n - 1, 0), 2), dtype=np.int64), np.zeros(max(n - 1, 0)), 0
    for i in range(n - 1):
        open_[at] = False
        best[at] = np.inf
        w = np.maximum(np.maximum(apart(x[at : at + 1], x)[0], core), core[at])
        closer = open_ & (w < best)
        best[closer], link[closer] = w[closer], at
        at = int(best.argmin())
        ends[i], weights[i] = (link[at], at), best[at]
    return ends[:, 0], ends[:, 1], weights


def spanning_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As spanning(), from the weights of all pairs of a few rows."""
    rows, ends, weights = w.tolist(), [], []
    best, link, open_ = (rows[0] if rows else []), [0] * len(rows), list(range(1, len(rows)))
    while open_:
        at = min(open_, key=best.__getitem__)
        open_.remove(at)
        ends.append((link[at], at))
        weights.append(best[at])
        own = rows[at]
        for j in open_:
            if own[j] < best[j]:
                best[j], link[j] = own[j], at
    pairs = np.array(ends, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], np.array(weights, dtype=np.float64)


class Forest:
    """Sets of rows that are merged, each with a node of a tree."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.node = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i


def lightest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a spanning forest of least weight."""
    forest, out = Forest(n), []
    for e in np.argsort(w, kind="stable").tolist():
        i, j = forest.find(int(a[e])), forest.find(int(b[e]))
        if i != j:
            forest.root[max(i, j)] = min(i, j)
            out.append(e)
    return np.array(out, dtype=np.int64)


def merged(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[list[list[int]], list[float], list[int]]:
    """The hierarchy of a spanning tree: the parts, weight and size of the nodes from n on; rows are the nodes before."""
    forest, parts, weights, size = Forest(n), [], [], [1] * n
    order = np.argsort(w, kind="stable").tolist()
    a, b, w = np.asarray(a).tolist(), np.asarray(b).tolist(), np.asarray(w).tolist()
    at = 0
    while at < len(order):
        weight, joined = w[order[at]], {}
        if at + 1 == len(order) or w[order[at + 1]] != weight:
            # two nodes, as nearly all merges
            e = order[at]
            at += 1
            i, j = forest.find(a[e]), forest.find(b[e])
            if i != j:
                parts.append([forest.node[i], forest.node[j]])
                weights.append(weight)
                size.append(size[forest.node[i]] + size[forest.node[j]])
                forest.root[j], forest.node[i] = i, n + len(parts) - 1
            continue
        while at < len(order) and w[order[at]] == weight:
            e = order[at]
            at += 1
            i, j = forest.find(a[e]), forest.find(b[e])
            if i == j:
                continue
            one, two = (joined.pop(r, None) or [forest.node[r]] for r in (i, j))
            if len(one) < len(two):
                one, two, i, j = two, one, j, i
            one.extend(two)
            forest.root[j] = i
            joined[i] = one
        for r, nodes in joined.items():
            forest.node[r] = n + len(parts)
            parts.append(nodes)
            weights.append(weight)
            size.append(sum(size[x] for x in nodes))
    return parts, weights, size


def chosen(parts: list[list[int]], weights: list[float], size: list[int], n: int, least: int) -> tuple[list[int], list[int]]:
    """(cluster of each row when it falls out, the chosen cluster above each cluster or -1); cluster 0 is the whole."""
    floor = NEAREST * max(weights, default=0) or 1.0
    cluster, fallen = [0] * (n + len(parts)), [False] * (n + len(parts))
    above, birth, mass = [-1], [1 / max(weights[-1], floor) if weights else 0.0], [0.0]
    for k in range(len(parts) - 1, -1, -1):
        node, own = n + k, cluster[n + k]
        if fallen[node]:
            for p in parts[k]:
                cluster[p], fallen[p] = own, True
            continue
        here = 1 / max(weights[k], floor)
        big = [p for p in parts[k] if size[p] >= least]
        stay = size[big[0]] if len(big) == 1 else 0
        mass[own] += (here - birth[own]) * (size[node] - stay)
        for p in parts[k]:
            cluster[p], fallen[p] = own, size[p] < least
        if len(big) > 1:
            for p in big:
                cluster[p] = len(above)
                above.append(own)
                birth.append(here)
                mass.append(0.0)
    # from the last split up: a cluster, or what it split into
    split, picked = [0.0] * len(above), [False] * len(above)
    for c in range(len(above) - 1, 0, -1):
        picked[c] = mass[c] >= split[c]
        split[above[c]] += max(mass[c], split[c])
    of = [-1] * len(above)
    for c in range(1, len(above)):
        of[c] = of[above[c]] if of[above[c]] >= 0 else (c if picked[c] else -1)
    return cluster[:n], of


def labelled(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """Labels of rows from the edges of their spanning tree: from 0 in order of a cluster's first row, -1 for noise."""
    cluster, of = chosen(*merged(n, a, b, w), n, least)
    names, out = {}, np.full(n, -1, dtype=np.int64)
    for i, c in enumerate(cluster):
        if of[c] >= 0:
            out[i] = names.setdefault(of[c], len(names))
    return out


def density_labels(x: np.ndarray, least: int) -> np.ndarray:
    """Labels of the rows of one group; few rows are all noise."""
    least = max(2, least)
    if len(x) <= max(2, least):
        return np.full(len(x), -1, dtype=np.int64)
    if len(x) <= FEW:
        d = apart(x, x)
        core = np.sort(d, axis=1)[:, least]
        return labelled(len(x), *spanning_of(np.maximum(np.maximum(d, core[:, None]), core)), least)
    return labelled(len(x), *spanning(x, core_distances(x, least)), least)


# --- a group of any size, by tiles


def dealt(points: DataFrame, tile: int) -> DataFrame:
    """points (group, place, vec) with their tile: rows of a group in order of the first component, `tile` at a time."""
    placed = numbered(points.withColumn("first", F.col("vec")[0]), ["group", "first", "place"], "number", start=0)
    starts = placed.groupBy("group").agg(F.min("number").alias("start"))
    return placed.join(starts, "group").select("group", "place", "vec", F.expr(f"(number - start) div {tile}").alias("tile"))


def met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows of the tiles of each pair (group, i, j); a row of both sides comes once."""
    sides = pairs.select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return rows.join(sides, ["group", "tile"])


def close_pairs(spans: DataFrame, reach) -> DataFrame:
    """(group, i, j) of tiles whose spans (group, tile, low, high) lie within reach, an expression over one and other."""
    one, other = spans.alias("one"), spans.alias("other")
    near = (F.col("one.group") == F.col("other.group")) & (F.col("one.tile") < F.col("other.tile")) & (F.col("other.low") - F.col("one.high") <= reach)
    return one.join(other, near).select("one.group", F.col("one.tile").alias("i"), F.col("other.tile").alias("j"))


def boxed(points: DataFrame, tile: int) -> DataFrame:
    """points (group, place, vec) with tiles of `tile` rows: cut by the first component, the parts by the second, theirs by the third."""
    counts = points.groupBy("group").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("dim"))
    m = F.ceil(F.col("n") / tile)
    # tiles in a part of the first cut and of the second; with fewer components the last cut makes tiles
    first = F.when(F.col("dim") > 1, F.ceil(m / F.ceil(F.pow(m.cast("double"), F.lit(1.0) / F.least(F.col("dim"), F.lit(3)))))).otherwise(F.lit(1))
    second = F.when(F.col("dim") > 2, F.ceil(F.col("one") / F.ceil(F.sqrt("one")))).otherwise(F.lit(1))
    sizes = counts.withColumn("one", first.cast("long")).withColumn("two", second.cast("long")).withColumn("three", F.lit(1).cast("long")).drop("n", "dim")
    rows = points.select("group", "place", "vec").withColumn("part", F.lit(0).cast("long"))
    for k, size in enumerate(("one", "two", "three")):
        keyed = rows.withColumn("key", F.coalesce(F.get("vec", F.lit(k)), F.lit(0.0)))
        placed = numbered(keyed, ["group", "part", "key", "place"], "number", start=0)
        starts = placed.groupBy("group").agg(F.min("number").alias("start")).join(sizes, "group")
        rows = placed.join(starts, "group").select("group", "place", "vec", F.expr(f"(number - start) div ({tile} * {size})").alias("part"))
    return rows.withColumnRenamed("part", "tile")


def boxes(rows: DataFrame) -> DataFrame:
    """(group, tile, low, high): the least and largest components of each tile's rows."""

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "tile": pdf["tile"].iloc[:1], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

    return rows.groupBy("group", "tile").applyInPandas(box, "group bigint, tile bigint, low array<double>, high array<double>")


def gap(low, high, other_low, other_high):
    """The distance of two boxes; rounding takes it no further than that of rows in them."""
    sides = F.zip_with(F.zip_with(other_low, high, lambda a, b: a - b), F.zip_with(low, other_high, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x))


def visits(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (with reach) at each tile (to) other than their own that lies within their reach, and the block of its visitors."""
    reaches = rows.groupBy("group", "tile").agg(F.max("reach").alias("most"))
    own = spans.join(reaches, ["group", "tile"]).select("group", "tile", F.col("low").alias("own_low"), F.col("high").alias("own_high"), "most")
    to = spans.select("group", F.col("tile").alias("to"), "low", "high")
    near = own.join(to, "group").where((F.col("tile") != F.col("to")) & (gap(F.col("own_low"), F.col("own_high"), F.col("low"), F.col("high")) <= F.col("most")))
    met_ = rows.join(near.select("group", "tile", "to", "low", "high"), ["group", "tile"])
    return met_.where(gap(F.col("vec"), F.col("vec"), F.col("low"), F.col("high")) <= F.col("reach")).drop("low", "high")


def hosted(rows: DataFrame, guests: DataFrame, tile: int) -> DataFrame:
    """Blocks of at most about `tile` visitors (guest: true) of each tile, each with all rows of the tile."""
    count = guests.groupBy("group", "to").agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks"))
    own = rows.join(count.withColumnRenamed("to", "tile"), ["group", "tile"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt_ = guests.join(count, ["group", "to"]).withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")))
    names = [c for c in rows.columns if c != "tile"]
    return own.select(*names, F.col("tile").alias("at"), "block", F.lit(False).alias("guest")).unionByName(dealt_.select(*names, F.col("to").alias("at"), "block", F.lit(True).alias("guest")))


def cores(rows: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """rows (group, place, tile, vec) with core."""

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        return pdf.assign(near=pd.Series(list(nearest(x, x, least + 1)), index=pdf.index, dtype=object))

    def other(pdf: pd.DataFrame) -> pd.DataFrame:
        guest, x = pdf["guest"].to_numpy(), np.stack(pdf["vec"].to_numpy())
        near = pd.Series(list(nearest(x[guest], x[~guest], least + 1)), index=pdf.index[guest], dtype=object)  # a block may have no guest
        return pd.DataFrame({"group": pdf["group"][guest], "place": pdf["place"][guest], "near": near})

    plain = rows.select("group", "place", "tile", "vec")
    inside = written(plain.groupBy("group", "tile").applyInPandas(own, "group bigint, place bigint, tile bigint, vec array<double>, near array<double>"), "near")
    guests = visits(inside.select("group", "place", "tile", "vec", F.element_at("near", -1).alias("reach")), boxes(plain))
    across = hosted(plain, guests, tile).groupBy("group", "at", "block").applyInPandas(other, "group bigint, place bigint, near array<double>")
    every = inside.select("group", "place", "near").unionByName(across).groupBy("group", "place").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return plain.join(every.select("group", "place", F.element_at("near", least + 1).alias("core")), ["group", "place"])


EDGE = "group bigint, tile bigint, a bigint, b bigint, w double"


def joined_at(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row the weight up to which the edges of a connected graph join it to the part that first holds JOINED of all
    rows; for the rows of that part, the weight at which it does."""
    forest, members, out, main = Forest(n), {}, np.zeros(n), -1
    for e in np.argsort(w, kind="stable").tolist():
        i, j = forest.find(int(a[e])), forest.find(int(b[e]))
        if i == j:
            continue
        if len(members.get(i, (i,))) < len(members.get(j, (j,))):
            i, j = j, i
        come = members.pop(j, [j])
        forest.root[j] = i
        if main >= 0 and main in (i, j):  # the main part is the larger
            out[come] = w[e]
        members.setdefault(i, [i]).extend(come)
        if main < 0 and len(members[i]) >= JOINED * n:
            main = i
            out[members[i]] = w[e]
    return out


def tree_edges(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(group, tile, a, b, w): edges that hold each group's spanning tree; rows have core."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, w = spanning(np.stack(pdf["vec"].to_numpy()), pdf["core"].to_numpy())
        place = pdf["place"].to_numpy()
        return pd.DataFrame({"group": pdf["group"].iloc[0], "tile": pdf["i"].iloc[0], "a": place[a], "b": place[b], "w": w})

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        at = joined_at(len(names), ends[:, 0], ends[:, 1], pdf["w"].to_numpy())
        return pd.DataFrame({"group": pdf["group"].iloc[0], "place": names, "reach": at})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, w = spanning(np.stack(pdf["vec"].to_numpy()), pdf["core"].to_numpy())
        place, guest, far = (pdf[c].to_numpy() for c in ("place", "guest", "reach"))
        # of two rows of one tile, and of two that are joined by no more, the other trees tell
        some = (guest[a] | guest[b]) & (w < np.maximum(far[a], far[b]))
        return pd.DataFrame({"group": pdf["group"].iloc[0], "tile": pdf["at"].iloc[0], "a": place[a[some]], "b": place[b[some]], "w": w[some]})

    tiles = rows.groupBy("group").agg(F.max("tile").alias("last"))
    # each tile with the next; a single one is met alone
    chain = tiles.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("last") - 1, F.lit(0)))).alias("i")).withColumn("j", F.col("i") + 1)
    near = written(met(rows, chain).groupBy("group", "i", "j").applyInPandas(tree, EDGE), "chain")
    reaches = near.groupBy("group").applyInPandas(reach, "group bigint, place bigint, reach double")
    placed = written(rows.join(reaches, ["group", "place"]), "reaches")
    # no edge of a row is lighter than its core distance
    guests = visits(placed.where("core < reach"), boxes(placed))
    far = hosted(placed, guests, tile).groupBy("group", "at", "block").applyInPandas(across, EDGE)
    return near.unionByName(far)


def clustered(points: DataFrame, least: int, tile: int | None = None) -> DataFrame:
    """(group, place, label) of points (group, place, vec), whose places run from 0 in each group; groups of any size."""
    tile, least = tile or TILE, max(2, least)
    every = written(boxed(points.select("group", "place", "vec"), tile), "tiles")
    sizes = every.groupBy("group").agg(F.count("*").alias("n"))
    rows = every.join(sizes.where(F.col("n") > least), "group", "left_semi")
    few = every.join(sizes.where(F.col("n") <= least), "group", "left_semi").select("group", "place", F.lit(-1).cast("long").alias("label"))
    edges = tree_edges(written(cores(rows, least, tile), "cores"), tile)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        a, b, w = (pdf[c].to_numpy() for c in ("a", "b", "w"))
        some = lightest(n, a, b, w)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "place": np.arange(n), "label": labelled(n, a[some], b[some], w[some], least)})

    schema = "group bigint, place bigint, label bigint"
    return edges.join(sizes, "group").select("group", "a", "b", "w", "n").groupBy("group").applyInPandas(finish, schema).unionByName(few)
