"""Operator 4: SimHash near-duplicates by exact tiled comparison.

Every text gets a SimHash of its word shingles (repeats included): a bit is one if it is set in over
half of the shingles' hashes. Equal fingerprints collapse to one row first, so a group of thousands
of copies is one row from then on. Distinct fingerprints meet in tiles: two fingerprints within
`radius` bits agree on at least one of radius + 1 disjoint slices of their bits, so every fingerprint
goes to one tile per slice, and no pair within the radius is missed. (Wide radii use `tables` slices
of sampled bits instead, see slices.) A slice value held by very many fingerprints is cut into
tiles by population count, and each tile meets only the tiles whose counts differ by the radius or
less. Inside, numpy compares blocks by exclusive-or and bit counts, skips blocks whose
population counts are too far apart, and returns edges that connect what it found near, fewer than
twice the rows, never all pairs. Connected components over these links give the groups.

Results in odd cases: a null or empty text has the fingerprint zero and links like any other; rows
of the same id are one document of the groups (its smallest id stands for itself); a null id takes
part as a link but never names a component unless all its members are null; an empty table gives an
empty result; other columns are ignored by the query and kept by the pipeline stage, which tells
rows apart by keys of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, sized_broadcast, table, unused
from .text import LOWER, texts

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints of a tile; a larger slice value is cut.
TILE = 4096
#: Texts of a block whose shingle sets are compared, and the shingles that such a block has at most on average.
BLOCK = 512
SHINGLES = 400_000


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle: width words, space-joined; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def widened(h: np.ndarray, lanes: int) -> np.ndarray:
    """(shingles, lanes) of 64-bit hashes; the first lane is the hash itself."""
    out = np.empty((len(h), lanes), dtype=np.uint64)
    for k in range(lanes):
        x = h.copy()
        if k:
            x += np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out[:, k] = x
    return out


def fingerprint(text: bytes, width: int, lanes: int = 1) -> np.ndarray:
    """The SimHash of a text: lanes unsigned 64-bit words."""
    return summed(shingle_hashes(text, width), lanes)


def summed(h: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash of shingles given by their hashes."""
    if not len(h):
        return np.zeros(lanes, dtype=np.uint64)
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        rows = widened(h[at : at + CHUNK], lanes).view(np.uint8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, width: int, lanes: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, fp: array<bigint> of lanes words) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t, width, lanes).view(np.int64) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.list_(pa.int64()))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp array<bigint>")


def set_fingerprints(docs: DataFrame, width: int, lanes: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, fp, shingle_set): fingerprints of the distinct shingles, and a hash of their sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for t in texts(batch, "text"):
                h = np.unique(shingle_hashes(t, width))
                rows.append(summed(h, lanes).view(np.int64))
                sets.append(set_hash(h))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.list_(pa.int64())), pa.array(sets, pa.int64())], [key, "fp", "shingle_set"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp array<bigint>, shingle_set bigint")


def set_hash(h: np.ndarray) -> int:
    """A signed 64-bit hash of sorted shingle hashes."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def slices(bits: int, radius: int, tables: int | None, taken: int, seed: int = 11) -> list[np.ndarray]:
    """Bit places of each slice: radius + 1 disjoint ones (no pair missed), or sampled ones."""
    if tables is None:
        return np.array_split(np.arange(bits), radius + 1)
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, taken, replace=False)) for _ in range(tables)]


def tiled(distinct: DataFrame, cuts: list[np.ndarray], lanes: int) -> DataFrame:
    """(slice, value, pop, node, fp as bytes): each fingerprint once for every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fp = np.ascontiguousarray(batch.column("fp").flatten().to_numpy(zero_copy_only=False)).reshape(n, lanes)
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            pop = pa.array(bits.sum(axis=1, dtype=np.int32))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * lanes), n, [None, pa.py_buffer(fp.tobytes())]).cast(pa.binary())
            for k, cut in enumerate(cuts):
                value = bits[:, cut].astype(np.int64) @ (np.int64(1) << np.arange(len(cut), dtype=np.int64))
                columns = [pa.array(np.full(n, k, dtype=np.int32)), pa.array(value), pop, batch.column("node"), raw]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "value", "pop", "node", "fp"])

    return distinct.select("node", "fp").mapInArrow(run, "slice int, value bigint, pop int, node bigint, fp binary")


def thinned(node: np.ndarray, parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows that pairs (i, j) connect: each row with the smallest node it is near
    (parent, the place of that row in the order of nodes), and pairs where these leave rows apart.

    Tiles that hold the same rows then name the same edges, and equal edges are one.
    """
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), dtype=np.int64)
    rank[order] = np.arange(len(node))
    root = np.empty(len(node), dtype=np.int64)
    root[rank] = np.minimum(parent, rank)
    own = np.flatnonzero(root < np.arange(len(node)))
    src, dst = node[order[own]], node[order[root[own]]]
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    p, q = root[rank[i]], root[rank[j]]
    apart = np.flatnonzero(p != q)
    # one pair for each two trees
    first = apart[np.unique(np.minimum(p, q)[apart] * len(node) + np.maximum(p, q)[apart], return_index=True)[1]]
    return np.concatenate([src, node[i[first]]]), np.concatenate([dst, node[j[first]]])


def links(fp: np.ndarray, node: np.ndarray, pop: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all pairs of rows within the radius, found block by block; fewer than twice the rows."""
    order = np.argsort(pop, kind="stable")
    fp, node, pop = fp[order], node[order], pop[order]
    n = len(fp)
    root, rank = np.arange(n), np.empty(n, dtype=np.int64)
    rank[np.argsort(node, kind="stable")] = np.arange(n)
    parent = rank.copy()
    left, right = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, block):
        for b in range(a, n, block):
            # rows are in order of their counts: from here on every block is too far
            if pop[b] - pop[min(a + block, n) - 1] > radius:
                break
            apart = np.zeros((len(fp[a : a + block]), len(fp[b : b + block])), dtype=np.uint16)
            for lane in range(fp.shape[1]):
                apart += np.bitwise_count(fp[a : a + block, lane, None] ^ fp[None, b : b + block, lane])
            near = apart <= radius
            parent[a : a + block] = np.minimum(parent[a : a + block], np.where(near, rank[None, b : b + block], n).min(axis=1))
            parent[b : b + block] = np.minimum(parent[b : b + block], np.where(near, rank[a : a + block, None], n).min(axis=0))
            while True:
                # a row's first partner outside its own tree, for all rows at once
                mine = np.array([find(i) for i in range(a, min(a + block, n))])
                other = np.array([find(j) for j in range(b, min(b + block, n))])
                near &= mine[:, None] != other[None, :]
                rows = np.flatnonzero(near.any(axis=1))
                if not len(rows):
                    break
                for i, j in zip((rows + a).tolist(), (near[rows].argmax(axis=1) + b).tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(i)
                        right.append(j)
    return thinned(node, parent, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))


def small_links(group: np.ndarray, fp: np.ndarray, node: np.ndarray, pop: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside many groups of rows at once; equal values of group stand together."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    out = []
    for at, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist(), strict=True):
        out.append(links(fp[at : at + n], node[at : at + n], pop[at : at + n], radius))
    few = np.repeat(sizes <= 24, sizes)
    fp, node, pop, group = fp[few], node[few], pop[few], group[few]
    left, right = [], []
    for d in range(1, 24):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        i = i[np.abs(pop[i + d] - pop[i]) <= radius]
        apart = np.bitwise_count(fp[i] ^ fp[i + d]).sum(axis=1, dtype=np.int32)
        i = i[apart <= radius]
        left.append(i)
        right.append(i + d)
    if left:
        # one fingerprint stands in several groups: ranks tell rows apart, groups cannot meet
        i, j = np.concatenate(left), np.concatenate(right)
        rank = np.empty(len(node), dtype=np.int64)
        rank[np.argsort(node, kind="stable")] = np.arange(len(node))
        parent = rank.copy()
        low = np.minimum(rank[i], rank[j])
        np.minimum.at(parent, i, low)
        np.minimum.at(parent, j, low)
        out.append(thinned(node, parent, i, j))
    return out


def near_links(distinct: DataFrame, radius: int, lanes: int = 1, tables: int | None = None, taken: int = 14) -> DataFrame:
    """(src, dst) links between distinct fingerprints (node, fp): edges from every tile that connect all it holds near."""
    rows = tiled(distinct, slices(64 * lanes, radius, tables, taken), lanes)
    hot = table(rows.groupBy("slice", "value").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("slice", "value"), "simhash-hot")
    cut = not hot.isEmpty()
    small = rows.join(hot, ["slice", "value"], "left_anti") if cut else rows

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, lanes)
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return [number("slice").astype(np.int64) << 32 ^ number("value"), fp, number("node"), number("pop")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of their tile; the last tile of a batch waits for the next batch
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = arrays(batch)
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
            held = [x[last:] for x in now]
            if last:
                yield from edges(small_links(*(x[:last] for x in now), radius))
        if held is not None:
            yield from edges(small_links(*held, radius))

    def edges(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            src, dst = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.frombuffer(b"".join(pdf["fp"]), dtype=np.uint64).reshape(-1, lanes)
        src, dst = links(fp, pdf["node"].to_numpy(), pdf["pop"].to_numpy(), radius)
        return pd.DataFrame({"src": src, "dst": dst})

    out = small.repartition("slice", "value").sortWithinPartitions("slice", "value").mapInArrow(sweep, "src bigint, dst bigint")
    return out.unionByName(_large(rows, hot, radius, compare)) if cut else out


def _large(rows: DataFrame, values: DataFrame, radius: int, compare) -> DataFrame:
    """Links of slice values with many rows: cells of one population count, cut to TILE rows at
    random; a task compares two cells whose counts differ by the radius or less."""
    hot = table(rows.join(values, ["slice", "value"]), "simhash-hot-rows")
    cells = table(hot.groupBy("slice", "value", "pop").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE)), "simhash-cells")
    a, b = cells.alias("a"), cells.alias("b")
    # pairs of cells of a slice value: at most 2 radius + 1 for each population count
    pairs = a.join(b, (F.col("a.slice") == F.col("b.slice")) & (F.col("a.value") == F.col("b.value")) & (F.col("b.pop") >= F.col("a.pop")) & (F.col("b.pop") <= F.col("a.pop") + radius))
    pairs = pairs.select(F.col("a.slice").alias("slice"), F.col("a.value").alias("value"), F.col("a.pop").alias("p"), F.col("b.pop").alias("q"), F.explode(F.sequence(F.lit(0), F.col("a.tiles") - 1)).alias("i"), F.col("b.tiles").alias("m"))
    pairs = pairs.select("slice", "value", "p", "q", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j")).where("p < q or i <= j")
    pairs = pairs.withColumn("pair", F.xxhash64("slice", "value", "p", "q", "i", "j"))
    ends = pairs.select("slice", "value", "pair", F.explode(F.array(F.struct(F.col("p").alias("pop"), F.col("i").alias("tile")), F.struct(F.col("q").alias("pop"), F.col("j").alias("tile")))).alias("e"))
    ends = ends.select("slice", "value", "pair", "e.pop", "e.tile").distinct()
    placed = hot.join(cells.select("slice", "value", "pop", "tiles"), ["slice", "value", "pop"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    return placed.join(ends, ["slice", "value", "pop", "tile"]).groupBy("pair").applyInPandas(compare, "src bigint, dst bigint")


def similar_links(docs: DataFrame, distinct: DataFrame, found: DataFrame, width: int, least: float, key: str) -> DataFrame:
    """Links of texts whose sets of shingles have a Jaccard similarity of least or more.

    All pairs of a component of the candidates found are compared, also those that its forest leaves out. Only fingerprints with a link have their shingles computed, from the first document that has them.
    """
    ends = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    first = table(distinct.join(ends, "node", "left_semi").select("node", F.col("first").alias("_first"), F.col("shingle_set").alias("_set")), "simhash-ends")
    known = sized_broadcast(first)
    own = docs.select(key, "text").join(known, F.col(key).eqNullSafe(known["_first"])).select("node", "_set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, known_set, text in zip(batch.column("node").to_pylist(), batch.column("_set").to_pylist(), texts(batch, "text"), strict=True):
                # rows of one id can have different texts
                h = np.unique(shingle_hashes(text, width))
                if set_hash(h) == known_set:
                    nodes.append(node)
                    sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = own.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])
    # similar texts share a component of the candidates, and there every pair is compared
    placed = sets.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = table(placed, "simhash-shingles")
    return compared(placed, least)


def compared(sets: DataFrame, least: float) -> DataFrame:
    """(src, dst): a forest with the components of all pairs of (node, shingles) of one component that are similar.

    A component is cut at random into blocks of about BLOCK rows or SHINGLES shingles; each pair of blocks is a tile.
    """
    sizes = sets.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("shingles")) / SHINGLES)).cast("int").alias("blocks"))
    # written, so that a large component can be split in the join that follows
    rows = sets.join(table(sizes, "simhash-blocks"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of their tile; the last tile of a batch waits for the next batch
        name, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True)
            src, dst = [], []
            for at, key in enumerate(keys):
                if key != name:
                    for out, more in zip((src, dst), similar_pairs(held, name, least), strict=True):
                        out += more
                    name, held = key, []
                held.append((batch.column("node")[at].as_py(), batch.column("block")[at].as_py(), batch.column("shingles")[at].values.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
        src, dst = similar_pairs(held, name, least)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(sweep, "src bigint, dst bigint")


def similar_pairs(rows: list[tuple[int, int, np.ndarray]], tile: tuple[int, int, int] | None, least: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the similar pairs of a tile's (node, block, distinct shingles); of two blocks, only pairs across."""
    src, dst = [], []
    if len(rows) < 2:
        return src, dst
    node, block = [r[0] for r in rows], np.array([r[1] for r in rows])
    sizes = np.array([len(r[2]) for r in rows])
    ends = np.cumsum(sizes)
    ids = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)[1]
    root, has = np.arange(len(rows)), np.zeros(len(ids), dtype=bool)
    two = tile[1] != tile[2]
    for i in range(len(rows)):
        if two and block[i] != tile[1]:
            continue
        able = (root != root[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
        able &= block != block[i] if two else np.arange(len(rows)) > i
        if not able.any():
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        has[own] = True
        shared = np.concatenate([[0], np.cumsum(has[ids])])
        shared = shared[ends] - shared[ends - sizes]
        has[own] = False
        for j in np.flatnonzero(able & (shared >= least * (sizes + sizes[i] - shared))).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                src.append(node[i])
                dst.append(node[j])
    return src, dst


def groups(docs: DataFrame, width: int = 3, radius: int = 3, lanes: int = 1, tables: int | None = None, taken: int = 14, key: str = "doc_id", least: float | None = None) -> DataFrame:
    """(key, fp, component): the fingerprint of every row and the smallest key of its group.

    With least, links count only if the similarity of their shingle sets is that or more; then fingerprints
    are of the distinct shingles, and texts are one node only if their sets are equal.
    """
    prints = table((fingerprints if least is None else set_fingerprints)(docs, width, lanes, key), "simhash")
    same = ["fp"] if least is None else ["fp", "shingle_set"]
    node = F.col("fp")[0] if same == ["fp"] and lanes == 1 else F.xxhash64(*same)
    distinct = table(prints.groupBy(*same).agg(F.min(key).alias("first")).select(node.alias("node"), "first", *same), "simhash-distinct")
    found = table(near_links(distinct, radius, lanes, tables, taken), "simhash-links")
    if least is not None:
        found = table(similar_links(docs, distinct, found, width, least, key), "simhash-similar")
    named = components(found)
    joined = distinct.select("node", "first").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = joined.where(F.col("component").isNotNull())
    # written, so that a large group can be split in the join that follows
    least = table(linked.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
    by_node = table(linked.join(least, "component").select(F.col("node").alias("_node"), "least"), "simhash-groups")
    own = prints.withColumn("_node", node)
    return own.join(by_node, "_node").select(key, "fp", F.col("least").alias("component"))


def keep_one(docs: DataFrame, width: int = 5, radius: int = 60, lanes: int = 4, tables: int = 64, taken: int = 14, least: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group one row stays.

    Texts are near-duplicates from a similarity of 0.8 of the sets of their five-word shingles. There,
    256 bits differ in 39 places on average, with a deviation of 6; unrelated texts differ in 128,
    with a deviation of 8. Slices of 14 sampled bits in 64 tables bring 99.8 of 100 pairs of just
    that similarity together, and nearly all that are closer; the tests measure it. Those within the radius are candidates;
    all pairs that candidates connect are then compared exactly, so that no document goes for a
    similarity below 0.8, and none stays because its candidates were dissimilar.
    Rows have keys of their own, so rows that share an id, or have none, are grouped by their texts alone.
    Of each group one row stays: that of the smallest id, nulls last, and of the same id by a hash of id and text.
    """
    own = unused(docs, "_row")
    held = table(docs.withColumn(own, F.monotonically_increasing_id()), "simhash-rows")
    rows = held.select(F.col(own).alias("_row"), "doc_id", "text")
    found = table(groups(rows, width, radius, lanes, tables, taken, key="_row", least=least), "simhash-found")
    others = found.where("_row <> component").select("_row", "component")
    members = others.unionByName(others.select(F.col("component").alias("_row"), "component").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("doc_id", "text").alias("hash"), "_row")
    placed = table(members.join(rows.select("_row", place.alias("place")), "_row"), "simhash-members")
    # written, so that a large group can be split in the join that follows
    best = table(placed.groupBy("component").agg(F.min("place").alias("best")), "simhash-best")
    gone = table(placed.join(best, "component").where("place._row <> best._row").select(F.col("_row").alias(own)), "simhash-gone")
    return held.join(sized_broadcast(gone), own, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and component of every document."""
    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
