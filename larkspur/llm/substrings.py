"""Operator 3: removal of repeated word sequences, by FM-indexes of shards.

A window is 13 consecutive words of a document. Every word covered by a window goes whose words also
start in a document of a smaller id. All documents against all would not scale, so the text is
routed: the smallest hash of a window's five-word grams (its minimiser) is the same wherever the
window stands, and a run of windows with one minimiser is a segment.

1. The minimisers that occur in two documents at least are found by one aggregation, and summed up in a
   filter of bounded size. It loses nothing; beyond its load it would let too much through, and what
   passes is joined with the minimisers themselves.
2. Segments that pass are collapsed by content, with the smallest id that holds each.
3. Shards of segments, dealt by minimiser, get an FM-index each (suffixes by depth, packed wavelet
   matrix). All windows of the shard are searched backwards at once; intervals that reach 13 words
   and hold several places report the smallest id among them. Segments of a minimiser that holds very
   much text (many different ones, or long ones) are cut into windows first, equal windows collapsed, and dealt by their words.
4. The results go back to the places of the segments, and from them to the documents.

Segments are told apart by 128 bits of their words' 64-bit hashes in steps 2 and 3, cut windows by 128 bits of
their text, minimisers by 64 bits, where equal ones only share a shard; in the indexes words are compared by themselves.

Results in odd cases: ids are whole numbers; a null or empty text has no words and the digest of an empty text; a null id
counts as larger than any other and is never a reason to remove; rows of one id do not remove each
other's words, and equal rows lose the same; very long texts are taken whole; texts of fewer than 13 words stay whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, table
from .fmindex import FMIndex
from .text import WordIds, hash_ids, texts

WINDOW, GRAM = 13, 5
#: Bits of a filter: 16 for each entry, up to the bound.
BLOCK_BITS, MOST_BLOCKS = 15, 8192
#: Words of a shard, and bytes of a minimiser's segments before they are cut.
SHARD_WORDS, HOT_BYTES = 1_000_000, 2_000_000
#: Stands for a null id.
LAST = (1 << 63) - 1
#: Odd multiplier of grams.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def minimisers(ids: np.ndarray) -> np.ndarray:
    """The smallest gram hash of every window."""
    n, w = len(ids) - GRAM + 1, ids.view(np.uint64)
    g = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(GRAM):
        g = g * BASE + w[j : n + j]
    g = mixed(g)
    span = WINDOW - GRAM + 1
    width = 1
    while 2 * width <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    if span > width:
        g = np.minimum(g[: len(g) - (span - width)], g[span - width :])
    return g


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of each run of one minimiser."""
    starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(m)]]))


def contents(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each range, taken from the bytes of its words' hashes."""
    raw = ids.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Filter:
    """A blocked Bloom filter: the block from the top bits of a hash, three bits of it from others."""

    def __init__(self, blocks: int, parts: dict[int, bytes]):
        self.blocks = blocks
        self.bits = np.zeros((blocks, 1 << BLOCK_BITS - 6), dtype=np.uint64)
        for k, raw in parts.items():
            self.bits[k] = np.frombuffer(raw, dtype=np.uint64)

    @staticmethod
    def places(x: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
        x = mixed(x.view(np.uint64))
        block = ((x >> np.uint64(45)) % np.uint64(blocks)).astype(np.int64)
        return block, [(x >> np.uint64(15 * j) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64) for j in range(3)]

    def held(self, x: np.ndarray) -> np.ndarray:
        block, spots = self.places(x, self.blocks)
        out = np.ones(len(x), dtype=bool)
        for s in spots:
            out &= (self.bits[block, s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def bloom(keys: DataFrame, n: int | None = None) -> Filter:
    """A filter of the n rows of the column `key`: built block by block on the executors, MOST_BLOCKS x 4 KB at most."""
    blocks = int(min(MOST_BLOCKS, max(1, (keys.count() if n is None else n) * 16 >> BLOCK_BITS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(Filter.places(key, blocks)[0]), b.column("key")], ["block", "key"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
        for s in Filter.places(pdf["key"].to_numpy(), blocks)[1]:
            bits[s] = True
        return pd.DataFrame({"block": pdf["block"][:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = keys.select("key").mapInArrow(deal, "block bigint, key bigint").groupBy("block").applyInPandas(build, "block bigint, bits binary")
    return Filter(blocks, {r.block: bytes(r.bits) for r in rows.toLocalIterator()})


def rows_of(batch: pa.RecordBatch, key: str) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash of the text, text) of each row."""
    ids = batch.column(key).cast(pa.int64()).fill_null(LAST).to_pylist()
    for d, t in zip(ids, texts(batch, "text"), strict=True):
        yield d, xxhash.xxh64_intdigest(t) - (1 << 63), t


def repeated_minimisers(docs: DataFrame, key: str) -> DataFrame:
    """(key) of the minimisers that two documents at least hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(word_hash)
        for batch in batches:
            found, owners = [], []
            for d, _, t in rows_of(batch, key):
                words = t.split()
                if len(words) >= WINDOW:
                    found.append(np.unique(minimisers(hash_ids(words, ids))).view(np.int64))
                    owners.append(np.full(len(found[-1]), d, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(owners))], ["key", "doc"])

    rows = docs.select(key, "text").mapInArrow(run, "key bigint, doc bigint")
    return rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")


def segments(docs: DataFrame, key: str, repeated: Filter) -> DataFrame:
    """(minimiser, content, doc, text_id, first, words) of each segment that may repeat.

    words is left out where the same task has given the same content before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    names = ["minimiser", "content", "doc", "text_id", "first", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, given, bloomed = WordIds(word_hash), set(), shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for d, text_id, t in rows_of(batch, key):
                words = t.split()
                if len(words) < WINDOW:
                    continue
                h = hash_ids(words, ids)
                m = minimisers(h)
                starts, n = runs(m)
                kept = bloomed.held(m[starts])
                if not kept.any():
                    continue
                starts, ends = starts[kept], (starts + n)[kept] + WINDOW - 1
                hashes = contents(h, starts, ends)
                cols[0].append(m[starts].view(np.int64))
                for c, a, b in zip(hashes, starts.tolist(), ends.tolist(), strict=True):
                    new = c not in given
                    if new:
                        given.add(c)
                    cols[1].append(c)
                    cols[2].append(d)
                    cols[3].append(text_id)
                    cols[4].append(a)
                    cols[5].append(b" ".join(words[a:b]) if new else None)
            if len(given) > 500_000:
                given.clear()
            if cols[1]:
                arrays = [pa.array(np.concatenate(cols[0])), pa.array(cols[1], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(key, "text").mapInArrow(run, "minimiser bigint, content binary, doc bigint, text_id bigint, first bigint, words binary")


def search(pdf: pd.DataFrame) -> pd.DataFrame:
    """The smallest owner of every window of a shard's segments."""
    ids: dict[bytes, int] = {}
    lists = [[ids.setdefault(w, len(ids) + 1) for w in x.split(b" ")] for x in pdf["words"]]
    sizes = np.array([len(x) for x in lists])
    text = np.zeros(int(sizes.sum()) + len(lists), dtype=np.int64)
    first = np.concatenate([[0], (sizes + 1).cumsum()])[:-1]
    for at, x in zip(first.tolist(), lists, strict=True):
        text[at : at + len(x)] = x
    index = FMIndex(text, WINDOW)
    owner = np.repeat(pdf["own"].to_numpy(), sizes + 1)
    windows = sizes - WINDOW + 1
    segment = np.repeat(np.arange(len(lists)), windows)
    ends = np.arange(len(segment)) - np.repeat(np.concatenate([[0], windows.cumsum()])[:-1], windows) + first[segment] + WINDOW
    matched, lo, hi = index.statistics(text, ends, WINDOW)
    least = owner[first[segment]].copy()
    # intervals of whole windows that hold several places
    several = np.flatnonzero((matched == WINDOW) & (hi - lo > 1))
    if len(several):
        spans, place = np.unique(lo[several], return_inverse=True)
        tops = np.zeros(len(spans), dtype=np.int64)
        tops[place] = hi[several]
        own = np.append(owner[index.order], LAST)
        low = np.minimum.reduceat(own, np.stack([spans, tops], axis=1).ravel())[::2]
        least[several] = low[place]
    parts = np.split(least, windows.cumsum()[:-1])
    return pd.DataFrame({"id": pdf["id"], "cut": pdf["cut"], "least": parts})


def window_owners(places: DataFrame) -> DataFrame:
    """(content, least): for each segment content, the smallest id that holds each of its windows."""
    segs = table(places.groupBy("content").agg(F.first("minimiser").alias("minimiser"), F.min("doc").alias("own"), F.first("words", ignorenulls=True).alias("words")), "segments")
    total = segs.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, int(total / 6 / SHARD_WORDS))
    hot = table(segs.groupBy("minimiser").agg(F.sum(F.length("words")).alias("n")).where(F.col("n") > HOT_BYTES).select("minimiser"), "hot-minimisers")
    cut = not hot.isEmpty()
    plain = segs.join(hot, "minimiser", "left_anti") if cut else segs
    rows = plain.select(F.col("content").alias("id"), F.lit(False).alias("cut"), "own", "words", F.pmod(F.xxhash64("minimiser"), F.lit(shards)).alias("shard"))
    if cut:
        words = F.split(F.col("words").cast("string"), " ")
        each = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
        pieces = segs.join(hot, "minimiser", "left_semi").select("content", "own", F.posexplode(each).alias("at", "window"))
        pieces = table(pieces.withColumn("id", F.unhex(F.md5("window"))), "windows")
        single = pieces.groupBy("id").agg(F.min("own").alias("own"), F.first("window").cast("binary").alias("words"))
        rows = rows.unionByName(single.select("id", F.lit(True).alias("cut"), "own", "words", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")))
    found = table(rows.groupBy("shard").applyInPandas(search, "id binary, cut boolean, least array<bigint>"), "window-owners")
    out = found.where("not cut").select(F.col("id").alias("content"), "least")
    if cut:
        back = pieces.select("content", "at", "id").join(found.where("cut").select("id", F.col("least")[0].alias("one")), "id")
        whole = back.groupBy("content").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "one"))), lambda x: x["one"]).alias("least"))
        out = out.unionByName(whole)
    return out


def kept_words(text: bytes, starts: list[int] | np.ndarray) -> tuple[int, int, str]:
    """(words, removed, digest of the kept) when the windows at starts go."""
    words = text.split()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    if len(starts):
        s = np.unique(starts)
        edge[s] += 1
        edge[s + WINDOW] -= 1
    gone = edge.cumsum()[:-1] > 0
    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest()


def dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document."""
    spark = docs.sparkSession
    minimisers_ = table(repeated_minimisers(docs, key), "minimisers")
    n = minimisers_.count()
    found = segments(docs, key, bloom(minimisers_, n))
    if n * 16 > MOST_BLOCKS << BLOCK_BITS:
        found = found.join(minimisers_.withColumnRenamed("key", "minimiser"), "minimiser", "left_semi").select(*found.columns)
    places = table(found, "places")
    owners = table(window_owners(places), "owners")
    at = F.transform(F.filter(F.sequence(F.lit(0), F.size("least") - 1), lambda i: F.element_at("least", i + 1) < F.col("doc")), lambda i: (i + F.col("first")).cast("int"))
    gone = places.select("content", "doc", "text_id", "first").join(owners, "content").select("doc", "text_id", at.alias("at")).where(F.size("at") > 0)
    gone = table(gone.groupBy("doc", "text_id").agg(F.flatten(F.collect_list("at")).alias("at")), "removed")
    # documents that lose nothing are not shuffled
    touched = spark.sparkContext.broadcast(bloom(gone.select(F.col("doc").bitwiseXOR(F.col("text_id")).alias("key"))))
    kind = docs.schema[key].dataType.simpleString()
    result = [key, "n_words", "n_removed", "kept_sha256"]

    def hit(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
        rows = list(rows_of(batch, key))
        return rows, touched.value.held(np.array([d ^ t for d, t, _ in rows], dtype=np.int64))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = hit(batch)
            out = [kept_words(t, []) for (_, _, t), h in zip(rows, held.tolist(), strict=True) if not h]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(~held)), *map(pa.array, zip(*out, strict=True))], result)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = hit(batch)
            if held.any():
                own = [(d, t) for (d, t, _), h in zip(rows, held.tolist(), strict=True) if h]
                mask = pa.array(held)
                yield pa.RecordBatch.from_arrays([batch.column(key).filter(mask), *(pa.array(x, pa.int64()) for x in zip(*own, strict=True)), batch.column("text").filter(mask)], [key, "doc", "text_id", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [kept_words(t, a or []) for t, a in zip(texts(batch, "text"), batch.column("at").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, zip(*out, strict=True))], result)

    schema = f"{key} {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    narrow = docs.select(key, "text")
    plain = narrow.mapInArrow(whole, schema)
    joined = narrow.mapInArrow(others, f"{key} {kind}, doc bigint, text_id bigint, text string").join(gone, ["doc", "text_id"], "left")
    return plain.unionByName(joined.select(key, "text", "at").mapInArrow(finish, schema))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: words, removed words and digest of the kept ones of every document."""
    return dedup(documents(spark, sf_dir))


#: The same by grouping all windows.
SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (
  SELECT doc_id, word, i, md5(string_agg(word, ' ') OVER f) AS s, count(*) OVER f AS n
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
o AS (SELECT s, min(doc_id) AS own FROM g WHERE n = 13 GROUP BY s),
r AS (SELECT g.doc_id, g.word, g.i, coalesce(g.n = 13 AND o.own < g.doc_id, false) AS starts FROM g LEFT JOIN o ON g.s = o.s),
k AS (SELECT doc_id, word, i, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM r),
t AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
