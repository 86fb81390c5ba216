"""Operator 6: benchmark decontamination by SimHash of item-sized windows.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; shingles
are five words (all words of a shorter item). Every item and every window of an item's size in a
document has a SimHash of 128 bits of its shingles. Windows that share no shingle with any item have
similarity zero and are not hashed. For the others a multi-index finds all items within RADIUS bits:
the bits are cut into four blocks of 32, and since the blocks' bounds (REACH) add up to
RADIUS - 3, a pair within the radius is within the bound of one block at least. An item's block is found by posting
lists: block and value -> the items within the bound, computed when a value is first met and kept for the
windows that follow. Of unrelated pairs about 1.2 in 100 pass a block. Each pair within the radius is then
verified by its exact weighted Jaccard similarity, the weight of a shingle being its count; the similarities of
neighbouring windows with an item come from one pass over their shingles.

The radius: at a similarity of just 0.8, 19.4 of 128 bits differ on average, with a deviation of 4.1;
what differs in more than 34 is missed, about one of 10,000 windows of just that similarity, and fewer
the closer they are. The tests measure it by item length.

The items go to the tasks in blocks of bounded size, each of which passes through the driver and is broadcast. A benchmark of
one block is met as the documents are read; of a larger one the blocks follow each other, each reading the documents
and giving its memory back before the next. The documents are not shuffled. A document
shorter than an item counts as one window if it has four fifths of its words.

Results in odd cases: null and empty texts and items match nothing; equal items each get their own
rows; repeated rows of a document each give theirs; of equally similar windows the first is named;
very long documents are searched whole; an empty table on either side gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, sized_broadcast, table
from .text import ALNUM, WordIds, hash_ids, texts

WIDTH, LANES, RADIUS = 5, 2, 34
#: Bits that may differ in each block of 32: RADIUS - 3 in all.
REACH = (8, 8, 8, 7)
#: Posting lists that are kept at once.
LISTS = 100_000
#: Of one block of items: rows at most, and bytes of text at most.
ITEM_ROWS, ITEM_BYTES = 20_000, 32_000_000
#: Windows compared with items at once.
WINDOWS = 4096


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of width word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    w = words.view(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : n + j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def lanes_of(h: np.ndarray) -> np.ndarray:
    """(shingles, LANES) words of 64 bits: the hash itself, and others made of it."""
    out = np.empty((len(h), LANES), dtype=np.uint64)
    out[:, 0] = h
    for k in range(1, LANES):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ x >> np.uint64(31)
    return out


def window_prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of size shingles, in LANES words; of an even number the first counts twice, so that
    no bit is a tie."""
    bits = np.unpackbits(lanes_of(h).view(np.uint8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64 * LANES), dtype=np.int32), bits.cumsum(axis=0, dtype=np.int32)])
    counts = sums[size:] - sums[:-size]
    if size % 2 == 0:
        counts += bits[: len(counts)]
    return np.packbits(2 * counts > size, axis=1, bitorder="little").view(np.uint64)


def similarity(a: list[bytes], b: list[bytes], width: int) -> float:
    """Weighted Jaccard of the shingles of two word lists."""
    p, q = (Counter(tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))) for x in (a, b))
    both = sum((p & q).values())
    return both / (sum(p.values()) + sum(q.values()) - both)


def covered(anchors: np.ndarray, run: int, last: int) -> list[tuple[int, int]]:
    """First and last start of the windows of `run` shingles that hold an anchor (rising), as spans that do not meet."""
    low, high = np.maximum(anchors - run + 1, 0), np.minimum(anchors, last)
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return []
    cut = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
    return list(zip(low[np.r_[0, cut]].tolist(), high[np.r_[cut - 1, len(high) - 1]].tolist(), strict=True))


class Known:
    """Membership in a fixed set of hashes: a table of their top bits first, then a sorted search."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[self.sorted >> np.uint64(64 - self.BITS)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where h has a member."""
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.BITS)])
        return at[self.exact(h[at])]

    def exact(self, h: np.ndarray) -> np.ndarray:
        near = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return self.sorted[near] == h


class Items:
    """The items of one length: shingles, fingerprints and the multi-index over them."""

    def __init__(self, rows: list[tuple[object, list[bytes]]]):
        self.ids, self.words = [r[0] for r in rows], [r[1] for r in rows]
        self.length = len(self.words[0])
        self.width = min(WIDTH, self.length)
        hashes = [shingles(np.array([word_hash(w) for w in words], dtype=np.int64), self.width) for words in self.words]
        self.known = Known(np.concatenate(hashes))
        self.prints = np.concatenate([window_prints(h, len(h)) for h in hashes])
        self.values = np.ascontiguousarray(self.prints.view(np.uint32).T)
        self.lists: dict[tuple[int, int], np.ndarray] = {}
        self.own: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}

    def shingles_of(self, i: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Hashes of an item's distinct shingles in order, how often each stands in it, and their words."""
        if i not in self.own:
            if len(self.own) >= LISTS:
                self.own.clear()
            counts = Counter(tuple(self.words[i][k : k + self.width]) for k in range(self.length - self.width + 1))
            grams = list(counts)
            h = np.concatenate([shingles(np.array([word_hash(w) for w in g], dtype=np.int64), self.width) for g in grams])
            order = np.argsort(h, kind="stable")
            self.own[i] = h[order], np.array([counts[grams[k]] for k in order.tolist()]), [grams[k] for k in order.tolist()]
        return self.own[i]

    def similarities(self, i: int, words: list[bytes], h: np.ndarray, low: int, high: int, run: int) -> np.ndarray:
        """Weighted Jaccard of item i and each window of `run` shingles that starts from low to high, in one pass.

        A shingle that an item holds m times counts in a window for its last m places there: a place counts from
        where a window first reaches it until the window leaves it or reaches the m-th place of the same shingle after it.
        """
        known, counts, grams = self.shingles_of(i)
        part = h[low : high + run]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        places = np.flatnonzero(known[at] == part)
        # hashes that are equal are compared by their words
        places = np.array([p for p in places.tolist() if tuple(words[low + p : low + p + self.width]) == grams[at[p]]], dtype=np.int64)
        kinds = at[places]
        order = np.argsort(kinds, kind="stable")
        kinds, places = kinds[order], places[order]
        later = np.arange(len(places)) + counts[kinds]
        same = later < len(places)
        same[same] = kinds[later[same]] == kinds[same]
        until = np.where(same, places[np.minimum(later, len(places) - 1)] - run, len(part)) if len(places) else places
        first, last = np.maximum(places - run + 1, 0), np.minimum(np.minimum(places, until), high - low)
        first, last = first[first <= last], last[first <= last]
        change = np.bincount(first, minlength=high - low + 2) - np.bincount(last + 1, minlength=high - low + 2)
        both = change[: high - low + 1].cumsum()
        return both / (run + self.length - self.width + 1 - both)

    def near(self, block: int, value: int) -> np.ndarray:
        """The items whose block lies within its bound of a value."""
        got = self.lists.get((block, value))
        if got is None:
            if len(self.lists) >= LISTS:
                self.lists.clear()
            got = np.flatnonzero(np.bitwise_count(self.values[block] ^ np.uint32(value)) <= REACH[block])
            self.lists[block, value] = got
        return got

    def met(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that the index lets through."""
        pairs = []
        for block in range(len(REACH)):
            values, which = np.unique(prints.view(np.uint32)[:, block], return_inverse=True)
            lists = [self.near(block, v) for v in values.tolist()]
            sizes = np.array([len(x) for x in lists])
            if not sizes.any():
                continue
            many = sizes[which]
            turn = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
            items = np.concatenate(lists)[np.repeat((sizes.cumsum() - sizes)[which], many) + turn]
            pairs.append(np.repeat(np.arange(len(prints)), many) * len(self.ids) + items)
        every = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        return every // len(self.ids), every % len(self.ids)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits."""
        w, i = self.met(prints)
        near = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1, dtype=np.int32) <= RADIUS
        return w[near], i[near]


class Index:
    def __init__(self, rows: list[tuple[object, bytes]]):
        by: dict[int, list] = defaultdict(list)
        for item, text in rows:
            if words := text.translate(ALNUM).split():
                by[len(words)].append((item, words))
        self.lengths = [Items(v) for _, v in sorted(by.items())]
        self.widths = sorted({x.width for x in self.lengths})
        self.known = {w: Known(np.concatenate([x.known.sorted for x in self.lengths if x.width == w])) for w in self.widths}

    def match(self, words: list[bytes], ids: np.ndarray, least: float) -> dict[object, tuple[float, int, int, int]]:
        """item -> (best similarity, first word of the best window, words of it, windows that match)."""
        found: dict[object, tuple[float, int, int, int]] = {}
        marks = {}
        for width in self.widths:
            h = shingles(ids, width)
            at = self.known[width].places(h)
            if len(at):
                marks[width] = h, at
        for items in self.lengths if marks else []:
            if items.width not in marks:
                continue
            h, at = marks[items.width]
            size = min(items.length, len(words))
            if size < 0.8 * items.length:
                continue
            anchors = at[items.known.exact(h[at])]
            if not len(anchors):
                continue
            run = size - items.width + 1  # shingles of a window
            # windows that hold an anchor; neighbouring ones share one pass of sums
            for begin, end in covered(anchors, run, len(h) - run):
                step = max(WINDOWS, run)
                for low in range(begin, end + 1, step):
                    high = min(low + step - 1, end)
                    w, i = items.candidates(window_prints(h[low : high + run], run))
                    for one in np.unique(i).tolist():
                        own = w[i == one]
                        s = items.similarities(one, words, h, low + int(own[0]), low + int(own[-1]), run)[own - own[0]]
                        close = np.flatnonzero(s >= least)
                        if len(close):
                            top = int(close[s[close].argmax()])
                            best = found.get(items.ids[one], (0.0, 0, 0, 0))
                            mine = (float(s[top]), low + int(own[top]), size) if s[top] > best[0] else best[:3]
                            found[items.ids[one]] = (*mine, best[3] + len(close))
        return found


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's rows in blocks of bounded size."""
    rows, total = [], 0
    for r in benchmark.select(item, F.col(text).cast("binary").alias("t")).where("length(t) > 0").toLocalIterator():
        rows.append((r[0], bytes(r[1])))
        total += len(r[1])
        if len(rows) >= ITEM_ROWS or total >= ITEM_BYTES:
            yield rows
            rows, total = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, similarity, first_word, n_words, n_windows): the items that a document holds."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"{key} {kind}, {item} {item_kind.simpleString()}, similarity double, first_word bigint, n_words bigint, n_windows bigint"
    parts = blocks(benchmark, item, "text")
    now, out = next(parts, None), []
    if now is None:
        return spark.createDataFrame([], schema)
    while now is not None:
        shared = spark.sparkContext.broadcast(pickle.dumps(Index(now)))
        found = docs.select(key, "text").mapInArrow(_search(shared, least, key, item), schema)
        now = next(parts, None)
        if now is None and not out:
            return found
        # one block of items at a time, on the driver and in the tasks
        out.append(table(found, "block-matches"))
        shared.destroy()
    return reduce(DataFrame.unionByName, out)


def _search(shared, least: float, key: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = WordIds(word_hash), pickle.loads(shared.value)
        names = [key, item, "similarity", "first_word", "n_words", "n_windows"]
        for batch in batches:
            at, rows = [], []
            for n, text in enumerate(texts(batch, "text")):
                words = text.translate(ALNUM).split()
                for i, found in index.match(words, hash_ids(words, ids), least).items():
                    at.append(n)
                    rows.append((i, *found))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), *map(pa.array, zip(*rows, strict=True))], names)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents that hold no benchmark item."""
    hit = table(matches(docs, benchmark, least).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(sized_broadcast(hit), docs.doc_id.eqNullSafe(hit._id), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every benchmark item found in a document, with its best window."""
    return matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
