"""Operator 11: audit of how far the sources of a language diverge, with copies collapsed before counting.

1. Identical texts of a language become one row with the number of its copies in each source. Copies
   are counted by digest, and a text is sent once for each task that holds it, so a text that half of
   the rows share is a few rows.
2. Each distinct text is split once. A task keeps the counts of (lang, source, term) and the numbers of
   documents, weighted by the copies, and hands them on when its table is full; what is shuffled is counts.
3. A language keeps the terms of at least `least` of its documents. p of a term is read from its count.
4. Pairs of sources are evaluated sparsely. The sum over all kept terms of f(p, q) is what it would be
   if no term occurred in either source, plus for each source what its own terms change against the
   other's default p, which needs only how many terms have each count, plus a correction for the terms
   that both have. A task adds up the pairs of its terms and hands on sums; no pair of a term is a row.

All arithmetic is in integers: counts times 10^9 by long division, sums in 64 bits or decimals.

Results in odd cases: null texts, languages and sources count as empty ones; an empty text is a
document without terms; a source without kept terms has the default p for each; a language without
kept terms gives its pairs with 0 and no terms; one source alone gives no pairs; repeated rows
are documents of their own; very long texts are split in pieces; ties in rank go by the item's bytes;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, table

SCALE = 1_000_000_000
#: Bytes of a text that are split at once, and entries that a task's table of counts holds.
PIECE, MOST = 1 << 20, 400_000
#: A-Z to a-z, and every other ASCII byte but letters to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else (c if c > 127 or 97 <= c <= 122 else 32) for c in range(256))
#: Rows of the table of sources that are broadcast.
MOST_SOURCES = 100_000


def counted(text: bytes) -> Counter:
    """Occurrences of each term of a text."""
    text, out, at = text.translate(LETTERS), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each distinct text of a language with its copies by source."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    by_source = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = by_source.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def occurrences(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), to be added up by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = list(n)
                cols = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        size = 0
        for batch in batches:
            for lang, text, copies in zip(batch.column("lang"), batch.column("text").cast(pa.binary()), batch.column("copies"), strict=True):
                found = counted(text.as_py())
                for copy in copies.as_py():
                    n, docs = counts.setdefault((lang.as_py(), copy["source"]), (Counter(), Counter()))
                    times, before = copy["n"], len(n)
                    if times == 1:
                        n.update(found)
                        docs.update(found.keys())
                    else:
                        n.update({t: k * times for t, k in found.items()})
                        docs.update(dict.fromkeys(found, times))
                    size += len(n) - before
                    if size > MOST:
                        yield from told()
                        size = 0
        yield from told()

    return texts.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")


def share(n: str, size: str, terms: str = "v"):
    """p of a count among `size` occurrences of `terms` kept terms."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * ({n} + 1)) div ({size} + {terms})").cast("long")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """As share(): 10^9 (n + 1) / whole by long division, within 64 bits."""
    rest = n + 1
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Sources:
    """The sources of each language: names in order, their places, occurrences + kept terms, default p."""

    def __init__(self, rows):
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["lang"], []).append((r["source"], r["size"] + r["v"]))
        self.names = {lang: [s for s, _ in sorted(x)] for lang, x in by.items()}
        self.at = {lang: {s: i for i, s in enumerate(x)} for lang, x in self.names.items()}
        self.whole = {lang: np.array([w for _, w in sorted(x)], dtype=np.int64) for lang, x in by.items()}
        self.plain = {lang: shares(np.zeros(len(w), dtype=np.int64), np.maximum(w, 1)) for lang, w in self.whole.items()}

    def told(self, lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        names = pa.array(self.names[lang], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], ["lang", "source", "item", "value"])


PARTIAL = "lang string, source string, item string, value bigint"


def own_terms(histogram: DataFrame, known) -> DataFrame:
    """What each source's terms change against the other sources' default p; rows (lang, source, n, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sources = known.value
        now, mine, theirs = None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            if now is not None:
                lang, i = now
                others = np.arange(len(s.plain[lang]))
                me = np.full(len(others), i)
                yield s.told(lang, me, others, mine)
                yield s.told(lang, others, me, theirs)

        for batch in batches:
            for r in batch.to_pylist():
                lang = r["lang"]
                key = (lang, s.at[lang][r["source"]])
                plain = s.plain[lang]
                if key != now:
                    yield from told()
                    now, mine, theirs = key, np.zeros(len(plain), dtype=np.int64), np.zeros(len(plain), dtype=np.int64)
                i = key[1]
                p, default = shares(np.array([r["n"]]), s.whole[lang][i : i + 1]), plain[i : i + 1]
                mine += r["terms"] * (far(p, plain) - far(default, plain))
                theirs += r["terms"] * (far(plain, p) - far(plain, default))
        yield from told()

    return histogram.sortWithinPartitions("lang", "source").mapInArrow(run, PARTIAL)


def shared_terms(terms: DataFrame, known) -> DataFrame:
    """What the terms that two sources share change beside own_terms(); rows (lang, by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sources = known.value
        sums: dict[str, tuple[list, list]] = {}
        waiting = 0

        def added(lang: str) -> tuple[np.ndarray, np.ndarray]:
            pairs, back = np.unique(np.concatenate(sums[lang][0]), return_inverse=True)
            value = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(value, back, np.concatenate(sums[lang][1]))
            return pairs, value

        def told() -> Iterator[pa.RecordBatch]:
            for lang in [x for x in sums if sums[x][0]]:
                pairs, value = added(lang)
                yield s.told(lang, pairs // len(s.plain[lang]), pairs % len(s.plain[lang]), value)
            sums.clear()

        for batch in batches:
            by = batch.column("by")
            sizes, begins = pc.list_value_length(by).to_numpy(), by.offsets.to_numpy()[:-1] - by.offsets[0].as_py()
            flat = by.flatten()
            names, counts = flat.field("source"), flat.field("n").to_numpy()
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = langs.indices.to_numpy() == code
                plain = s.plain[lang]
                places = pc.index_in(names, pa.array(s.names[lang], pa.string())).fill_null(-1).to_numpy()
                codes, values = sums.setdefault(lang, ([], []))
                # terms of as many sources at once
                for k in np.unique(sizes[own & (sizes > 1)]).tolist():
                    rows = begins[own & (sizes == k)]
                    many = max(1, MOST // (k * k))
                    for at in range(0, len(rows), many):
                        cells = rows[at : at + many, None] + np.arange(k)
                        i = places[cells]
                        p, default = shares(counts[cells], s.whole[lang][i]), plain[i]
                        for part in range(0, k, 256):  # of a term that very many sources have, some rows of its pairs at a time
                            a, da, b, db = p[:, part : part + 256, None], default[:, part : part + 256, None], p[:, None, :], default[:, None, :]
                            pairs, back = np.unique((i[:, part : part + 256, None] * len(plain) + i[:, None, :]).ravel(), return_inverse=True)
                            value = np.zeros(len(pairs), dtype=np.int64)
                            np.add.at(value, back, (far(a, b) - far(a, db) - far(da, b) + far(da, db)).ravel())
                            codes.append(pairs)
                            values.append(value)
                            waiting += len(pairs)
            if waiting > MOST:
                for x in sums:
                    if sums[x][0]:
                        pairs, value = added(x)
                        sums[x] = ([pairs], [value])
                waiting = sum(len(y) for x in sums.values() for y in x[0])
                if waiting > MOST // 2:
                    yield from told()
                    waiting = 0
        yield from told()

    return terms.mapInArrow(run, PARTIAL)


def audited(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language, and the top terms of each source."""
    spark = docs.sparkSession
    # dealt by term once: the counts of a source and those of its language are added up where they are
    dealt = occurrences(collapsed(docs)).repartition("lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = table(
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
        .where(F.col("docs") >= least)
        .select("lang", F.col("term").cast("string").alias("term"), "total", "by"),
        "source-terms",
    )
    spread = terms.select("lang", "term", "total", F.inline("by"))
    # one row for each source of a language, and one for each language
    histogram = table(spread.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "source-counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("size"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sources = table(groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "all"]), "sources")
    few = sources.count() <= MOST_SOURCES
    small = F.broadcast if few else lambda x: x

    # terms: the rows above the language's share, of which each task keeps the first `top` of a source
    pq = spread.join(small(sources), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "size").alias("p"), share("total", "all").alias("q"))
    best = pq.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # pairs: as many rows as the result has
    if few:
        known = spark.sparkContext.broadcast(Sources(sources.select("lang", "source", "size", "v").toLocalIterator()))
        partial = own_terms(histogram, known).unionByName(shared_terms(terms.select("lang", "by"), known))
        changes = partial.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("change"))
    else:
        changes = joined_changes(spread, histogram, sources)
    plain = sources.select("lang", "source", "v", F.when(F.col("v") > 0, share("0", "size")).otherwise(F.lit(1)).cast("long").alias("p"))
    other = plain.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = plain.join(small(other), "lang").where("source <> item").join(changes, ["lang", "source", "item"], "left")
    value = F.expr("(cast(v as decimal(20, 0)) * (((p - q) * (p - q)) div q) + coalesce(change, 0))").cast("long")
    by_pair = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return by_pair.select(*cols).unionByName(by_term.select(*cols))


def joined_changes(spread: DataFrame, histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """The changes of pairs where the table of sources is too large to broadcast: by joins, languages being many."""
    own = sources.select("lang", "source", "size", "v", share("0", "size").alias("plain")).where("v > 0")
    other = own.select("lang", F.col("source").alias("item"), F.col("plain").alias("other"))
    counts = histogram.join(own, ["lang", "source"]).withColumn("p", share("n", "size")).join(other, "lang").where("source <> item")
    f = lambda p, q: f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"
    times = lambda x: F.expr(f"cast(terms as decimal(20, 0)) * ({x})").alias("value")
    mine = counts.select("lang", "source", "item", times(f"{f('p', 'other')} - {f('plain', 'other')}"))
    theirs = counts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), times(f"{f('other', 'p')} - {f('other', 'plain')}"))
    shown = spread.join(own, ["lang", "source"]).select("lang", "term", "source", share("n", "size").alias("p"), "plain")
    both = shown.join(shown.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("plain").alias("other")), ["lang", "term"]).where("source <> item")
    shared = both.select("lang", "source", "item", F.expr(f"{f('p', 'q')} - {f('p', 'other')} - {f('plain', 'q')} + {f('plain', 'other')}").cast("decimal(38,0)").alias("value"))
    every = mine.unionByName(theirs).select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")).unionByName(shared)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("change"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: divergence of all sources of each language."""
    return audited(documents(spark, sf_dir).select("lang", "source", "text"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY s.lang, s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
