import random
import re
from collections import Counter

import pytest

from larkspur.llm import divergence
from tests.compare import duck_rows, spark_rows

SCHEMA = "text string, lang string, source string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, top=200):
    """Every term of every pair, by the letter."""
    docs = [((r[1] or ""), (r[2] or ""), TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[0] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x in docs if x[0] == lang for t in set(x[2]))
        kept = {t for t, k in df.items() if k >= 3}
        v, counts, whole = len(kept), {}, Counter()
        for x in docs:
            if x[0] == lang:
                c = Counter(t for t in x[2] if t in kept)
                counts.setdefault(x[1], Counter()).update(c)
                whole.update(c)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            for part, items in (("pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]), ("term", [(t, f(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]])):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "naïve", "漢字", "ABC"]
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = f"s{min(int(rng.expovariate(0.7)), 6)}"
        rows.append((rng.choice([" ", "\n", "1", "-"]).join(rng.choices(words[: 20 + 10 * len(source)], k=rng.randrange(0, 40))), lang, source, "x"))
    rows += [("copy of a copied Copy", "en", "s0", "")] * 70 + [("copy of a copied Copy", "en", "s3", "")] * 5 + [("copy of a copied Copy", "de", "s3", "")]
    rows += [(None, "en", "bare", ""), ("", "en", None, ""), (None, None, None, ""), ("only once", "fr", "a", ""), ("never twice", "fr", "b", ""), ("\x00\x01 12", "it", "a", "")]
    return rows


def got(df, **kw):
    return sorted(map(tuple, divergence.audited(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_sql(spark, duck, sf):
    df = divergence.query(spark, sf)
    assert spark_rows(df) == duck_rows(duck, divergence.SQL, df.columns)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_full_tables_and_pieces(spark, monkeypatch):
    """Tasks that hand on their counts early, texts that are split in pieces, and few ranks."""
    monkeypatch.setattr(divergence, "MOST", 7)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = rows_of(5)
    assert got(spark.createDataFrame(rows, SCHEMA), top=4) == brute(rows, top=4)


def test_too_many_sources_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_SOURCES", 2)
    rows = rows_of(7)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_copies_are_sent_and_split_once(spark):
    rows = [("the same text", "en", f"s{k % 3}", "") for k in range(300)] + [("the same text", "de", "s0", "")]
    texts = divergence.collapsed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.lang, sorted((c.source, c.n) for c in r.copies)) for r in texts) == [("de", [("s0", 1)]), ("en", [("s0", 100), ("s1", 100), ("s2", 100)])]


def test_long_division_is_exact():
    import numpy as np

    n, whole = np.array([0, 5, 10**12, 123_456_789_012]), np.array([7, 11, 3 * 10**12, 10**15])
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), whole.tolist(), strict=True)]


def test_empty_table(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0
