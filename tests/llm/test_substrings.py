import hashlib

import numpy as np
import pytest

from larkspur.llm import substrings
from larkspur.llm.fmindex import Bits, FMIndex, Wavelet
from tests.compare import duck_rows, spark_rows


def brute(rows):
    own = {}
    split = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - 12):
            if k is not None:
                s = tuple(w[i : i + 13])
                own[s] = min(own.get(s, k), k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - 12):
            if own.get(tuple(w[i : i + 13]), 1 << 63) < (1 << 63 if k is None else k):
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def dedup(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, words string, own int")
    return sorted(map(tuple, substrings.dedup(docs).collect()), key=repr)


def texts(seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    passage = rng.choice(words, 60).tolist()
    rows = []
    for k in range(60):
        w = rng.choice(words, rng.integers(0, 120)).tolist()
        if k % 3 == 0:  # a third of the documents share a passage, in other surroundings each
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[int(rng.integers(0, 20)) :]
        rows.append((k, " ".join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (7, rows[8][1]), (None, rows[9][1]), (102, None), (103, ""), (104, "same " * 400), (105, "same " * 20), (106, "one two")]
    return rows


def test_equals_sql(spark, duck, sf):
    df = substrings.query(spark, sf)
    assert spark_rows(df) == duck_rows(duck, substrings.SQL, df.columns)


def test_equals_brute_force(spark):
    rows = texts()
    assert dedup(spark, rows) == brute(rows)


def test_small_shards_and_hot_minimisers(spark, monkeypatch):
    """Segments of frequent minimisers are cut into windows, shards are small: the same result."""
    monkeypatch.setattr(substrings, "HOT_BYTES", 300)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    rows = texts(5)
    assert dedup(spark, rows) == brute(rows)


def test_long_segments_of_one_minimiser(spark, monkeypatch):
    """Few segments, but very long ones: they are cut by their text, not by their number."""
    monkeypatch.setattr(substrings, "HOT_BYTES", 5000)
    rows = [(k, f"start{k} " + "ha " * (3000 + k) + f"end{k}") for k in range(6)] + texts(11)[:20]
    assert dedup(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [0, substrings.MOST_BLOCKS])
def test_full_filter_loses_nothing(spark, monkeypatch, most):
    """Also beyond the filter's load, where what passes is joined with the minimisers."""
    full = substrings.Filter(1, {0: b"\xff" * (1 << substrings.BLOCK_BITS - 3)})
    monkeypatch.setattr(substrings, "bloom", lambda keys, n=None: full)
    monkeypatch.setattr(substrings, "MOST_BLOCKS", most)
    rows = texts(7)
    assert dedup(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1 << 10, 1 << 12])
def test_regular_sequences_of_two_words_are_told_apart(n):
    """Thue-Morse sequences and their complements, which polynomials modulo 2^64 take for equal."""
    turn = np.array([bin(k).count("1") & 1 for k in range(n)])
    words = np.array([substrings.word_hash(b"left"), substrings.word_hash(b"right")])
    both = np.concatenate([words[turn], words[1 - turn], words[turn]])
    at = np.arange(3) * n
    one, other, again = substrings.contents(both, at, at + n)
    assert one == again != other and len(one) == 16


def test_regular_passages(spark):
    """Long passages of two words in that order and its complement, in several documents."""
    turn = [bin(k).count("1") & 1 for k in range(1 << 11)]
    one, other = (" ".join("la" if b == k else "le" for b in turn) for k in (0, 1))
    rows = [(1, one), (2, f"first {other}"), (3, f"{one} end"), (4, f"x {other} y"), (5, f"{other} {one}")]
    assert dedup(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert dedup(spark, []) == []


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_rank(n):
    rng = np.random.default_rng(n)
    bits = rng.random(n) < 0.4
    at = np.arange(n + 1)
    assert (Bits(bits).ones(at) == np.concatenate([[0], bits.cumsum()])).all()
    symbols = rng.integers(0, 37, n)
    w = Wavelet(symbols, 6)
    for s in range(37):
        _, hi = w.ranks(np.full(n + 1, s), np.zeros(n + 1, dtype=np.int64), at)
        assert (hi == np.concatenate([[0], (symbols == s).cumsum()])).all()


def test_backward_search():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 4, 40), 0) for _ in range(5)])
    index = FMIndex(text, 13)
    ends = np.array([e for e in range(13, len(text) + 1) if (text[e - 13 : e] > 0).all()])
    for length in (1, 2, 5):
        matched, lo, hi = index.statistics(text, ends, length)
        for e, m, a, b in zip(ends, matched, lo, hi, strict=True):
            p = text[e - length : e]
            count = sum((text[i : i + length] == p).all() for i in range(len(text) - length + 1))
            assert (b - a == count) if m == length else count == 1
