import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash


def brute(rows, width=3, radius=3):
    prints = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    a, root = np.array(prints, dtype=np.uint64), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", min(groups[find(i)])) for i in range(len(rows)))


def test_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, simhash.query(spark, sf).collect())) == brute(rows)


@pytest.mark.parametrize("tile", [4, 4096])
def test_hot_slices(spark, monkeypatch, tile):
    """Slice values with more rows than a tile are cut, and no link is lost."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    prints = []
    for b in base.tolist():
        for _ in range(6):
            for k in rng.choice(62, rng.integers(0, 3), replace=False).tolist():
                b ^= 1 << k
            prints.append(b)
    # many that share a slice of low bits
    prints += [int(x) << 20 for x in rng.integers(0, 1 << 42, 40)]
    prints = sorted(set(prints))
    distinct = spark.createDataFrame([(p, p, [p]) for p in prints], "node bigint, first bigint, fp array<bigint>")
    found = simhash.components(simhash.near_links(distinct, 3)).collect()
    got = {r.node: r.component for r in found}
    a = np.array(prints, dtype=np.int64).view(np.uint64)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            q = prints[int(j)]
            x, y = find(p), find(q)
            root[max(x, y)] = min(x, y)
    assert all(got.get(p, p) == find(p) for p in prints)


@pytest.mark.parametrize("n", [5, 24, 60, 700])
def test_thinned_edges_connect_what_all_pairs_connect(n):
    rng = np.random.default_rng(n)
    fp = np.zeros((n, 4), dtype=np.uint64)
    for k in range(n):
        # chains and clumps: each row a few bits from one before it
        fp[k] = fp[int(rng.integers(max(0, k - 8), k))] if k else rng.integers(0, 1 << 63, 4)
        for bit in rng.integers(0, 256, int(rng.integers(0, 9))):
            fp[k, bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    node = rng.permutation(10 * n)[:n].astype(np.int64)
    pop = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= 6

    def parts(pairs):
        root = {int(x): int(x) for x in node}
        for a, b in pairs:
            u, v = root[int(a)], root[int(b)]
            root = {k: min(u, v) if r in (u, v) else r for k, r in root.items()}
        return root

    want = parts([(node[i], node[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    for found in ([simhash.links(fp, node, pop, 6, block=64)], simhash.small_links(np.zeros(n, dtype=np.int64), fp, node, pop, 6)):
        src, dst = (np.concatenate(x) for x in zip(*found, strict=True))
        assert len(src) < 2 * n and parts(zip(src, dst, strict=True)) == want
        at = {int(x): k for k, x in enumerate(node)}
        assert all(near[at[int(a)], at[int(b)]] for a, b in zip(src, dst, strict=True))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (4, "one"), (5, "ONE"), (6, "a b c d " * 3000), (7, "other words here")]
    docs = spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id bigint, text string, fp string, node string")
    got = sorted((r.doc_id, r.component) for r in simhash.groups(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    text = lambda: rng.choice(words, 300).tolist()
    base = text()
    near = list(base)
    near[150] = "changed"
    rows = [(1, base), (2, base), (3, near), *((k, text()) for k in range(10, 30)), (30, base[:250]), (40, ["alone"]), (40, ["alone"]), (41, [])]
    docs = spark.createDataFrame([(k, " ".join(w), None, "s", 1) for k, w in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    # 30 has five sixths of the shingles of 1
    assert [k for k in kept if k != 30] == [1, *range(10, 30), 40, 41]


def test_keep_one_compares_exactly(spark):
    """Against all pairs: variants of a text from 0.6 to 0.98 similar; none below 0.8 may take a document along."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(60):
        text = rng.choice(words, 240).tolist()
        # a variant keeps a run of the words
        rows += [(2 * k, text), (2 * k + 1, text[: 145 + int(1.6 * k)] + rng.choice(words, 3).tolist())]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in rows}
    like = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)}
    assert {i for i in like} <= kept
    assert all(i + 1 in kept for i, x in like.items() if x < 0.8)
    close = [i for i, x in like.items() if x >= 0.8]
    assert sum(x < 0.8 for x in like.values()) > 20 and len(close) > 10
    assert sum(i + 1 not in kept for i in close) >= 0.99 * len(close)


def test_recall_at_the_border(spark):
    """The share of pairs of a similarity from 0.8 to 0.85 that the sampled slices bring together and keep_one drops."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(20_000)]
    rows, like = [], {}
    for k in range(500):
        a = rng.choice(words, 400).tolist()
        b = list(a)
        at, n = int(rng.integers(0, 320)), int(rng.integers(26, 40))
        b[at : at + n] = rng.choice(words, n).tolist()
        x, y = ({tuple(w[i : i + 5]) for i in range(396)} for w in (a, b))
        like[2 * k + 1] = len(x & y) / len(x | y)
        rows += [(2 * k, a), (2 * k + 1, b)]
    docs = spark.createDataFrame([(i, " ".join(w), "mine") for i, w in rows], "doc_id bigint, text string, _row string")
    out = simhash.keep_one(docs)
    kept = {r.doc_id for r in out.collect()}
    close = [i for i, s in like.items() if s >= 0.8]
    recall = sum(i not in kept for i in close) / len(close)
    print(f"{len(close)} pairs of 0.80 to {max(like.values()):.2f}: recall {recall:.4f}")
    assert out.columns == docs.columns and len(close) > 300 and recall >= 0.99
    assert all(i in kept for i, s in like.items() if s < 0.8)


def brute_kept(rows, least=0.8):
    """Ids that stay by all pairs: the smallest of each component of texts that are similar."""
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for _, w in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted({rows[r][0] for r in root})


@pytest.mark.parametrize("block", [64, 512])
def test_keep_one_in_a_large_family(spark, monkeypatch, block):
    """Several hundred texts related to one, most below 0.8 of it: links between them count, whatever the forest holds."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choice(words, 300).tolist()
    rows = []
    for _ in range(200):
        # each member replaces a part of the base; its copy changes a few words more
        text, at, n = list(base), int(rng.integers(0, 240)), int(rng.integers(30, 60))
        text[at : at + n] = rng.choice(words, n).tolist()
        copy = list(text)
        at = int(rng.integers(0, 270))
        copy[at : at + 20] = rng.choice(words, 20).tolist()
        rows += [(len(rows), text), (len(rows) + 1, copy)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    # slices of no bits: one tile holds all
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, tables=1, taken=0).collect())
    want = brute_kept(rows)
    assert 20 < len(want) < 300
    assert kept == want


def test_keep_one_with_repeated_lines(spark):
    """Repeats do not make texts alike, nor unlike: the sets of shingles decide."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(5000)]
    line = rng.choice(words, 7).tolist()
    # two texts of one repeated line, with different words behind it
    rows = [(k, line * 100 + rng.choice(words, 60).tolist()) for k in (1, 2)]
    text = rng.choice(words, 360).tolist()
    rows += [(3, text), (4, text + text[-60:] * 30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == brute_kept(rows) == [1, 2, 3]


def test_keep_one_of_rows_without_own_ids(spark):
    """Different texts stay, whatever their ids: none at all, or one that several rows share."""
    rng = np.random.default_rng(10)
    words = [f"w{k}" for k in range(5000)]
    text = lambda: " ".join(rng.choice(words, 200).tolist())
    one, two = text(), text()
    rows = [(None, text()) for _ in range(12)] + [(5, text()), (5, text())]
    copies = [(None, one), (7, one), (None, two), (None, two), (5, one), (5, one), (5, two)]
    docs = spark.createDataFrame(rows + copies, "doc_id bigint, text string")
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=order)
    assert got == sorted([*rows, (5, one), (5, two)], key=order)
