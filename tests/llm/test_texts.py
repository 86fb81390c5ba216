"""Token counts, licenses, decontamination and the two classifiers."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, licenses, quality, queries, tokens, toxicity
from larkspur.llm.text import ALNUM

BIG = "word next " * 9000


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# op2


def encode(text):
    got = tokens.tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False)
    return np.array(got.ids, dtype=np.int64), np.array([a for a, _ in got.offsets], dtype=np.int64)


def test_tokens_equal_the_library(spark, sf):
    own = tokens.tokenizer("word_bpe_49k.json")
    for r in tokens.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        n = len(own.encode(r.text, add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(r.text.encode()), n > 2048)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (100, 16), (1000, 64)])
@pytest.mark.parametrize("text", [BIG[:7000], BIG.replace(" ", "")[:3000], "é́ <|endoftext|> it's 12345 'll " * 150, "a" * 4000 + " " + "b" * 2000, "漢字　" * 900, "x<|endoftext|>y" * 300, " " * 5000, "", "one"])
def test_splices(text, chunk, overlap):
    assert tokens.spliced(encode, text, chunk, overlap) == len(encode(text)[0])


def test_token_cases(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (3, "<|endoftext|> a"), (4, BIG)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id bigint, text string, n_tokens int, extra string")
    got = [(r.doc_id, r.n_tokens, r.over_limit, r.extra) for r in tokens.counted(docs).orderBy("doc_id").collect()]
    assert got == [(1, 0, False, "x"), (2, 0, False, "x"), (3, 2, False, "x"), (3, 2, False, "x"), (4, 18000, True, "x")]
    assert tokens.counted(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_with_each_tokenizer(spark, name):
    """Texts are cut only where the tokenizer's file says that white space is dropped."""
    texts_ = [BIG, "x  y\n\n z " * 8000, "a" * 40_000, "it's 12,5 é " * 6000]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    own = tokens.tokenizer(name)
    got = {r.doc_id: r.n_tokens for r in tokens.counted(docs, name).collect()}
    assert got == {k: len(own.encode(t, add_special_tokens=False)) for k, t in enumerate(texts_)}
    assert tokens.splits_at_space(name) == name.startswith("word")


# op7

NOTICE = licenses.TEMPLATES["mit"]


def brute_licenses(text, least=0.8, templates=licenses.TEMPLATES):
    """Every window of the text against every template."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, best = {label for _, label in places}, 0.0
    for label, words in licenses.template_words(templates).items():
        own, n = {x.decode() for x in words}, -(-len(words) * 10 // round(10 * least))
        if sum(x in own for x in w) < least * len(own) - 1e-9:
            continue
        top = max(len(own.intersection(w[k : k + n])) for k in range(max(1, len(w) - n + 1)))
        if top >= least * len(own) - 1e-9:
            found.add(label)
            best = max(best, top / len(own))
    starts = [i for i, _ in places]
    score = 1.0 if places else best
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), round(score, 9)


def test_licenses(spark, sf):
    rows = [*documents(spark, sf).items(), (9001, None), (9002, ""), (9003, NOTICE.upper()), (9003, NOTICE.upper()), (9004, "filler " * 500 + NOTICE.replace("charge", "cost") + " filler" * 500)]
    rows += [(9005, "Under the MIT license under the mit-license."), (9006, " ".join(NOTICE.split()[:12])), (9007, "cc by nc cc by nc")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, labels string")
    got = Counter(tuple(r) for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9)).collect())
    assert got == Counter((k, *brute_licenses(t)) for k, t in rows)
    by = {r.doc_id: r for r in licenses.scan(docs).where("doc_id > 9000").collect()}
    assert by[9004].labels == "mit" and 0.8 <= by[9004].score < 1 and by[9005].n_base == 2 and by[9005].score == 1 and by[9006].score == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_blocks_at_every_offset():
    """Notices with words changed, left out and put in, from whatever place they start: against every window."""
    rng = np.random.default_rng(4)
    sets = licenses.template_words(licenses.TEMPLATES)
    join = licenses.Join(sets, {}, 0.8)
    for label, words in sets.items():
        for _ in range(120):
            w = [x.decode() for x in words]
            for _ in range(int(rng.integers(0, 7))):
                at, kind = int(rng.integers(0, max(1, len(w)))), int(rng.integers(0, 3))
                w[at : at + (kind < 2)] = ["other"] * (kind != 1)
            filler = rng.choice(["the", "to", "other", "license", "x"], int(rng.integers(0, 60))).tolist()
            text = " ".join([*filler, *w, *filler[: int(rng.integers(0, 60))]])
            found = list(join.blocks(join.ids(text.encode().split())))
            *_, base, labels, score = brute_licenses(text)
            assert ",".join(sorted({*(x for x, *_ in found), *filter(None, base.split(","))})) == labels
            assert base or round(max((s for *_, s in found), default=0.0), 9) == score


def test_license_templates_from_a_table(spark):
    rows = spark.createDataFrame([("one", "alpha beta gamma delta"), ("two", ""), ("three", None)], "label string, text string")
    docs = spark.createDataFrame([(1, "x delta alpha gamma beta y", "m"), (2, "alpha beta", "m")], "doc_id bigint, text string, matches string")
    got = {r.doc_id: (r.labels, r.matches) for r in licenses.scan(docs, templates=rows).collect()}
    assert got[1][0] == "one" and [tuple(m) for m in got[1][1]] == [("one", 0, 1, 1.0)] and got[2] == ("", [])


# op6


def test_leaks(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(2000)]
    items = [(k, rng.choice(words, int(rng.integers(15, 50))).tolist()) for k in range(30)]
    docs = []
    for k in range(120):
        w = rng.choice(words, int(rng.integers(5, 300))).tolist()
        part = list(items[k % 30][1])
        if k % 2 == 0:
            for _ in range(k % 4):
                part[int(rng.integers(0, len(part)))] = "other"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = part
        docs.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    items += [(30, items[0][1]), (31, []), (32, ["short", "item"])]
    docs += [(200, None), (201, ""), (202, " ".join(items[1][1][:-1])), (203, "a SHORT item"), (203, "a SHORT item")]
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string").unionByName(spark.createDataFrame([(33, None)], "item_id bigint, text string"))
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id bigint, text string, similarity double")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.matches(d, b).collect())
    want = Counter()
    for k, t in docs:
        w = (t or "").encode().translate(ALNUM).split()
        for i, x in items:
            x = " ".join(x).encode().split()
            n = min(len(w), len(x))
            if not n or n < 0.8 * len(x):
                continue
            best = max(decontaminate.similarity(w[s : s + n], x, min(5, len(x))) for s in range(len(w) - n + 1))
            if best >= 0.8:
                want[k, i, round(best, 9)] += 1
    assert got == want and len(want) > 20
    assert {r.doc_id for r in decontaminate.keep_clean(d, b).collect()} == {k for k, _ in docs} - {k for k, _, _ in want}
    assert decontaminate.matches(d.limit(0), b).count() == 0 == decontaminate.matches(d, b.limit(0)).count()


def changed(rng, words, n):
    """A text with n of its words replaced in runs."""
    w = list(words)
    for _ in range(n):
        w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 10**9)}"
    return w


@pytest.mark.parametrize("length", [3, 6, 9, 12, 15, 20, 30, 45, 60, 100, 200])
def test_index_finds_all_within_the_radius(length):
    """Against all pairs: the index loses nothing within RADIUS, lets few others through, and the radius holds
    what is similar."""
    rng = np.random.default_rng(length)
    words = [f"w{k}".encode() for k in range(3000)]
    rows = [(k, rng.choice(words, length).tolist()) for k in range(120)]
    items = decontaminate.Items(rows)
    hashed = lambda w: decontaminate.shingles(np.array([decontaminate.word_hash(x) for x in w], dtype=np.int64), items.width)
    prints, own, like = [], [], []
    for k in range(1200):
        w = changed(rng, [x.decode() for x in rows[k % 120][1]], int(rng.integers(0, 1 + max(1, length // 15))))
        w = [x.encode() for x in w]
        prints.append(decontaminate.window_prints(hashed(w), max(1, length - items.width + 1))[0])
        own.append(k % 120)
        like.append(decontaminate.similarity(w, rows[k % 120][1], items.width))
    prints = np.array(prints)
    apart = np.bitwise_count(prints[:, None, :] ^ items.prints[None, :, :]).sum(axis=2, dtype=np.int32)
    assert set(zip(*(x.tolist() for x in items.candidates(prints)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)), strict=True))
    unrelated = np.ones(apart.shape, dtype=bool)
    unrelated[np.arange(len(own)), own] = False
    met = np.zeros(apart.shape, dtype=bool)
    met[items.met(prints)] = True
    close = np.flatnonzero(np.array(like) >= 0.8)
    recall = (apart[close, np.array(own)[close]] <= decontaminate.RADIUS).mean()
    print(f"{length} words: {len(close)} windows of 0.8 or more, recall {recall:.4f}, unrelated pairs past the index {met[unrelated].mean():.4f}")
    assert len(close) > 100 and recall >= 0.995 and met[unrelated].mean() < 0.05


@pytest.mark.parametrize("vocabulary", [3, 12, 400])
def test_sliding_similarities_equal_single_ones(vocabulary):
    """All windows in one pass, repeated shingles included, against the counts of each window."""
    rng = np.random.default_rng(vocabulary)
    words = [f"w{k}".encode() for k in range(vocabulary)]
    for length in (2, 5, 9, 40):
        rows = [(k, rng.choice(words, length).tolist()) for k in range(5)]
        items = decontaminate.Items(rows)
        doc = [*rng.choice(words, 60).tolist(), *rows[2][1], *rows[2][1][: length // 2], *rows[2][1], *rng.choice(words, 30).tolist()]
        ids = np.array([decontaminate.word_hash(w) for w in doc], dtype=np.int64)
        h, run = decontaminate.shingles(ids, items.width), length - items.width + 1
        for i in range(5):
            want = [decontaminate.similarity(doc[s : s + length], rows[i][1], items.width) for s in range(len(h) - run + 1)]
            np.testing.assert_allclose(items.similarities(i, doc, h, 0, len(h) - run, run), want)
            np.testing.assert_allclose(items.similarities(i, doc, h, 7, 31, run), want[7:32])


def test_spans_of_windows():
    rng = np.random.default_rng(4)
    for _ in range(200):
        last, run = int(rng.integers(0, 60)), int(rng.integers(1, 9))
        anchors = np.unique(rng.integers(0, last + run, int(rng.integers(1, 12))))
        want = sorted({s for a in anchors.tolist() for s in range(a - run + 1, a + 1) if 0 <= s <= last})
        assert [s for a, b in decontaminate.covered(anchors, run, last) for s in range(a, b + 1)] == want


def test_a_long_item_repeated_in_a_long_document():
    """Eight copies of an item of 3,000 words in one document: the work is that of the document's length."""
    import time

    rng = np.random.default_rng(6)
    words = [f"w{k}".encode() for k in range(5000)]
    item = rng.choice(words, 3000).tolist()
    doc = []
    for k in range(8):
        copy = list(item)
        copy[10 * k] = b"other"
        doc += copy
    index = decontaminate.Index([(1, b" ".join(item)), (2, b" ".join(rng.choice(words, 3000).tolist()))])
    ids = np.array([decontaminate.word_hash(w) for w in doc], dtype=np.int64)
    began = time.process_time()
    found = index.match(doc, ids, 0.8)
    took = time.process_time() - began
    print(f"24,000 words against 3,000: {took:.2f} s")
    s, start, size, n = found[1]
    assert list(found) == [1] and (start, size) == (0, 3000) and s > 0.99 and n > 1000 and took < 10


def test_items_in_several_blocks(spark, monkeypatch):
    """Blocks of items follow each other, and the result is the same."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(words, 20))) for k in range(25)]
    docs = [(k, " ".join([*rng.choice(words, 10), items[k % 25][1], *rng.choice(words, 5000 if k == 3 else 10)])) for k in range(40)]
    b, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    one = sorted(map(tuple, decontaminate.matches(d, b).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_ROWS", 4)
    assert sorted(map(tuple, decontaminate.matches(d, b).collect())) == one and len(one) == 40


# op9 and op10


@pytest.fixture(scope="module")
def labelled_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(600):
        w = rng.choice(words, int(rng.integers(20, 200))).tolist()
        toxic, good = int(k % 5 == 0), int(k % 4 != 1)
        for _ in range(3 * toxic):
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(["vile", "nasty", "awful"])))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((k, text, "en", "s", 0.25))
        if k < 500:
            labels.append((k, good, toxic))
    rows += [(1000, None, "en", "s", 0.25), (1001, "", "en", "s", 0.25), (1001, "", "en", "s", 0.25), (1002, "word1 " * 60_000 + "vile nasty awful", "en", "s", 0.25)]
    labels += [(0, None, None), (1, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(labelled_texts):
    docs, labels = labelled_texts
    got = toxicity.score(docs.drop("score"), labels).withColumn("held", toxicity.fold() == 0).collect()
    held = [r for r in got if r.held and r.doc_id < 600]
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 604
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] < 0.5 < by[1002]  # at the end of a very long text
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {0.25}


def test_quality(labelled_texts):
    docs, labels = labelled_texts
    got = quality.score(docs.drop("score"), labels).withColumn("held", toxicity.fold() == 0).collect()
    held = [r for r in got if r.held and r.doc_id < 600]
    right = sum((r.score >= 0.3) == (r.doc_id % 4 != 1) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 604


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_the_fit_is_bounded_on_the_executors(labelled_texts, module, label):
    """An id that a hundred thousand rows share is one text of the fit, and words are bounded before they are collected."""
    docs, labels = labelled_texts
    hot = docs.where("doc_id = 6").crossJoin(docs.sparkSession.range(100_000)).drop("id")
    rows = module.labelled(docs.unionByName(hot), labels, label, 300)
    assert rows.count() == rows.select("_order").distinct().count() <= 300
    sized = rows.withColumn("n", F.size(F.split("text", " ")).cast("long"))
    assert 0 < toxicity.bounded(sized, "n", 2000).agg(F.sum("n")).first()[0] <= 2000


def test_neighbours_that_tie_all_vote():
    space = quality.Space.__new__(quality.Space)
    space.vectors, space.labels = np.ones((60, 1), dtype=np.float32), np.array([1, 0, 0] * 20, dtype=np.float32)
    assert np.allclose(space.vote(np.ones((2, 1), dtype=np.float32)), 1 / 3)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels(labelled_texts, module):
    docs, labels = labelled_texts
    few = docs.limit(5).drop("score")
    assert module.score(few, labels.limit(0)).select("score").distinct().count() == 1
    assert module.score(few.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark, sf):
    """Turning over the labels of the held-out fold changes no score."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_registered():
    assert [f"op{n}_" for n in range(1, 11)] == [next(f"op{n}_" for q in queries.QUERIES if q.startswith(f"op{n}_")) for n in range(1, 11)]
    assert "pipeline" in queries.QUERIES
