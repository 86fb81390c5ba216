"""Operator 7: license scan by an exact set-similarity join of templates with text blocks.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. The base
scan counts the places of fixed phrases. Beside it, each template (a set of words) is joined with
the blocks of a text: a block is any run of words, from whatever start, of the template's length
with a quarter more for words put in between (words / threshold); a shorter text is one block. A block meets a
template when it holds at least the given share of the template's distinct words. The join is
exact: it finds every such block, and compares only those that the filters leave. Words are ordered by how
few documents hold them, over the whole corpus, and

* prefix: a block that meets the threshold holds one of the |T| - need + 1 rarest words of T, so
  templates are looked up by these words, and only blocks around such a word are counted;
* length: around it stand `need` words of T at least;
* position: with the rarest word met at place i of T, it and the distinct words after it are enough.

The distinct words of all blocks of such a zone are counted in one sweep over their starts. What is
returned are runs of neighbouring blocks: their first and last start and the largest share.

Results in odd cases: a null text counts as empty and has no words, labels or places; repeated rows
are scanned each; very long texts are scanned whole; of two labels with equal shares both are given;
a template without words meets nothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .text import ALNUM, texts

# Fixed phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Fixed template texts (customary notices) and their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "licensed under the GNU General Public License, version 3",
    "lgpl": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain",
    "reserved": "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
}


#: Bytes of template texts that are broadcast at most.
MOST_BYTES = 64_000_000


def template_words(templates: dict[str, str]) -> dict[str, list[bytes]]:
    return {label: t.encode().translate(ALNUM).split() for label, t in templates.items()}


def template_table(rows: DataFrame) -> dict[str, str]:
    """Templates of a table (label, text), one text for each label; its size is checked before it is collected."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates; scan them in parts of {MOST_BYTES}")
    return {r.label: r.text for r in rows.select("label", "text").collect() if r.text is not None}


def frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the given words, over all documents."""
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for t in texts(batch, "text"):
                held = place.keys() & set(t.translate(ALNUM).split())
                counts[[place[w] for w in held]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(counts)], ["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r.word]: r.n for r in sums.collect()}  # a row for each template word


class Join:
    """Templates prepared for the join: words by rarity, prefixes, and the templates of each prefix word."""

    def __init__(self, templates: dict[str, list[bytes]], counts: dict[bytes, int], least: float):
        every = sorted(set().union(*templates.values()), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.none = len(every)
        #: label, words of a block, distinct words in order of their ranks, how many of them are needed
        self.rows: list[tuple[str, int, np.ndarray, int]] = []
        by: dict[int, list[int]] = {}
        for label, words in templates.items():
            order = np.array(sorted({self.rank[w] for w in words}))
            if not len(order):
                continue
            need = math.ceil(least * len(order) - 1e-9)
            for r in order[: len(order) - need + 1].tolist():
                by.setdefault(r, []).append(len(self.rows))
            self.rows.append((label, math.ceil(len(words) / least - 1e-9), order, need))
        # prefix word -> its templates, as one list with starts
        self.starts = np.zeros(self.none + 2, dtype=np.int64)
        self.starts[1:] = np.cumsum([len(by.get(r, ())) for r in range(self.none + 1)])
        self.listed = np.array([t for r in range(self.none) for t in by.get(r, ())], dtype=np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ranks of the words; none for what no template holds."""
        return np.fromiter(map(self.rank.get, words, repeat(self.none)), dtype=np.int64, count=len(words))

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
        """(label, first and last start, best share) of each run of neighbouring blocks that meet a template."""
        known = np.flatnonzero(ids < self.none)
        met = ids[known]
        many = self.starts[met + 1] - self.starts[met]
        hits, many, first = known[many > 0], many[many > 0], self.starts[met[many > 0]]
        if not len(hits):
            return
        # every prefix hit with every template that has the word in its prefix
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        which, where = self.listed[np.repeat(first, many) + turn], np.repeat(hits, many)
        for t in np.unique(which).tolist():
            label, length, order, need = self.rows[t]
            yield from self.runs(ids, known, where[which == t], label, length, order, need)

    @staticmethod
    def runs(ids: np.ndarray, known: np.ndarray, hits: np.ndarray, label: str, length: int, order: np.ndarray, need: int) -> Iterator[tuple[str, int, int, float]]:
        """The runs of one template around its prefix hits."""
        own = known[np.isin(ids[known], order)]
        last = max(0, len(ids) - length)
        # the hits less than a block apart share a zone; a block with a hit lies inside its zone
        cuts = np.flatnonzero(np.diff(hits) >= length) + 1
        for zone in np.split(hits, cuts):
            low, high = zone[0] - length + 1, zone[-1] + length - 1
            at = own[np.searchsorted(own, low) : np.searchsorted(own, high, side="right")]
            if len(at) < need:  # length: too few words of the template
                continue
            place = np.searchsorted(order, ids[at])
            head = place.min()
            # position: the rarest word is at place `head`; with the distinct words after it there must be enough
            if min(len(order) - head, len(np.unique(place))) < need:
                continue
            # an occurrence counts for the blocks that hold it, but not the one before it of the same word
            turn = np.lexsort((at, place))
            before = np.full(len(at), -1, dtype=np.int64)
            same = place[turn][1:] == place[turn][:-1]
            before[turn[1:][same]] = at[turn[:-1][same]]
            opens = np.maximum(np.maximum(before + 1, at - length + 1), 0)
            closes = np.minimum(at, last)
            valid = opens <= closes
            edges = np.concatenate([opens[valid], closes[valid] + 1])
            steps = np.concatenate([np.ones(valid.sum(), dtype=np.int64), np.full(valid.sum(), -1, dtype=np.int64)])
            spots, inverse = np.unique(edges, return_inverse=True)
            total = np.bincount(inverse, weights=steps).astype(np.int64).cumsum()
            good = total[:-1] >= need  # from one spot up to the next the number stays
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield label, int(spots[a]), int(spots[b]) - 1, float(total[a:b].max()) / len(order)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of every place of a phrase."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        key, at = b" " + phrase.encode() + b" ", -1
        seen = last = 0
        while (at := line.find(key, at + 1)) >= 0:
            seen += line.count(b" ", last, at)
            last = at
            found.append((seen, label))
    return found


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] | DataFrame = TEMPLATES, key: str = "doc_id") -> DataFrame:
    """One row for each document; matches has (label, first and last start, share) of every run of blocks found."""
    sets = template_words(templates if isinstance(templates, dict) else template_table(templates))
    join = Join(sets, frequencies(docs, sorted(set().union(*sets.values()))), least)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(join))  # the templates' words, of checked size
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(match)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            rows = []
            for t in texts(batch, "text"):
                words = t.translate(ALNUM).split()
                places = base_places(words)
                found = list(own.blocks(own.ids(words)))
                starts, labels = [p for p, _ in places], sorted({x for _, x in places})
                every = sorted({*labels, *(x for x, *_ in found)})
                share = 1.0 if places else max((s for *_, s in found), default=0.0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(every), share, [{"label": a, "first": b, "last": c, "share": s} for a, b, c, s in found]))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *cols], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,first:bigint,last:bigint,share:double>>"
    return docs.select(key, "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: base places and all license labels of every document."""
    return scan(documents(spark, sf_dir)).drop("matches")
