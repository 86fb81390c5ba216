"""Operator 2: token counts of whole texts with a public tokenizer.

A huge text is encoded in overlapping chunks with offsets. Neighbouring chunks are spliced at a
position where both begin a token, right after ASCII white space that both have seen: the tokenizer
drops white space before it splits words, so no token crosses it and nothing before it bears on what
follows. The ids from the splice to the last such position must agree too. Where the overlap holds
no such position, it is doubled, and in the end the chunk itself grows; so a text without white
space is encoded whole. That the tokenizer drops white space is read from its file (splits_at_space);
with one that may keep it, every text is encoded whole.

Results in odd cases: a null text counts as empty: 0 bytes, 0 tokens; bytes that are not UTF-8 count as bytes,
and as U+FFFD for the tokenizer; special strings inside a
text count as the library's default has them; repeated rows are counted each; an empty table gives an
empty result; other columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .text import texts

#: Characters of a chunk and of the first overlap; a text of at most a chunk is encoded whole.
CHUNK, OVERLAP = 32_768, 256
#: Bytes of short texts encoded in one call.
CALL = 262_144
LIMIT = 2048
SPACE = frozenset(" \t\n\r\x0b\x0c")


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of a file of public_tokenizers, or of a path; one for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


#: Parts of a normaliser that look at no white space beside what they change.
PLAIN = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
PROBE = "ab cd\t12\n.,  it's\x0bx <b>\r\n'll\x0c9 é ü!? "


@lru_cache(maxsize=4)
def splits_at_space(name: str) -> bool:
    """Whether the file says that white space is dropped before words are split, so that texts may be cut there."""
    own = tokenizer(name)
    told = json.loads(own.to_str())
    listed = lambda part, names: part.get(names, [part]) if part else []
    for n in listed(told["normalizer"], "normalizers"):
        if n["type"] not in PLAIN and not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "):
            return False
    first = next(iter(listed(told["pre_tokenizer"], "pretokenizers")), None)
    if first is None or not (first["type"] in {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"} or (first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"])):
        return False
    return not any(PROBE[a:b] != PROBE[a:b].strip() for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(PROBE))


Encoded = tuple[np.ndarray, np.ndarray]  # ids, starts in the text


def spliced(encode: Callable[[str], Encoded], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks."""

    def at(a: int, b: int) -> Encoded:
        ids, starts = encode(text[a:b])
        return ids, starts + a

    done, splice = 0, 0
    end = min(chunk, len(text))
    ids, starts = at(0, end)
    while end < len(text):
        span, size = overlap, chunk
        while True:
            begin = max(splice, end - span)
            stop = min(len(text), begin + max(size, 2 * span))
            more, places = at(begin, stop)
            cut = common(text, ids, starts, more, places, begin, end)
            if cut is not None:
                break
            if begin == splice:
                # the overlap is the whole chunk: a longer one takes its place
                size *= 2
                end = min(len(text), splice + size)
                ids, starts = at(splice, end)
                if end == len(text):
                    return done + len(ids)
            span *= 2
        done += int(((starts >= splice) & (starts < cut)).sum())
        ids, starts, splice, end = more, places, cut, stop
    return done + int((starts >= splice).sum())


def common(text: str, ids: np.ndarray, starts: np.ndarray, more: np.ndarray, places: np.ndarray, begin: int, end: int) -> int | None:
    """A position between begin and end at which both encodings may be joined, if there is one."""
    both = np.intersect1d(starts[starts > begin], places[places < end])
    safe = [p for p in both.tolist() if text[p - 1] in SPACE]
    if len(safe) < 2:
        return None
    cut, last = safe[(len(safe) - 1) // 2], safe[-1]
    one, two = ids[(starts >= cut) & (starts < last)], more[(places >= cut) & (places < last)]
    return cut if np.array_equal(one, two) else None


def counted(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit."""
    keep = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = tokenizer(name), splits_at_space(name)

        def encode(text: str) -> Encoded:
            got = own.encode(text, add_special_tokens=False)
            return np.array(got.ids, dtype=np.int64), np.array([a for a, _ in got.offsets], dtype=np.int64)

        for batch in batches:
            sizes, tokens, waiting, load = [], np.zeros(batch.num_rows, dtype=np.int64), [], 0

            def flush() -> None:
                got = own.encode_batch_fast([t for _, t in waiting], add_special_tokens=False)
                for (n, _), x in zip(waiting, got, strict=True):
                    tokens[n] = len(x)
                waiting.clear()

            for n, raw in enumerate(texts(batch, "text")):
                sizes.append(len(raw))
                text = raw.decode("utf-8", "replace")
                if len(text) > CHUNK and cut:
                    tokens[n] = spliced(encode, text)
                    continue
                waiting.append((n, text))
                load += len(raw)
                if load >= CALL:
                    flush()
                    load = 0
            flush()
            cols = [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: bytes and tokens of every document."""
    return counted(documents(spark, sf_dir).select("doc_id", "text"))
