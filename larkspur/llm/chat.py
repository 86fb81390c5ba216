r"""Operator 13: chat formatting by a grammar round trip.

The template writes a turn as `### role: text</turn>` and a line break. The grammar that reads it back:

    conversation = turn*
    turn         = "### " role ": " body "</turn>\n"
    escape       = "\" followed by one of \ # < :        stands for that character
    a "\" before anything else stands for itself

In a role, ": " that is not escaped ends it. In a body, "</turn>" ends it, and "### " begins a turn of its own,
though the one before has no end. Both count wherever they are read, so a text that holds them, or an
escape, does not come back as it was. A turn is therefore written plainly, read back and compared; where the
reader saw control strings or escapes in what should be text, these characters get a "\", and the turn is
read again, until it is the same. A reading may uncover new conflicts, so this can take several rounds; beyond
ROUNDS, every character that could matter is escaped, which always comes back.

Turns are written and checked where they are, then ordered by conversation. A task reads its sorted turns as a
stream and hands out a conversation's text in pieces of bounded size, cut between turns, with the spans of
assistant text; so a conversation of any length passes through in bounded memory, in one task, as the
digests of a whole conversation need one order.

Results in odd cases: null texts and roles are empty; a null id is a conversation of its own; null turns come
first; rows of one turn stand in order of role and of the text as written; equal rows are turns of their own; bytes that are not UTF-8 are
kept as they are, each counted as a character; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

BEGIN, BETWEEN, END = "### ", ": ", "</turn>\n"
ESCAPE = re.compile(r"\\([\\#<:])")
#: What the reader acts on in a role and in a body.
IN_ROLE, IN_BODY = re.compile(r"\\[\\#<:]|: "), re.compile(r"\\[\\#<:]|</turn>\n|</turn>|### ")
SPECIAL = re.compile(r"[\\#<:]")
#: Readings before everything that may matter is escaped, and characters of a piece of output.
ROUNDS, PIECE = 6, 4_000_000
LEARNT = "assistant"


class Unreadable(ValueError):
    """A text that the grammar does not have."""


def scanned(text: str, at: int, control: re.Pattern) -> tuple[int, str, list[int]]:
    """From `at`: where the part ends, the control string that ends it, and where escapes stand."""
    escapes = []
    for m in control.finditer(text, at):
        if m[0][0] != "\\":
            return m.start(), m[0], escapes
        escapes.append(m.start())
    return len(text), "", escapes


def unescaped(part: str) -> str:
    return ESCAPE.sub(r"\1", part)


def read(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and where the body begins and ends in it."""
    at = 0
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise Unreadable(f"no turn at {at}")
        begin = at + len(BEGIN)
        stop, found, _ = scanned(text, begin, IN_ROLE)
        if found != BETWEEN:
            raise Unreadable(f"no end of a role from {begin}")
        body = stop + len(BETWEEN)
        end, found, _ = scanned(text, body, IN_BODY)
        if not found:
            raise Unreadable(f"no end of a turn from {body}")
        yield unescaped(text[begin:stop]), unescaped(text[body:end]), body, end
        # a header inside a body begins the next turn; an end without its line break reads as one
        at = end if found == BEGIN else end + len(found)


def marked(part: str, places: list[int]) -> str:
    """A part with "\\" before the characters at these places."""
    out, last = [], 0
    for p in places:
        out += [part[last:p], "\\"]
        last = p
    return "".join([*out, part[last:]])


def conflicts(part: str, places: list[int], after: str, control: re.Pattern) -> set[int]:
    """Places of a part that are read as something else than text, once it is marked at `places`."""
    whole, own = marked(part, places) + after, [p + k for k, p in enumerate(places)]
    ours, length, found, at = set(own), len(whole) - len(after), set(), 0
    while at < length:
        end, seen, escapes = scanned(whole, at, control)
        # an escape that the template did not write, or an end that came too early
        wrong = [e for e in escapes if e not in ours and e < length] + ([end] if seen and end < length else [])
        found.update(p - bisect_left(own, p) for p in wrong)
        at = end + max(1, len(seen))
    return found


def plain(part: str, after: str, control: re.Pattern) -> str:
    """A part as the template writes it, escaped no more than its reading back needs."""
    places: set[int] = set()
    for _ in range(ROUNDS):
        new = conflicts(part, sorted(places), after, control) - places
        if not new:
            break
        places |= new
    return marked(part, sorted(places))


def rendered(role: str, text: str) -> str:
    """One turn, which the grammar reads back as just this role and text."""
    for write in (lambda part, after, control: part, plain, lambda part, after, control: SPECIAL.sub(r"\\\g<0>", part)):
        out = BEGIN + write(role, BETWEEN, IN_ROLE) + BETWEEN + write(text, END, IN_BODY) + END
        try:
            if [x[:2] for x in read(out)] == [(role, text)]:
                return out
        except Unreadable:
            pass
    raise Unreadable(f"a turn of {len(text)} characters does not come back")


def decoded(value) -> str:
    return (value.as_py() or b"").decode("utf-8", "surrogateescape")


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment): each row as the template writes it."""
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(c).cast(pa.binary()) for c in ("role", "text"))
            out = [encoded(rendered(decoded(r), decoded(t))) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), roles, pa.array(out, pa.binary())], ["conv_id", "turn", "role", "segment"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role binary, segment binary")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, text, loss): the formatted text of each conversation in pieces, and the spans of characters
    of each piece that training learns from (start, end), which hold assistant texts as they are written."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, piece, parts, spans, size = ["conv_id", "piece", "text", "loss"], (), 0, [], [], 0
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def told(like: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(now, like.type), pa.array([piece], pa.int64()), pa.array([encoded("".join(parts))], pa.binary()), pa.array([spans], span)], names)

        like = None
        for batch in batches:
            like = batch.column("conv_id")
            for conv, segment in zip(like.to_pylist(), batch.column("segment"), strict=True):
                if now != (conv,) or size > PIECE:
                    if now:
                        yield told(like)
                    piece = piece + 1 if now == (conv,) else 0
                    now, parts, spans, size = (conv,), [], [], 0
                text = decoded(segment)
                for role, _, begin, end in read(text):
                    if role == LEARNT:
                        spans.append({"start": size + begin, "end": size + end})
                parts.append(text)
                size += len(text)
        if now:
            yield told(like)

    ordered = turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    out = ordered.select("conv_id", "segment").mapInArrow(run, f"conv_id {kind}, piece bigint, text binary, loss array<struct<start: bigint, end: bigint>>")
    return out.withColumn("text", F.col("text").cast("string"))


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the formatted text and its
    loss spans; the pieces of a conversation follow each other, as formatted() gives them."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, like = (), None
        n = chars = learnt = 0
        whole, loss = hashlib.sha256(), hashlib.sha256()

        def told() -> pa.RecordBatch:
            cols = [pa.array(now, like.type), *(pa.array([x]) for x in (n, whole.hexdigest(), learnt, loss.hexdigest(), chars))]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            like = batch.column("conv_id")
            for conv, raw, spans in zip(like.to_pylist(), batch.column("text"), batch.column("loss"), strict=True):
                if now != (conv,):
                    if now:
                        yield told()
                    now, n, chars, learnt, whole, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = decoded(raw)
                for role, said, _, _ in read(text):
                    n += 1
                    whole.update(encoded(f"{role}\n{said}\n"))
                for s in spans.as_py():
                    said = unescaped(text[s["start"] : s["end"]])
                    learnt += len(said)
                    loss.update(encoded(said))
                chars += len(text)
        if now:
            yield told()

    return pieces.select("conv_id", F.col("text").cast("binary").alias("text"), "loss").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts hold the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """op13: what the formatted conversations give when they are read back, and one that conflicts with the template."""
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    planted = planted.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns))
    return read_back(formatted(rows.unionByName(planted)))
