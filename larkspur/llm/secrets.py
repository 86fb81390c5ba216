"""Operator 8: secret scan with multipart credential linking, in DataFrame functions only.

Base findings stand alone: keyword assignments, access key ids and long hex strings. Beside them,
weak parts are gathered (an account or key identifier, a possible secret value, an endpoint). A
weak part is reported only when a complementary part lies within `scope` code points of it in the
same text: an identifier or an endpoint needs a secret, a secret needs one of the two. The parts
meet in an interval join on (text, bin of positions), so no text's parts are paired all with all.

Positions are code points, the end exclusive. They come from the pieces between the matches of a
pattern (split) and the matches themselves (regexp_extract_all).

Results in odd cases: a null text counts as empty and has no spans; very long texts are scanned
whole, and their matches folded in pieces; values of any length are one span; rows that repeat an id
and text have the same spans; spans of one start are ordered by kind; an empty table gives an empty
result; other columns, whatever their names, are left out of the findings, and pass through redact(),
which replaces a column named n_chars only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, table, unused

# Fixed patterns of the base findings.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of the whole pattern AKIA[A-Z0-9]+ with 16 characters at least; a shorter run holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
#: Whole runs of [0-9a-f]+ with 32 characters at least.
HEX = r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")

#: Weak parts: role -> pattern.
WEAK = {
    "identifier": r"""(?i:\b(?:access_?key_?id|client_?id|account|user_?name|user|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "secret": r"""(?i:\b(?:secret_?(?:access_?)?key|client_?secret|private_?key|auth_?key|credential|signature|pwd|pass))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    "endpoint": r"""(?i:\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://)[A-Za-z0-9.:@_-]{3,}""",
}
KINDS = (*BASE, *WEAK)
#: What each base finding counts as when weak parts look for a complement.
ROLE = {"access": "identifier", "assign": "secret", "hex": "secret"}

SPAN = "array<struct<start:int,end:int>>"


def pieces_of(items: Column, body) -> Column:
    """body(piece, place) over an array cut into pieces of about the square root of its length.

    A fold that grows an array copies it at every step; folding piece by piece keeps a text with very
    many matches from taking the square of their number.
    """

    def cut(one: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(one))).cast("int"))
        places = F.when(F.size(one) > 0, F.sequence(F.lit(0), F.floor((F.size(one) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: body(F.slice(one, (k * size + 1).cast("int"), size), k))

    # in a transform over one element, so that the items are computed once
    return F.flatten(F.transform(F.array(items), cut))


def found(text: Column, pattern: str, group: int = 0, at_least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group has at_least characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    own = (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), own(m).alias("own")))
    # the last piece has no match after it
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,own:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["own"].alias("own")))).alias("spans"))

    # spans from the start of their piece; then each piece is moved by the lengths of those before it
    folded = pieces_of(steps, lambda piece, k: F.aggregate(piece, start, step))

    def moved(parts: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda t, p: t + p["at"])
        shift = lambda p, by: F.transform(p["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["own"].alias("own")))
        return F.flatten(F.transform(parts, lambda p, k: shift(p, before(k))))

    # the parts are folded once, too
    spans = F.flatten(F.transform(F.array(folded), moved))
    kept = F.transform(F.filter(spans, lambda s: s["own"] >= at_least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(F.array().cast(SPAN))


def listed(spans: dict[str, Column]) -> Column:
    """Spans of several kinds as one sorted array of (start, place of the kind, end, kind)."""

    def row(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.array_sort(F.concat(*(F.transform(c, row(kind)) for kind, c in spans.items())))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def extract(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, _text_id, base spans, weak spans): one scan of the texts, kept in the shared folder."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = {"assign": found(body, ASSIGN, 2, 8), "access": found(body, ACCESS), "hex": found(body, HEX)}
    kinds |= {role: found(body, p) for role, p in WEAK.items()}
    weak = sum((F.size(k) for k in WEAK), F.lit(0))
    got = docs.select(F.col(key).alias("_key"), F.when(F.length(body) > 0, F.col(text)).alias("_body"), *(c.alias(k) for k, c in kinds.items()))
    # only texts with a weak part take part in the linking and need an id
    text_id = F.when(weak > 0, F.sha2(F.concat_ws("\x01", F.col("_key").cast("string"), "_body"), 256))
    return table(got.select("_key", text_id.alias("_text_id"), *KINDS), "secret-spans")


def linked(spans: DataFrame, scope: int = 200, width: int = 256) -> DataFrame:
    """(_text_id, linked): the weak parts that have a complement within scope."""

    def part(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(ROLE.get(kind, kind)).alias("role"), s["start"].alias("start"), s["end"].alias("end"))

    flat = F.concat(*(F.transform(k, part(k)) for k in KINDS))
    parts = spans.where("_text_id is not null").select("_text_id", F.inline(flat)).distinct()
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    secrets = parts.where("role = 'secret'").select("_text_id", bins(F.col("start"), F.col("end")).alias("bin"), F.struct("kind", "start", "end").alias("s"))
    others = parts.where("role <> 'secret'").select("_text_id", bins(F.col("start") - scope, F.col("end") + scope).alias("bin"), F.struct("kind", "start", "end").alias("o"))
    near = (F.col("o.start") <= F.col("s.end") + scope) & (F.col("o.end") + scope >= F.col("s.start"))
    met = secrets.join(others, ["_text_id", "bin"]).where(near)
    both = met.select("_text_id", F.explode(F.array("s", "o")).alias("p")).where(F.col("p.kind").isin(*WEAK)).distinct()
    place = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("p.kind"))
    return both.groupBy("_text_id").agg(F.collect_list(F.struct(F.col("p.start").alias("start"), place.alias("place"), F.col("p.end").alias("end"), F.col("p.kind").alias("kind"))).alias("linked"))


def scan(docs: DataFrame, scope: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: the key, base spans by kind, and all spans in order."""
    spans = extract(docs, text, key)
    base = listed({k: F.col(k) for k in BASE})
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    # texts without weak parts do not go through the join
    plain = spans.where("_text_id is null").withColumn("linked", none)
    rest = spans.where("_text_id is not null").join(linked(spans, scope), "_text_id", "left").withColumn("linked", F.coalesce("linked", none))
    rows = plain.unionByName(rest)
    return rows.select(F.col("_key").alias(key), *BASE, base.alias("base"), F.array_sort(F.concat(base, "linked")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: counts, digest of the base spans and all spans of every document."""
    found_ = scan(documents(spark, sf_dir))
    return found_.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]", text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every span of the scan replaced by a mark, n_chars counted anew; no row is dropped.

    Rows are matched to their spans by id and text, so repeated ids do not mix.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    touched = _touched(body)
    # texts in which no pattern occurs pass by without a shuffle
    row_id, spans = unused(docs, "_row_id"), unused(docs, "_spans")
    hits = table(docs.where(touched).withColumn(row_id, F.sha2(F.concat_ws("\x01", F.col(key).cast("string"), body), 256)), "secret-hits")
    one = hits.select(row_id, F.col(text).alias("_text")).distinct()
    found_ = scan(one, scope, "_text", row_id).select(row_id, F.col("spans").alias(spans)).where(F.size(spans) > 0)
    joined = hits.join(found_, row_id, "left")
    hit = F.size(spans) > 0
    edited = joined.withColumn(text, F.when(hit, _cut(body, F.col(spans), mark)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~touched).unionByName(edited.select(*docs.columns))


def _touched(body: Column) -> Column:
    """Whether any pattern, base or weak, occurs."""
    patterns = (ASSIGN, ACCESS, HEX, *WEAK.values())
    out = F.regexp_like(body, F.lit(patterns[0]))
    for p in patterns[1:]:
        out = out | F.regexp_like(body, F.lit(p))
    return out


def _cut(body: Column, spans: Column, mark: str) -> Column:
    """body with the union of the sorted spans replaced by the mark."""
    last = lambda ss: F.array_max(F.transform(ss, lambda s: s["end"]))

    def part(piece: Column, begin: Column) -> Column:
        """What a piece of the spans makes of the body from begin to the piece's end."""

        def over(own: Column) -> Column:
            start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))

            def step(state: Column, s: Column) -> Column:
                fresh = s["start"] >= state["at"]
                lead = F.when(fresh, F.array(F.substring(own, state["at"] - begin + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], lead).alias("out"))

            return F.aggregate(piece, start, step, lambda s: F.array_join(s["out"], ""))

        # a place in a string is found from its start: the piece's own text is taken out once
        return F.array_join(F.transform(F.array(F.substring(body, begin + 1, F.greatest(F.lit(0), last(piece) - begin))), over), "")

    def joined(pieces: Column) -> Column:
        # each piece of the spans begins where those before it end
        begin = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda t, p: F.greatest(t, last(p)))
        return F.array_join(F.transform(pieces, lambda p, k: F.array_join(F.transform(F.array(begin(k)), lambda at: part(p, at)), "")), "")

    pieces = pieces_of(spans, lambda piece, k: piece)
    end = F.coalesce(last(spans), F.lit(0))
    return F.concat(F.array_join(F.transform(F.array(pieces), joined), ""), F.substring(body, end + 1, F.length(body)))
