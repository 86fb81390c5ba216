"""Text functions: titles, genres, tags, slugs, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of a year at the end of a title.
STRICT_YEAR = r"\((\d{4})\)\s*$"
RELAXED_YEAR = r"\((\d{4})\)+\s*$"
NO_GENRES = "(no genres listed)"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode white space included (trim knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title_year(raw: Column) -> Column:
    """struct(title, year, mode): mode is strict, relaxed or null; without a year the title is the whole text."""
    text = strip(raw)
    strict, relaxed = F.regexp_extract(text, STRICT_YEAR, 1), F.regexp_extract(text, RELAXED_YEAR, 1)
    mode = F.when(strict != "", "strict").when(relaxed != "", "relaxed")
    title = F.when(mode == "strict", F.regexp_replace(text, STRICT_YEAR, "")).when(mode == "relaxed", F.regexp_replace(text, RELAXED_YEAR, "")).otherwise(text)
    year = F.when(mode == "strict", strict).when(mode == "relaxed", relaxed).try_cast("bigint")
    return F.struct(F.regexp_replace(title, r"(?U)\s+$", "").alias("title"), year.alias("year"), mode.alias("mode"))


def is_blank(c: Column) -> Column:
    """Null counts as blank."""
    return c.isNull() | (strip(c) == "")


def genres(c: Column, keep_unlisted: bool = False) -> Column:
    """Pipe-separated names, stripped; empty ones go, and so does the unlisted mark unless kept."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda x: (x != "") if keep_unlisted else (x != "") & (x != NO_GENRES))


def tag_text(c: Column) -> Column:
    """Lower case, white space collapsed and stripped."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def json_list(c: Column) -> Column:
    """A JSON text as a list of strings; null for what is not one."""
    return F.from_json(c, "array<string>")


def multi_hot(names: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda g: F.when(F.array_contains(names, g), 1).otherwise(0))


def list_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def run_id(c: Column) -> Column:
    """What is no letter, digit, dot, dash or underscore becomes one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(part: Column, whole: Column) -> Column:
    """One digit; 0.0% of nothing."""
    return F.when(whole == 0, "0.0%").otherwise(F.format_string("%.1f%%", F.lit(100.0) * part / F.when(whole != 0, whole)))


def not_a_list(c: Column) -> Column:
    """Whether a JSON text is something else than a list."""
    return F.coalesce(~F.startswith(F.ltrim(c), F.lit("[")), F.lit(True)) | json_list(c).isNull()
