"""Numbers, dates and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(x: Column, digits: int = 6) -> Column:
    """Rounded half to even at so many digits."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(text: Column) -> Column:
    """An ISO text with Z or an offset as seconds."""
    return F.unix_micros(F.to_timestamp(text)) / F.lit(1e6)


def span_days(first: Column, last: Column) -> Column:
    return (last - first) / 86400.0


def close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def unit(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / n)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def vectors_close(a: Column, b: Column, atol: float = 1e-6) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol), lambda ok: ok)


def pad_left(a: Column, length: int, with_: int = 0) -> Column:
    return F.concat(F.array_repeat(F.lit(with_).cast("bigint"), F.greatest(F.lit(length) - F.size(a), F.lit(0))), a)


def pad_right(a: Column, length: int, with_: int = 0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(with_).cast("bigint"), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def clamped_year(seconds: Column, first: int = 1970, last: int = 2030) -> Column:
    """The year of an epoch, no earlier than the first and no later than the last."""
    return F.least(F.lit(last), F.greatest(F.lit(first), F.year(F.timestamp_seconds(F.floor(seconds))))).cast("bigint")
