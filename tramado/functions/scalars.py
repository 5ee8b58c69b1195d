"""Dates, numbers, vectors and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(c: Column) -> Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def year_prefix(c: Column) -> Column:
    """The first four characters if they are digits, whatever follows."""
    return F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4))


def semester(c: Column) -> Column:
    return F.concat_ws("-S", F.year(c), F.floor((F.month(c) - 1) / 6) + 1)


def quarter(c: Column) -> Column:
    return F.concat_ws("-Q", F.year(c), F.quarter(c))


def span_years(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / F.lit(365.25)


def hash_number(*parts: Column) -> Column:
    """A number below 2^32 from the md5 of the parts: the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def jitter(date: Column, width: int, *parts: Column) -> Column:
    """The date moved by up to ``width`` days either way, by hash."""
    return F.date_add(date, (F.pmod(hash_number(*parts), F.lit(2 * width + 1)) - width).cast("int"))


def idf(n: Column, df: Column, anchor: int = 5) -> Column:
    """Anchor weight of a referent in ``df`` of ``n`` documents: 1 up to ``anchor`` documents. 1 as well where the corpus
    is no larger than ``anchor``."""
    return F.least(F.lit(1.0), F.try_divide(F.ln(n / df), F.ln(n / F.lit(float(anchor)))))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def wilson(k: Column, n: Column, clamp: bool = False, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval of k out of n; null without cases."""
    p = k / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low, high = mid - half, mid + half
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return F.when(n > 0, low), F.when(n > 0, high)


def density(nodes: Column, edges: Column) -> Column:
    return F.try_divide(2 * edges, nodes * (nodes - 1))


def pairs_of(n: Column) -> Column:
    """How many pairs n things form."""
    return n * (n - 1) / 2
