"""Pigeonhole join: pairs of strings within k edits, by equality of positional substrings.

A reference string is cut into k+1 segments. At most k edits leave one segment untouched, so a string within k edits
holds it, shifted by no more than the edits before it. With i-1 edits at most before segment i and k+1-i after it,
the shift d of segment i obeys |d| <= i-1 and |d - (difference in length)| <= k+1-i. The probing side emits just these
substrings for every length of reference within k of its own; an equality join finds candidates; levenshtein verifies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (0-based) and length of segment ``i`` (0-based) of a string of ``length`` cut into k+1 even segments."""
    n = F.lit(k + 1)
    start = F.floor(i * length / n).cast("int")
    end = F.floor((i + 1) * length / n).cast("int")
    return start, end - start


def segments(df: DataFrame, text: str, k: int) -> DataFrame:
    """The index side: ``df`` with columns ``seg_n`` (length of the whole), ``seg_i`` and ``seg`` added, a row per
    segment. Texts must be longer than k."""
    i = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("seg_i")
    x = df.select("*", F.length(text).alias("seg_n"), i)
    start, size = _bounds(F.col("seg_n"), F.col("seg_i"), k)
    return x.withColumn("seg", F.substring(F.col(text), start + 1, size))


def probes(df: DataFrame, text: str, k: int, shifts: tuple[int, int] | None = None) -> DataFrame:
    """The probing side: a row per substring that a reference within k edits may share, same three columns added.
    ``shifts`` bounds the difference in length, reference less probe, where more is known of it than k."""
    low, high = shifts or (-k, k)
    x = df.select("*", F.length(text).alias("_len"))
    x = x.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_d")).withColumn("seg_n", F.col("_len") + F.col("_d"))
    x = x.where(F.col("seg_n") > k).select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("seg_i"))
    lo = F.greatest(-F.col("seg_i"), -F.col("_d") - (k - F.col("seg_i")))
    hi = F.least(F.col("seg_i"), -F.col("_d") + (k - F.col("seg_i")))
    x = x.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("_s"))
    start, size = _bounds(F.col("seg_n"), F.col("seg_i"), k)
    at = start + F.col("_s")
    x = x.withColumn("_at", at).withColumn("_size", size).where("_at >= 0 AND _at + _size <= _len")
    x = x.withColumn("seg", F.substring(F.col(text), F.col("_at") + 1, F.col("_size")))
    return x.drop("_len", "_d", "_s", "_at", "_size")


def within_edits(left: DataFrame, ltext: str, right: DataFrame, rtext: str, k: int) -> DataFrame:
    """Distinct pairs ``(ltext, rtext, edits)`` of the distinct strings of both sides within ``k`` edits.

    Strings of the right not longer than k take part in no pair. Nulls take part in none. Skewed segments are spread by
    adaptive execution; where the right side is small by its statistics, Spark broadcasts it.
    """
    a = left.select(F.col(ltext)).where(F.col(ltext).isNotNull()).distinct()
    b = right.select(F.col(rtext)).where(F.length(rtext) > k).distinct()
    j = probes(a, ltext, k).join(segments(b, rtext, k), ["seg_n", "seg_i", "seg"])
    edits = F.levenshtein(F.col(ltext), F.col(rtext), k)
    return j.select(ltext, rtext, edits.alias("edits")).where("edits >= 0").distinct()
