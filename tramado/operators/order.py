"""Ranks and running totals over a whole table without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import Scratch


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Column ``name``: the sum of ``value`` up to and with each row in the order given, which must have no ties.

    Rows are split by ranges of the order and written once, so that the ranges are fixed; the sums of the ranges, one
    row each, are added up, and each range adds its own rows to what comes before it.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumn("_v", value)
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    x = Scratch(df.sparkSession, "ranges").write(keyed.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = x.groupBy("_p").agg(F.sum("_v").alias("s")).select("_p", before.alias("_b"))
    upto = F.sum("_v").over(W.partitionBy("_p").orderBy(*keys)) + F.col("_b")
    return x.join(base, "_p").withColumn(name, upto).select(*df.columns, name)


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Column ``name``: the place of each row, from 1."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def lowest_onwards(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Column ``name``: the lowest ``value`` of a row and all rows of the same ``keys`` after it in the order given."""
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumn("_v", value)
    cols = [F.col(f"_o{i}") for i in range(len(order))]
    x = Scratch(df.sparkSession, "ranges").write(keyed.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()))
    later = W.partitionBy(*keys).orderBy(F.desc("_p")) if keys else W.orderBy(F.desc("_p"))
    base = x.groupBy("_p", *keys).agg(F.min("_v").alias("_m"))
    base = base.select("_p", *keys, F.min("_m").over(later.rowsBetween(W.unboundedPreceding, -1)).alias("_b"))
    here = F.min("_v").over(W.partitionBy("_p", *keys).orderBy(*[c.desc() for c in cols]).rowsBetween(W.unboundedPreceding, 0))
    return x.join(base, ["_p", *keys]).withColumn(name, F.least(here, F.coalesce("_b", here))).select(*df.columns, name)


def places(df: DataFrame, keys: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """Columns ``name``, the place from 0 of each row among those of the same ``keys``, and ``size``, how many there are. A
    key may hold any part of the table: rows are split by ranges of keys and order, not by key."""
    x = ordinal(df, [*[F.col(k) for k in keys], *order], "_n")
    if not keys:
        return x.withColumns({name: F.col("_n") - 1, size: F.lit(df.count())}).drop("_n")
    first = x.groupBy(*keys).agg(F.min("_n").alias("_f"), F.count("*").alias(size))
    return x.join(first, keys).withColumn(name, F.col("_n") - F.col("_f")).drop("_n", "_f")


def primes(n: int, above: int = 1_000_000_000) -> list[int]:
    """The ``n`` first primes from ``above``."""
    out, x = [], above | 1
    while len(out) < n:
        if all(x % k for k in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


def reshuffled(place: Column, size: Column, rep: Column, salt: Column, reps: int) -> Column:
    """The place that a row of an already random order takes in replicate ``rep`` (1 to ``reps``): its place times a prime
    of the replicate, plus a number by hash, modulo ``size``. The prime is larger than any size (up to 10^9), so this is a
    permutation; as the order it starts from is random, each replicate is a uniformly random one. Replicates cost a
    multiplication per row instead of a sort."""
    prime = F.element_at(F.array(*[F.lit(p) for p in primes(reps)]), rep.cast("int"))
    return F.pmod(place * prime + salt, size)
