"""Sampling that any engine and partitioning repeats: rows are ordered by the md5 of seed, replicate and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import hash_number
from ..sources.tables import Scratch
from .order import places, reshuffled, running_total


def ticket(seed: int | str, *ids: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def simple(df: DataFrame, k: int, seed: int, *ids: str) -> DataFrame:
    """``k`` rows, or all if there are fewer."""
    return df.withColumn("_t", ticket(seed, *ids)).orderBy("_t", *ids).limit(k).drop("_t")


def ranked(df: DataFrame, key: str, seed: int, *ids: str) -> DataFrame:
    """Column ``k``: the place from 1 of each row among those of its ``key``, in random order. Rows are split by ranges, so a
    key may have any number of them."""
    x = places(df, [key], [ticket(seed, *ids), *[F.col(i) for i in ids]], "k", "_m")
    return x.withColumn("k", F.col("k") + 1).drop("_m")


def stratified(df: DataFrame, stratum: str, k: int | Column, seed: int, *ids: str) -> DataFrame:
    """``k`` rows of each stratum. The rank filter is applied before the shuffle too, so a large stratum moves k rows a
    task."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(ticket(seed, *ids), *ids))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def numbered(df: DataFrame, prefix: str, digits: int, seed: int, *ids: str) -> DataFrame:
    """A sample in random order with running ids: the sheet that hides where items come from. For samples, not tables:
    numbering is one sequence."""
    rank = F.row_number().over(W.orderBy(ticket(seed, *ids), *ids))
    return df.withColumn("item_id", F.format_string(f"{prefix}%0{digits}d", rank))


def quintiles(df: DataFrame, value: str) -> DataFrame:
    """Column ``quintil`` 1 to 5: how many of the four cut points a value reaches, a cut being the value at place
    floor(n k / 5). Equal values are in one quintile. Places come from counts of equal values."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    places = running_total(n, [F.col(value)], F.col("c"), "hi")
    total = places.agg(F.sum("c")).first()[0] or 0
    cuts = places.agg(*[F.min(F.when(F.col("hi") > total * k // 5, F.col(value))).alias(str(k)) for k in (1, 2, 3, 4)]).first()
    q = F.lit(1)
    for c in cuts:
        q = q + F.when(F.col(value) >= F.lit(c), 1).otherwise(0)
    return df.withColumn("quintil", F.when(F.col(value).isNotNull(), q))


def drop_share(df: DataFrame, percent: int, replicates: int, seed: int, *ids: str) -> DataFrame:
    """``rep`` copies of the table, each without about ``percent`` in a hundred rows, chosen by hash."""
    reps = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep"), *ids)), 1, 8), 16, 10).cast("long")
    return reps.where(F.pmod(number, F.lit(100)) >= percent)


def donors(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Permutations of ``key``: ``(rep, key, donante)``. Rows are put into two random orders once; a row's donor in a
    replicate is the one at its reshuffled place in the other order."""
    scratch = Scratch(df.sparkSession, "orders")
    mine = scratch.write(places(df.select(key), [], [ticket(f"{seed}a", key), F.col(key)], "k", "n"))
    other = scratch.write(places(df.select(F.col(key).alias("donante")), [], [ticket(f"{seed}b", "donante"), F.col("donante")], "k", "n").drop("n"))
    reps = mine.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.withColumn("k", reshuffled(F.col("k"), F.col("n"), F.col("rep"), hash_number(F.lit(seed), F.col("rep")), replicates))
    return reps.join(other, "k").select("rep", key, "donante")


def bootstrap_difference(df: DataFrame, group: str, value: str, draws: int, seed: int) -> DataFrame:
    """Mean difference between both groups with its 95 % bounds. A row's weight in a draw is Poisson by hash, so draws
    need no resampling across tasks; only sums per draw are shuffled."""
    reps = df.where(F.col(value).isNotNull()).select(group, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep"), F.col("_id") if "_id" in df.columns else F.monotonically_increasing_id().alias("_id"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k
    s = reps.groupBy("rep", group).agg(F.sum(weight * F.col(value)).alias("s"), F.sum(weight).alias("n"))
    mean = lambda g: F.max(F.when(F.col(group) == g, F.col("s") / F.col("n")))
    d = s.groupBy("rep").agg((mean(True) - mean(False)).alias("d"))
    return d.agg(F.avg("d").alias("diferencia"), F.percentile("d", F.lit(0.025)).alias("bajo"), F.percentile("d", F.lit(0.975)).alias("alto"))
