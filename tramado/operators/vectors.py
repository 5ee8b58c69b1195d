"""Neighbours by cosine within a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S


def window_neighbours(queries: DataFrame, all_: DataFrame, key: str, vector: str, when: str, width: int, k: int) -> DataFrame:
    """``(key, vecino, coseno)``: for each query the ``k`` rows of highest positive cosine at most ``width`` apart in the
    integer ``when``, itself left out; ties by key. Rows are bucketed by ``width``; a query goes to its own bucket and
    both beside it, so the join is on equal buckets and each pair within the window meets once."""
    unit = S.unit(F.col(vector))
    q = queries.select(F.col(key), F.col(when).alias("t"), unit.alias("v"), F.explode(F.sequence(F.floor(F.col(when) / width) - 1, F.floor(F.col(when) / width) + 1)).alias("bucket"))
    r = all_.select(F.col(key).alias("vecino"), F.col(when).alias("u"), unit.alias("x"), F.floor(F.col(when) / width).alias("bucket"))
    j = q.join(r, "bucket").where((F.col(key) != F.col("vecino")) & (F.abs(F.col("t") - F.col("u")) <= width))
    s = j.select(key, "vecino", S.dot(F.col("v"), F.col("x")).alias("coseno")).where("coseno > 0")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("coseno"), "vecino"))
    return s.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def undirected(neighbours: DataFrame, key: str) -> DataFrame:
    """Directed neighbours as edges ``(a, b, w)``, one per pair."""
    a, b = F.col(key).cast("string"), F.col("vecino").cast("string")
    return neighbours.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max("coseno").alias("w"))
