"""Threads: components of accepted edges, numbered, measured, profiled, and compared between configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions import text as T
from .order import ordinal


def numbered(comps: DataFrame) -> DataFrame:
    """Components with a thread id: larger first, then by smallest document."""
    size = comps.groupBy("comp").agg(F.count("*").alias("n"))
    name = ordinal(size, [-F.col("n"), F.col("comp")], "r").select("comp", "n", T.padded_id("H", 4, F.col("r") - 1).alias("hilo"))
    return comps.join(name, "comp").select("doc_id", "comp", "hilo", "n")


def grid_summary(edges: DataFrame, comps: DataFrame, docs: int | Column, near_days: int = 365, least: int = 3, cap: float = 0.3) -> DataFrame:
    """A row per ``tau``: edges, far edges, threads, threads of at least ``least``, their median size, share of documents
    in them, share in the largest, and whether the largest is within ``cap``."""
    e = edges.groupBy("tau").agg(F.count("*").alias("aristas"), F.count_if(F.col("dias") > near_days).alias("largas"))
    size = comps.groupBy("tau", "comp").agg(F.count("*").alias("n"))
    big = F.col("n") >= least
    n = F.lit(docs) if isinstance(docs, int) else docs
    t = size.groupBy("tau").agg(
        F.count("*").alias("hilos"),
        F.count_if(big).alias("hilos_3"),
        F.median(F.when(big, F.col("n"))).alias("mediana_3"),
        F.try_divide(F.sum(F.when(big, F.col("n"))), n).alias("cobertura_3"),
        F.try_divide(F.max("n"), n).alias("gigante"),
    )
    return e.join(t, "tau").withColumn("cabe", F.col("gigante") <= cap)


def chosen_tau(grid: DataFrame) -> DataFrame:
    """The smallest tau whose largest thread is within the cap, else the largest tau."""
    return grid.agg(F.coalesce(F.min(F.when(F.col("cabe"), F.col("tau"))), F.max("tau")).alias("tau"))


def profiles(threads: DataFrame, refs: DataFrame, top: int = 3) -> DataFrame:
    """A row per thread: size, first and last date, span in years, and the ``top`` referents of each kind with the
    number of documents (ties by key)."""
    base = threads.join(refs.select("doc_id", "fecha").distinct(), "doc_id", "left")
    base = base.groupBy("hilo").agg(F.count_distinct("doc_id").alias("docs"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))
    counts = threads.join(refs, "doc_id").groupBy("hilo", "tipo", "referente").agg(F.count_distinct("doc_id").alias("n"))
    rank = F.row_number().over(W.partitionBy("hilo", "tipo").orderBy(F.desc("n"), "referente"))
    best = counts.withColumn("r", rank).where(F.col("r") <= top)
    lists = best.groupBy("hilo").agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tipo") == k, F.struct("r", "referente", "n")))), lambda x: F.concat(x["referente"], F.lit(" ("), x["n"], F.lit(")"))), "; ").alias(k)
        for k in ("objeto", "territorio", "actor")
    ])
    return base.join(lists, "hilo", "left").withColumn("anios", S.span_years(F.col("desde"), F.col("hasta")))


def within(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Edges both ends of which are in one group, with the group."""
    a = members.select(F.col("doc_id").alias("a"), F.col(group))
    b = members.select(F.col("doc_id").alias("b"), F.col(group).alias("_g"))
    return edges.join(a, "a").join(b, "b").where(F.col(group) == F.col("_g")).drop("_g")


def far_share(edges: DataFrame, threads: DataFrame, near_days: int = 365) -> DataFrame:
    """Edges of each thread and the share of those that span more than ``near_days``."""
    e = within(edges, threads.select("doc_id", "hilo"), "hilo")
    far = F.count_if(F.col("dias") > near_days)
    return e.groupBy("hilo").agg(F.count("*").alias("aristas"), far.alias("largas"), (far / F.count("*")).alias("parte_larga"))


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each thread of ``left`` the thread of ``right`` (both doc_id, hilo) that holds most of its documents."""
    j = left.join(right.select("doc_id", F.col("hilo").alias("otro")), "doc_id", "left").groupBy("hilo", "otro").agg(F.count("*").alias("n"))
    size = F.sum("n").over(W.partitionBy("hilo"))
    rank = F.row_number().over(W.partitionBy("hilo").orderBy(F.col("otro").isNull(), F.desc("n"), "otro"))
    return j.withColumns({"docs": size, "r": rank}).where("r = 1").select("hilo", "docs", "otro", F.when(F.col("otro").isNotNull(), F.col("n")).otherwise(0).alias("comunes"))
