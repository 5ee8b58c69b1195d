"""Subthreads: secondary assignment by neighbours' evidence, crossings of bridges, and what the split is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ABSTAIN
from ..functions.text import packed_set, unpacked_set


def secondary(primary: DataFrame, edges: DataFrame, least: float = 0.60) -> DataFrame:
    """``(doc_id, secundarios, evidencia)``: labels of neighbours over edges of weight ``least`` or more that share an
    organisation but have another label, with the neighbours that give them. Abstaining neighbours give none; abstaining
    documents may receive some. Documents without any give no row."""
    e = edges.where(F.col("w") >= least)
    ends = e.select(F.col("a").alias("doc_id"), F.col("b").alias("via"), "w").union(e.select("b", "a", "w"))
    own = primary.select("doc_id", "subhilo", unpacked_set(F.col("organizacion")).alias("orgs"))
    other = primary.select(F.col("doc_id").alias("via"), F.col("subhilo").alias("otro"), unpacked_set(F.col("organizacion")).alias("otras"))
    j = ends.join(own, "doc_id").join(other, "via").where((F.col("otro") != ABSTAIN) & (F.col("otro") != F.col("subhilo")) & F.arrays_overlap("orgs", "otras"))
    why = F.concat_ws(":", "via", "otro")
    return j.groupBy("doc_id").agg(packed_set(F.collect_set("otro")).alias("secundarios"), packed_set(F.collect_set(why)).alias("evidencia"))


def crossings(bridges: DataFrame, primary: DataFrame) -> DataFrame:
    """Bridges with both ends' labels and whether they cross: two labels, neither an abstention."""
    p = primary.select("doc_id", "subhilo")
    j = bridges.join(p.select(F.col("doc_id").alias("a"), F.col("subhilo").alias("sub_a")), "a").join(p.select(F.col("doc_id").alias("b"), F.col("subhilo").alias("sub_b")), "b")
    cross = (F.col("sub_a") != ABSTAIN) & (F.col("sub_b") != ABSTAIN) & (F.col("sub_a") != F.col("sub_b"))
    return j.select("a", "b", "w", "sub_a", "sub_b", cross.alias("cruza"))


def split_quality(members: DataFrame) -> DataFrame:
    """Per thread, from ``(hilo, doc_id, subhilo, territorio)``: documents, share assigned, subthreads, fragmentation
    (subthreads per assigned document), and subthreads of two or more documents that span several territories."""
    known = F.col("subhilo") != ABSTAIN
    sub = members.where(known).groupBy("hilo", "subhilo").agg(F.count("*").alias("n"), F.count_distinct("territorio").alias("t"))
    wide = sub.groupBy("hilo").agg(F.count("*").alias("subhilos"), F.count_if((F.col("n") >= 2) & (F.col("t") > 1)).alias("amplios"))
    base = members.groupBy("hilo").agg(F.count("*").alias("docs"), F.count_if(known).alias("asignados"))
    x = base.join(wide, "hilo", "left").na.fill(0, ["subhilos", "amplios"])
    return x.select("hilo", "docs", (F.col("asignados") / F.col("docs")).alias("cobertura"), "subhilos", F.try_divide("subhilos", "asignados").alias("fragmentacion"), "amplios")


def pair_purity(cases: DataFrame, primary: DataFrame) -> DataFrame:
    """Of reviewed pairs ``(doc_a, doc_b, final)`` both of whose documents are assigned: how many are in one subthread,
    the share of those that are the same process, and the share of same-process pairs kept together."""
    p = primary.where(~F.col("abstuvo")).select("doc_id", "subhilo")
    j = cases.join(p.select(F.col("doc_id").alias("doc_a"), F.col("subhilo").alias("sa")), "doc_a").join(p.select(F.col("doc_id").alias("doc_b"), F.col("subhilo").alias("sb")), "doc_b")
    one, same = F.col("sa") == F.col("sb"), F.col("final") == "mismo_proceso_especifico"
    return j.agg(F.count("*").alias("pares"), F.count_if(one).alias("juntos"), F.try_divide(F.count_if(one & same), F.count_if(one)).alias("pureza"), F.try_divide(F.count_if(one & same), F.count_if(same)).alias("retencion"))
