"""Candidate pairs by shared referents, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ThreadConfig
from ..functions import scalars as S


def frequencies(refs: DataFrame, dated: Column | int, config: ThreadConfig = DEFAULT) -> DataFrame:
    """Document frequency of each referent, whether it is a hub, and its anchor weight, from ``dated`` documents."""
    n = F.lit(dated).cast("double") if isinstance(dated, int) else dated
    df = refs.groupBy("tipo", "referente").agg(F.count_distinct("doc_id").alias("df"))
    return df.withColumns({"hub": F.col("df") > config.hub_df, "idf": S.idf(n, F.col("df"), config.idf_anchor)})


def scored_pairs(refs: DataFrame, freq: DataFrame, config: ThreadConfig = DEFAULT, vectors: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """``(doc_i, doc_j, dias, s_ref, s_emb, w)``, doc_i < doc_j, for dated documents 1 to ``far_days`` apart that share
    a referent that is no hub.

    A hub forms no pairs, so the self-join emits at most ``hub_df`` rows per row; it still counts in the score. Dates
    are checked inside the join, before pairs are made distinct. Beyond ``near_days``, ``s_ref`` must reach
    ``strong_ref``. Referents of a kind count by the sum of their anchor weights, up to one, or with ``plain`` by their
    share of all of both documents. Vectors (doc_id, v) are fetched only for pairs that passed. Without vectors, w is s_ref.
    """
    r = refs.where("fecha is not null").join(freq.select("tipo", "referente", "hub", "idf"), ["tipo", "referente"])
    a = r.where("not hub").select("tipo", "referente", F.col("doc_id").alias("doc_i"), F.col("fecha").alias("fi"))
    b = r.where("not hub").select("tipo", "referente", F.col("doc_id").alias("doc_j"), F.col("fecha").alias("fj"))
    gap = F.abs(F.datediff("fi", "fj"))
    pairs = a.join(b, ["tipo", "referente"]).where((F.col("doc_i") < F.col("doc_j")) & gap.between(1, config.far_days))
    pairs = pairs.select("doc_i", "doc_j", gap.alias("dias")).distinct()
    left = pairs.join(r.select(F.col("doc_id").alias("doc_i"), "tipo", "referente", "idf"), "doc_i")
    shared = left.join(r.select(F.col("doc_id").alias("doc_j"), "tipo", "referente"), ["doc_j", "tipo", "referente"])
    if plain:
        own = r.groupBy("doc_id").agg(*[F.count_if(F.col("tipo") == k).alias(k) for k, _ in config.kind_weights])
        n = shared.groupBy("doc_i", "doc_j", "dias").agg(*[F.count_if(F.col("tipo") == k).alias("m_" + k) for k, _ in config.kind_weights])
        for side in ("doc_i", "doc_j"):
            n = n.join(own.select(F.col("doc_id").alias(side), *[F.col(k).alias(f"{side}_{k}") for k, _ in config.kind_weights]), side)
        part = [F.coalesce(F.try_divide(F.col("m_" + k), F.col(f"doc_i_{k}") + F.col(f"doc_j_{k}") - F.col("m_" + k)), F.lit(0.0)) * w for k, w in config.kind_weights]
        scored = n.select("doc_i", "doc_j", "dias", sum(part[1:], part[0]).alias("s_ref"))
        return _weighted(scored, config, vectors)
    by_kind = [F.least(F.lit(1.0), F.sum(F.when(F.col("tipo") == k, F.col("idf")).otherwise(0.0))) * w for k, w in config.kind_weights]
    scored = shared.groupBy("doc_i", "doc_j", "dias").agg(sum(by_kind[1:], by_kind[0]).alias("s_ref"))
    return _weighted(scored, config, vectors)


def _weighted(scored: DataFrame, config: ThreadConfig, vectors: DataFrame | None) -> DataFrame:
    scored = scored.where((F.col("s_ref") > 0) & ~((F.col("dias") > config.near_days) & (F.col("s_ref") < config.strong_ref)))
    if vectors is None:
        return scored.withColumns({"s_emb": F.lit(None).cast("double"), "w": F.col("s_ref")})
    v = vectors.select("doc_id", S.unit(F.col("v")).alias("v"))
    scored = scored.join(v.select(F.col("doc_id").alias("doc_i"), F.col("v").alias("vi")), "doc_i").join(v.select(F.col("doc_id").alias("doc_j"), F.col("v").alias("vj")), "doc_j")
    scored = scored.withColumn("s_emb", S.dot(F.col("vi"), F.col("vj"))).drop("vi", "vj")
    return scored.withColumn("w", config.alpha * F.col("s_ref") + config.beta * F.col("s_emb"))


def accepted(tau: Column, tier: str = "L2", config: ThreadConfig = DEFAULT) -> Column:
    """Whether a scored pair is an edge. Near pairs need w >= tau; far pairs a strong shared referent and, by tier: L1
    nothing else, whatever w; L2 also w >= tau; L3 that and an even stronger referent."""
    strong = F.col("s_ref") >= (config.strictest_ref if tier == "L3" else config.strong_ref)
    heavy = (F.col("w") >= tau) & ((F.col("dias") <= config.near_days) | strong)
    return heavy | ((F.col("dias") > config.near_days) & strong) if tier == "L1" else heavy


def clean_edges(rows: DataFrame) -> DataFrame:
    """Accepted links as edges: ``(a, b, dias, s_ref, s_emb, w)``, a < b, one row per pair with its best values.
    Self-pairs and pairs lacking a side are left out, blanks around ids don't count."""
    trim = lambda c: F.nullif(F.regexp_replace(c, "^\\s+|\\s+$", ""), F.lit(""))
    e = rows.select(trim("doc_i").alias("x"), trim("doc_j").alias("y"), "dias", "s_ref", "s_emb", "w").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("dias").alias("dias"), F.max("s_ref").alias("s_ref"), F.max("s_emb").alias("s_emb"), F.max("w").alias("w"))
