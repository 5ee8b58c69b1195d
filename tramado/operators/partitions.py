"""How alike two groupings of the same documents are, from their contingency table; pairs are counted, never listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pairs_of


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for two groupings ``(doc_id, grupo)`` over their common documents: documents, groups, pairs together in
    each and in both, Jaccard of pairs, adjusted Rand index, normalised mutual information (arithmetic mean), variation
    of information, and pair retention of the left grouping. Measures without pairs or information are null."""
    cell = left.select("doc_id", F.col("grupo").alias("x")).join(right.select("doc_id", F.col("grupo").alias("y")), "doc_id")
    cell = cell.groupBy("x", "y").agg(F.count("*").alias("n"))
    sums = lambda df: df.agg(F.sum("n").alias("n"), F.sum(pairs_of(F.col("n"))).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("h"), F.count("*").alias("k"))
    parts = {"a": sums(cell.groupBy("x").agg(F.sum("n").alias("n"))), "b": sums(cell.groupBy("y").agg(F.sum("n").alias("n"))), "ab": sums(cell)}
    rows = [df.withColumn("de", F.lit(k)) for k, df in parts.items()]
    pick = lambda c, k: F.max(F.when(F.col("de") == k, F.col(c))).alias(c + k)
    x = rows[0].union(rows[1]).union(rows[2]).agg(F.max("n").alias("n"), *[pick(c, k) for c in "phk" for k in parts])
    n = F.col("n")
    entropy = lambda h: F.ln(n) - F.col(h) / n
    e1, e2, e12 = entropy("ha"), entropy("hb"), entropy("hab")
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs_of(n))
    return x.select(
        n.alias("docs"), F.col("ka").alias("grupos_a"), F.col("kb").alias("grupos_b"), F.col("pa").alias("pares_a"), F.col("pb").alias("pares_b"), F.col("pab").alias("pares_ambos"),
        F.try_divide(F.col("pab"), F.col("pa") + F.col("pb") - F.col("pab")).alias("jaccard"),
        F.try_divide(F.col("pab") - expected, (F.col("pa") + F.col("pb")) / 2 - expected).alias("ari"),
        F.try_divide(e1 + e2 - e12, (e1 + e2) / 2).alias("nmi"),
        (2 * e12 - e1 - e2).alias("vi"),
        F.try_divide(F.col("pab"), F.col("pa")).alias("retencion"),
    )


def recall_by_group(base: DataFrame, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of each base group's pairs that ``other`` (with ``keys``, such as a replicate) keeps together."""
    keys = keys or []
    size = base.groupBy("grupo").agg(F.count("*").alias("n"))
    j = base.join(other.select(*keys, "doc_id", F.col("grupo").alias("y")), "doc_id").groupBy(*keys, "grupo", "y").agg(F.count("*").alias("m"))
    kept = j.groupBy(*keys, "grupo").agg(F.sum(pairs_of(F.col("m"))).alias("kept"))
    return kept.join(size, "grupo").select(*keys, "grupo", F.try_divide("kept", pairs_of(F.col("n"))).alias("recuperado"))


def recovery(gold: DataFrame, groups: DataFrame, part: float = 0.1) -> DataFrame:
    """For each gold case ``(caso, doc_id)`` against groups ``(doc_id, grupo)``: documents, share grouped at all, share in
    the group that holds most (recall), that group's share from the case (purity), and groups with at least ``part`` of
    the case's documents."""
    size = groups.groupBy("grupo").agg(F.count("*").alias("tam"))
    case = gold.groupBy("caso").agg(F.count("*").alias("docs"))
    j = gold.join(groups, "doc_id").groupBy("caso", "grupo").agg(F.count("*").alias("n")).join(size, "grupo").join(case, "caso")
    best = F.max_by(F.struct("n", "tam"), F.struct(F.col("n"), -F.col("tam")))
    agg = j.groupBy("caso").agg(F.sum("n").alias("en"), best.alias("b"), F.count_if(F.col("n") >= part * F.col("docs")).alias("fragmentos"))
    x = case.join(agg, "caso", "left")
    return x.select("caso", "docs", (F.coalesce("en", F.lit(0)) / F.col("docs")).alias("cobertura"), F.coalesce(F.col("b.n") / F.col("docs"), F.lit(0.0)).alias("recuperado"), (F.col("b.n") / F.col("b.tam")).alias("pureza"), F.coalesce("fragmentos", F.lit(0)).alias("fragmentos"))
