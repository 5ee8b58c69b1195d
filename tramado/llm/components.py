"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

Every component selects its smallest outgoing edge, the trees of selected edges collapse by pointer doubling, edges are
relabelled and deduplicated, until none remain. Components at least halve in every round.

With the edge order (smaller end, larger end), a tree's only two-cycle lies on its smallest edge, whose smaller end is
the smallest label in the tree: the tree's root. So after every round a component is named by its smallest member, and
no pass for the smallest identifier follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch


def clean_id(c: Column) -> Column:
    """Blanks around an identifier removed; an empty one is missing."""
    return F.nullif(F.regexp_replace(c.cast("string"), "^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+$", ""), F.lit(""))


def _collapse(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling: ``(node, up)`` until every ``up`` is a root. Depth d takes about log2 d / 2 writes."""
    now = scratch.write(parents)
    while True:
        once = now.alias("a").join(now.alias("b"), F.col("a.up") == F.col("b.node"), "left")
        step = once.select(F.col("a.node").alias("node"), F.col("a.up").alias("old"), F.coalesce("b.up", "a.up").alias("up"))
        twice = step.alias("a").join(now.alias("b"), F.col("a.up") == F.col("b.node"), "left")
        moved = scratch.write(
            twice.select(F.col("a.node").alias("node"), F.col("a.old").alias("old"), F.coalesce("b.up", "a.up").alias("up"))
        )
        more = not moved.where(F.col("old") != F.col("up")).isEmpty()
        scratch.drop(now)
        now = moved
        if not more:
            return now.select("node", "up")


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row ``(doc_id, grupo_id)`` per identifier in either column; ``grupo_id`` is the smallest identifier, by code
    point, among all joined directly or through others.

    A pair with both sides is a link. Self-pairs, repeated rows, either order and pairs lacking a side add no link; a
    side alone still names a document, which is then its own group. Blanks around identifiers don't count; empty ones
    are missing. An empty table gives an empty result. Columns other than the two are not read.

    A hub's edges are reduced map-side when it selects its smallest edge; relabelling joins edges with a table that is
    unique on its key, so a hot key can be split without changing the result, which adaptive execution does. Nothing but
    a flag reaches the driver.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    e = pairs.select(clean_id(F.col(left)).alias("a"), clean_id(F.col(right)).alias("b"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null").distinct()
    linked = e.where("a is not null and b is not null and a <> b")
    edges = scratch.write(linked.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("node"), F.struct("u", "v").alias("edge")),
                    F.struct(F.col("v").alias("node"), F.struct("u", "v").alias("edge")),
                )
            ).alias("x")
        )
        least = ends.groupBy(F.col("x.node").alias("node")).agg(F.min("x.edge").alias("edge"))
        other = F.when(F.col("node") == F.col("edge.u"), F.col("edge.v")).otherwise(F.col("edge.u"))
        picks = scratch.write(least.select("node", other.alias("to"), "edge"))
        # The two ends of a tree's smallest edge select each other: the smaller one becomes the root.
        mutual = picks.alias("p").join(
            picks.select(F.col("node").alias("m"), F.col("edge").alias("medge")),
            (F.col("p.to") == F.col("m")) & (F.col("p.edge") == F.col("medge")) & (F.col("p.node") < F.col("m")),
            "left",
        )
        parents = mutual.select("node", F.when(F.col("m").isNotNull(), F.col("node")).otherwise(F.col("to")).alias("up"))
        tree = _collapse(parents, scratch)
        scratch.drop(picks)
        levels.append(tree)
        u = tree.select(F.col("node").alias("u"), F.col("up").alias("ru"))
        v = tree.select(F.col("node").alias("v"), F.col("up").alias("rv"))
        again = edges.join(u, "u").join(v, "v").where("ru <> rv")
        merged = scratch.write(again.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        scratch.drop(edges)
        edges = merged
    # From the last round, which has the fewest components, back to the first.
    total: DataFrame | None = None
    for tree in reversed(levels):
        if total is not None:
            tree = tree.join(total.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select(
                "node", F.coalesce("top", "up").alias("up")
            )
        total = tree
    if total is None:
        return nodes.select("doc_id", F.col("doc_id").alias("grupo_id"))
    return nodes.join(total.select(F.col("node").alias("doc_id"), "up"), "doc_id", "left").select(
        "doc_id", F.coalesce("up", "doc_id").alias("grupo_id")
    )
