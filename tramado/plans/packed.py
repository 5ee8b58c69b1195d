"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import explode_packed
from ..sources.tables import table

FIELDS = (("h0000_02_node_metrics", "actores"), ("node_subhilo_assignment", "subhilo_secundario"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of each packed field, with its place."""
    parts = [
        explode_packed(table(spark, d, t), "doc_id", c).select(F.lit(t).alias("tabla"), "doc_id", "posicion", "valor")
        for t, c in FIELDS
    ]
    return parts[0].union(parts[1]).distinct()


QUERIES = {"p2_found": p2_found}
