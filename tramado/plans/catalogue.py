"""All queries of the library's core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evidence, packed, review, stream, threads, topology


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return threads.thread_flagship(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**packed.QUERIES, **corpus.QUERIES, **threads.QUERIES, **review.QUERIES, **topology.QUERIES, **evidence.QUERIES, **stream.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**corpus.ORACLE, **threads.ORACLE, **review.ORACLE, **topology.ORACLE, **evidence.ORACLE, **stream.ORACLE}
