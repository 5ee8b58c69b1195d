"""The queries of this subpackage, by name; each takes (spark, folder). ``oracle_sql`` has SQL for those that allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import explode_packed
from ..sources.tables import Scratch, table
from .canonical import UNLISTED, known, map_to_catalogue
from .components import connected_groups
from .consensus import consensus
from .leakage import leaked_items
from .mixing import mix, quality, token_counts
from .names import entities, variant_pairs
from .neardup import similar_documents, similar_groups
from .sentences import split_sentences


# Abbreviations of works and stages that aren't their words' beginnings or initials, and numerals.
WORKS = {
    "tqe": "tranque", "pto": "puerto", "tx": "transmision", "pta": "planta", "nte": "norte", "et": "etapa", "f": "fase", "eolica": "eolico", "minera": "minero",
    "i": "1", "1a": "1", "1o": "1", "1ª": "1", "1º": "1", "uno": "1", "una": "1", "primera": "1",
    "ii": "2", "2a": "2", "2o": "2", "2ª": "2", "2º": "2", "dos": "2", "segunda": "2",
    "iii": "3", "3a": "3", "3o": "3", "3ª": "3", "3º": "3", "tres": "3", "tercera": "3",
    "iv": "4", "4a": "4", "4o": "4", "4ª": "4", "4º": "4", "cuatro": "4", "cuarta": "4",
}


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_subhilo_assignment").select(
        "doc_id", F.explode(F.create_map(F.lit("objeto_original"), F.col("objeto_original"), F.lit("subhilo_primario"), F.col("subhilo_primario"))).alias("campo", "valor")
    ).where(known(F.col("valor"))).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each typed project or label with the catalogue entry it means, or reported as unlisted."""
    rows = _typed(spark, d)
    meant = map_to_catalogue(rows, "valor", table(spark, d, "subhilo_catalogo"), "subhilo_id", "nombre", "otro_nombre", WORKS)
    return rows.join(meant, "valor").select("doc_id", "campo", "subhilo_id").distinct()


def p1_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean several entries alike, with those entries."""
    x = map_to_catalogue(_typed(spark, d), "valor", table(spark, d, "subhilo_catalogo"), "subhilo_id", "nombre", "otro_nombre", WORKS, ambiguous=True)
    return x.select("valor", F.array_join("entries", ";").alias("subhilos"))


def p1_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """How many documents name something, by field and whether it is listed."""
    found = p1_found(spark, d)
    listed = (F.col("subhilo_id") != UNLISTED).alias("en_catalogo")
    return found.groupBy("campo", listed).agg(F.count_distinct("doc_id").alias("docs"))


LABELS = ("mismo_proceso_especifico", "mismo_macroproceso", "relacionado_tematicamente", "no_relacionado", "indeterminado")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """All decisions on pair cases: each decision column and each annotator is one annotator."""
    cases = table(spark, d, "intermediate_merged_cases")
    columns = [c for c in cases.columns if c.startswith("decision_")]
    wide = cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(c).alias("annotator_id"), F.col(c).alias("decision")) for c in columns])).alias("x"))
    wide = wide.select("case_id", "x.annotator_id", "x.decision", F.lit(None).cast("timestamp").alias("decidido_en"))
    return wide.union(table(spark, d, "case_labels").select("case_id", "annotator_id", "decision", "decidido_en"))


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus(_decisions(spark, d), "case_id", "annotator_id", "decision", "decidido_en", LABELS, "indeterminado")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus label of each pair case."""
    return _consensus(spark, d)[0].select("case_id", "etiqueta")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each pair case with its label, the label's probability and the share of decisions that agree."""
    return _consensus(spark, d)[0]


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Each annotator with a reliability estimate."""
    return _consensus(spark, d)[1]


def _names(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "f0_referent_coverage").select(F.col("llm_demandant_actor_name").alias("nombre"))
    packed = explode_packed(table(spark, d, "h0000_02_node_metrics"), "doc_id", "actores").select(F.col("valor").alias("nombre"))
    return typed.union(packed)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of people and organisations that name the same one."""
    return variant_pairs(_names(spark, d), "nombre")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the person or organisation it names."""
    return entities(_names(spark, d), "nombre").select(F.col("name").alias("nombre"), F.col("entity").alias("entidad"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document of the accepted links with its group."""
    return connected_groups(table(spark, d, "f2b_idf_v2_l2_edges"), "doc_i", "doc_j")


def p5_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, d).groupBy("grupo_id").agg(F.count("*").alias("docs"))
    return sizes.groupBy("docs").agg(F.count("*").alias("grupos"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that are lightly edited copies of one another."""
    return similar_documents(table(spark, d, "h0000_diagnostics"), "doc_id", "contenido_completo")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each article."""
    return similar_groups(table(spark, d, "h0000_diagnostics"), "doc_id", "contenido_completo").withColumnRenamed("doc", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that carry test items, and which."""
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("peso", quality(F.col("text")))
    counted = token_counts(docs, "doc_id", "text", ["source", "peso"])
    counted = Scratch(spark, "mixing").write(counted)  # each text is tokenized once
    return mix(counted, "doc_id", "source", "peso", "tokens", table(spark, d, "source_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, with their copies."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_ambiguous, p1_unlisted, p3_found, p3_agreement, p3_annotators, p4_found, p4_entities, p5_found, p5_group_sizes, p6_found, p6_groups,
        p7_found, p8_mix, p8_shares, p9_found,
    )
}

_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT nullif(regexp_replace(doc_i, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'), '') AS a,
    nullif(regexp_replace(doc_j, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'), '') AS b FROM f2b_idf_v2_l2_edges),
s AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT a AS doc_id FROM e WHERE a IS NOT NULL UNION SELECT b FROM e WHERE b IS NOT NULL),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.doc_id WHERE r.m < s.b)
"""

ORACLE: dict[str, str] = {
    "p5_found": _GROUPS + "SELECT doc_id, min(m) AS grupo_id FROM r GROUP BY doc_id",
    "p5_group_sizes": _GROUPS
    + ", g AS (SELECT doc_id, min(m) AS grupo_id FROM r GROUP BY doc_id), c AS (SELECT grupo_id, count(*) AS docs FROM g GROUP BY 1)"
    " SELECT docs, count(*) AS grupos FROM c GROUP BY docs",
}
