"""The corpus: one row per document, its referents, and the aliases that merge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import ABSTAIN
from ..functions import scalars as S
from ..functions import text as T


def latest(rows: DataFrame) -> DataFrame:
    """One row per ``id``: the one loaded last; among equals, the first by digest of its main columns."""
    tie = F.md5(F.concat_ws("|", "fecha_iso", "titulo", "llm_project_name", "llm_demandant_actor_name"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("cargado_en"), tie))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def referents(docs: DataFrame) -> DataFrame:
    """Long table of referents: ``(doc_id, fecha, tipo, referente)``, a row per (document, kind, key), both actors as
    one kind. Documents without any referent give no row."""
    place = F.coalesce(*[T.base_key(F.col(c)) for c in ("llm_main_conflict_place_name", "geo_comuna", "geo_region")])
    kinds = [
        ("objeto", T.base_key(F.col("llm_project_name"))),
        ("territorio", place),
        ("actor", T.base_key(F.col("llm_demandant_actor_name"))),
        ("actor", T.base_key(F.col("llm_demanded_actor_name"))),
    ]
    long = docs.select(F.col("id").alias("doc_id"), S.day(F.col("fecha_iso")).alias("fecha"), F.explode(F.array(*[F.struct(F.lit(k).alias("tipo"), v.alias("referente")) for k, v in kinds])).alias("x"))
    return long.select("doc_id", "fecha", "x.tipo", "x.referente").where("referente is not null").distinct()


def acronym_forms(refs: DataFrame) -> DataFrame:
    """Keys like ``name (acr)`` with how many documents carry them and whether name and acronym may merge: ``aceptado``,
    ``generico`` or ``iniciales_no_coinciden``."""
    name, acr = T.acronym_form(F.col("referente"))
    x = refs.withColumns({"nombre": name, "sigla": acr}).where("nombre is not null")
    x = x.groupBy("tipo", "referente", "nombre", "sigla").agg(F.count_distinct("doc_id").alias("docs"))
    reason = F.when(F.col("nombre").isin(*T.GENERIC_NAMES), "generico").when(~T.initials_match(F.col("nombre"), F.col("sigla")), "iniciales_no_coinciden").otherwise("aceptado")
    return x.withColumn("motivo", reason)


def aliases(forms: DataFrame) -> DataFrame:
    """``(tipo, alias, canonico)`` from accepted forms. An acronym belongs to the first full form by key; where another
    form claims it for another name, the acronym alone is no alias."""
    ok = forms.where("motivo = 'aceptado'")
    w = W.partitionBy("tipo", "sigla")
    claims = ok.withColumn("nombres", F.size(F.collect_set("nombre").over(w)))
    full = ok.select("tipo", F.col("referente").alias("alias"), F.col("nombre").alias("canonico"))
    short = claims.where("nombres = 1").select("tipo", F.col("sigla").alias("alias"), F.col("nombre").alias("canonico"))
    return full.union(short).distinct()


def apply_aliases(refs: DataFrame, alias: DataFrame) -> DataFrame:
    a = alias.withColumnRenamed("alias", "referente")
    return refs.join(a, ["tipo", "referente"], "left").select("doc_id", "fecha", "tipo", F.coalesce("canonico", "referente").alias("referente")).distinct()


def records(docs: DataFrame) -> DataFrame:
    """Five general categories of a document: installation, territory, organisations, procedure and phase."""
    # Keys first, each once; what combines them comes in a second step.
    keys = {"p": "llm_project_name", "l": "llm_main_conflict_place_name", "c": "geo_comuna", "v": "geo_provincia", "r": "geo_region", "x": "llm_demandant_actor_name", "y": "llm_demanded_actor_name", "a": "llm_contentious_action_type"}
    x = docs.select(
        F.col("id").alias("doc_id"),
        T.strip(F.coalesce("llm_main_conflict_place_type", F.lit(""))).alias("t"),
        F.nullif(F.substring("fecha_iso", 1, 10), F.lit("")).alias("d"),
        *[T.base_key(F.col(c)).alias(k) for k, c in keys.items()],
    )
    x = x.withColumn("familia", T.family_of(F.col("a")))
    return x.select(
        "doc_id",
        F.coalesce("p", F.when(F.col("t").isin(*T.FACILITIES), F.col("l"))).alias("proyecto"),
        F.coalesce("l", "c", "v", "r").alias("territorio"),
        T.packed_set(F.filter(F.array("x", "y"), lambda v: v.isNotNull())).alias("organizacion"),
        F.col("a").alias("procedimiento"),
        "familia",
        F.concat_ws("::", "familia", F.coalesce(F.substring("d", 1, 7), F.lit("sin_fecha"))).alias("fase"),
    )


def coverage(docs: DataFrame) -> DataFrame:
    """How many documents have each kind of referent, none, one, two or three of them, and shares in percent."""
    has = {
        "objeto": T.base_key(F.col("llm_project_name")).isNotNull(),
        "territorio": F.coalesce(*[T.base_key(F.col(c)) for c in ("llm_main_conflict_place_name", "geo_comuna", "geo_region")]).isNotNull(),
        "actor": F.coalesce(T.base_key(F.col("llm_demandant_actor_name")), T.base_key(F.col("llm_demanded_actor_name"))).isNotNull(),
    }
    n = sum(v.cast("int") for v in has.values())
    one = F.count("*")
    return docs.agg(
        one.alias("docs"),
        F.count_if(S.day(F.col("fecha_iso")).isNotNull()).alias("fechados"),
        *[F.count_if(v).alias(k) for k, v in has.items()],
        F.count_if(n >= 1).alias("al_menos_1"),
        F.count_if(n >= 2).alias("al_menos_2"),
        F.count_if(n == 3).alias("los_3"),
        F.round(F.try_divide(100 * F.count_if(n >= 1), one), 4).alias("pct_al_menos_1"),
        (F.try_divide(F.count_if(n >= 1), one) >= 0.7).alias("pasa"),
    )


def primary(recs: DataFrame) -> DataFrame:
    """Subthread of each document: its installation, or abstention."""
    return recs.select("doc_id", F.coalesce("proyecto", F.lit(ABSTAIN)).alias("subhilo"), F.col("proyecto").isNull().alias("abstuvo"), "organizacion", "territorio")
