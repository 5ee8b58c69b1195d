"""Agreement between reviewers, precision with intervals, and outcome classes of reviewed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import wilson
from ..functions.text import plain_words

LABELS = ("mismo_proceso_especifico", "mismo_macroproceso", "relacionado_tematicamente", "no_relacionado", "indeterminado")
STRICT, BROAD = LABELS[:1], LABELS[:2]


def label(c: Column) -> Column:
    """The label a spelling stands for; null if it is none."""
    v = F.replace(plain_words(c), F.lit(" "), F.lit("_"))
    return F.when(v.isin(*LABELS), v)


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs with all labels as rows and columns, those without cases too."""
    spark = df.sparkSession
    every = spark.createDataFrame([(x,) for x in LABELS], "etiqueta string")
    got = df.groupBy(F.col(a).alias("etiqueta")).pivot(b, list(LABELS)).agg(F.count(F.lit(1)))
    return every.join(got, "etiqueta", "left").na.fill(0, list(LABELS))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: cases both labelled, share that agree, agreement expected by chance, and Cohen's kappa."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    one = x.groupBy(F.col(a).alias("k")).agg(F.count("*").alias("na"), F.count_if(F.col(a) == F.col(b)).alias("both"))
    two = x.groupBy(F.col(b).alias("k")).agg(F.count("*").alias("nb"))
    z = one.join(two, "k", "full").na.fill(0)
    n = F.sum("na")
    po, pe = F.try_divide(F.sum("both"), n), F.try_divide(F.sum(F.col("na") * F.col("nb")), n * n)
    return z.agg(n.alias("casos"), po.alias("acuerdo"), pe.alias("azar"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def rates(df: DataFrame, decision: str, groups: list[str]) -> DataFrame:
    """Strict, broad and thematic shares with intervals for the whole and by each of ``groups`` alone, in one pass over
    grouping sets: ``(grupo, valor, casos, estricto, estricto_bajo, estricto_alto, amplio, tematico)``. Undetermined
    cases don't count."""
    known = df.where(F.col(decision).isNotNull() & (F.col(decision) != "indeterminado"))
    known = known.select(F.col(decision).alias("d"), *[F.coalesce(F.col(g).cast("string"), F.lit("sin_dato")).alias(g) for g in groups])
    cells = F.explode(F.array(F.struct(F.lit("TOTAL").alias("grupo"), F.lit("TOTAL").alias("valor")), *[F.struct(F.lit(g).alias("grupo"), F.col(g).alias("valor")) for g in groups]))
    counts = known.groupBy("d", *groups).agg(F.count("*").alias("n")).select("d", "n", cells.alias("c"))
    share = lambda xs: F.sum(F.when(F.col("d").isin(*xs), F.col("n")).otherwise(0))
    x = counts.groupBy("c.grupo", "c.valor").agg(F.sum("n").alias("casos"), share(STRICT).alias("e"), share(BROAD).alias("a"), share(LABELS[:3]).alias("t"))
    low, high = wilson(F.col("e"), F.col("casos"))
    return x.select("grupo", "valor", "casos", (F.col("e") / F.col("casos")).alias("estricto"), low.alias("estricto_bajo"), high.alias("estricto_alto"), (F.col("a") / F.col("casos")).alias("amplio"), (F.col("t") / F.col("casos")).alias("tematico"))


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs of different labels with how many cases have them."""
    x = df.where(F.col(a) != F.col(b))
    return x.groupBy(F.least(a, b).alias("una"), F.greatest(a, b).alias("otra")).agg(F.count("*").alias("casos"))


def final_decision(a: Column, b: Column, arbiter: Column) -> Column:
    """The arbiter's decision, else what both say; null where they differ and nobody decided."""
    return F.coalesce(arbiter, F.when(a == b, a))


def arbitration(a: Column, b: Column, arbiter: Column) -> Column:
    """What an arbiter's decision is to both reviewers'."""
    return (
        F.when(arbiter.isNull(), F.lit(None).cast("string"))
        .when((arbiter == a) & (arbiter == b), "ambos")
        .when(arbiter == a, "primero")
        .when(arbiter == b, "segundo")
        .otherwise("ninguno")
    )


def outcome(stratum: Column, verdict: Column) -> Column:
    """Diagnosis of a reviewed pair from its stratum and verdict."""
    same, open_ = verdict == "mismo_proceso_especifico", verdict == "indeterminado"
    inside = F.when(same, "asignacion_correcta").when(open_, "indeterminado").otherwise("sobreagregacion")
    across = F.when(same, "fragmentacion_falsa").when(open_, "indeterminado").otherwise("asignacion_correcta")
    return F.when(stratum == "intra", inside).when(stratum == "inter", across).otherwise("juicio_por_documento")


def disagreement_kind(a: Column, b: Column, coarse: Column) -> Column:
    """Why two verdicts differ, by the first rule that fits: evidence, granularity, border of identity, wording."""
    near = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (
        F.when((a == "indeterminado") | (b == "indeterminado"), "evidencia_insuficiente")
        .when(coarse, "granularidad")
        .when(near("mismo_proceso_especifico", "relacionado_tematicamente"), "frontera_de_identidad")
        .when(near("relacionado_tematicamente", "no_relacionado"), "ambiguedad_textual")
        .otherwise("revision_manual")
    )
