"""The whole job: full replicate counts, no list or link skipped."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tramado.config import DEFAULT
from tramado.operators import temporal as X
from tramado.plans import threads as T
from tramado.plans import topology as G


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Dated documents of three sources over two years, ten tight threads and ten spread ones."""
    rng, d = random.Random(3), tmp_path_factory.mktemp("corpus")
    day = lambda k: str(dt.date(2020, 1, 1) + dt.timedelta(days=k))
    when = {f"x{i:04d}": rng.randrange(731) for i in range(900)}
    links = []
    for t in range(20):
        start = rng.randrange(300)
        for j in range(6):
            when[f"h{t:02d}-{j}"] = start + j if t < 10 else rng.randrange(731)
            if j:
                links.append((f"h{t:02d}-{j - 1}", f"h{t:02d}-{j}", 30, 0.9, 0.9, 0.9))
    text = ("titulo", "llm_project_name", "llm_demandant_actor_name", "llm_demanded_actor_name", "llm_main_conflict_place_name", "geo_comuna", "geo_region")
    rows = [(i, day(k), "abc"[n % 3], "2024-01-01", *[None] * len(text)) for n, (i, k) in enumerate(sorted(when.items()))]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("id", "fecha_iso", "fuente", "cargado_en", *text)))
    docs.write.parquet(f"{d}/f0_referent_coverage.parquet")
    spark.createDataFrame(links, "doc_i string, doc_j string, dias int, s_ref double, s_emb double, w double").write.parquet(f"{d}/f2b_idf_v2_l2_edges.parquet")
    return str(d)


def test_nulls_draw_the_configured_replicates_and_find_a_signal(spark, corpus):
    got = T.null_permuted(spark, corpus).collect()
    assert {r.sorteos for r in got} == {DEFAULT.replicates} and min(r.p_rafaga for r in got) <= 0.005
    one = T.null_significant(spark, corpus).first()
    assert one.hilos == 20 and 9 <= one.rafaga <= 12 and 9 <= one.corto <= 12 and one.sin_senal <= 0.55
    assert {r.sorteos for r in T.null_pseudo(spark, corpus).collect()} == {DEFAULT.replicates}
    assert {r.rep for r in T.stability_jitter(spark, corpus).collect()} == set(range(1, 21))


def test_every_document_gets_every_date(spark):
    """Over many replicates a document of a stratum gets each of its dates about as often; each replicate is a permutation."""
    df = spark.createDataFrame([(f"{i:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), "s") for i in range(12)], "doc_id string, fecha date, s string")
    got = X.permuted_dates(df, df, ["s"], 400, 3).groupBy("doc_id", "fecha").count().collect()
    assert len(got) == 144 and all(12 <= r["count"] <= 65 for r in got)
    one = X.permuted_dates(df, df, ["s"], 400, 3).groupBy("rep").agg(F.count_distinct("fecha").alias("k")).select("k").distinct().collect()
    assert [r.k for r in one] == [12]


def test_graph_of_neighbours_links_all_vectors(spark, tmp_path):
    """Two groups of vectors, none with an id divisible by a hundred."""
    rows = [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, -1.0], f"l{i % 3}") for i in range(1, 31)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.docs for r in G.emb_graph(spark, str(tmp_path)).collect()) == [15, 15]
    assert G.sample_unlike_neighbours(spark, str(tmp_path)).count() == 25
