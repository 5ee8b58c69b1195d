import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramado.sources import files as S
from tramado.sources.tables import Scratch
from tramado.streaming import windows as W


def test_csv_with_mark_and_breaks(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('﻿id,texto\n007,"a ""b""\nc"\n008,\n', "utf-8")
    got = [tuple(r) for r in S.read_csv(spark, str(f), "id string, texto string").collect()]
    assert got == [("007", 'a "b"\nc'), ("008", None)]
    S.write_csv(spark.createDataFrame([("1", ["a"])], "id string, l array<string>"), str(tmp_path / "out"), bom=True)
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.csv"))
    assert text.startswith("﻿id") and '["a"]' in text.replace('""', '"')


def test_json(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"grid": [{"tau": 0.35}, {"tau": 0.45}]}, indent=1))
    assert S.read_json(spark, str(tmp_path / "x.json")).select(F.explode("grid.tau")).count() == 2
    df = spark.createDataFrame([('antes {"a": 3} después',), ("nada",)], "t string")
    assert [r[0] and r[0]["a"] for r in df.select(S.embedded_json(F.col("t"), "a int")).collect()] == [3, None]
    k = spark.createDataFrame([('{"E1": {"w": 1.5}, "E2": {"w": 2.0}}',)], "t string").select(F.explode(S.keyed_objects(F.col("t"), "struct<w:double>"))).collect()
    assert [(r[0]["key"], r[0]["value"]["w"]) for r in k] == [("E1", 1.5), ("E2", 2.0)]
    S.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_texts_and_blocks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("uno\fCASO dos\fCASO tres")
    t = S.read_texts(spark, str(tmp_path / "t.txt"), "\f")
    assert t.first()[0] == "uno\nCASO dos\nCASO tres"
    assert t.select(S.blocks(F.col("value"), "CASO", 4)).first()[0] == ["uno\nCASO dos\n", "dos\nCASO tres"]


def test_digests_and_checks(spark, tmp_path, rows):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("x")
    found = S.digests(spark, str(tmp_path / "d"))
    good = hashlib.sha256(b"x").hexdigest()
    m = spark.createDataFrame([("a.txt", good + " v1"), ("b.txt", good)], "archivo string, esperado string")
    assert rows(S.verify(found, m)) == [("a.txt", "igual"), ("b.txt", "falta")]
    S.assert_frozen(found, m.limit(1))
    with pytest.raises(ValueError):
        S.assert_frozen(found, m)
    S.assert_counts(found, {"count(*)": 1})
    with pytest.raises(ValueError):
        S.assert_counts(found, {"count(*)": 2})
    with pytest.raises(ValueError):
        S.only_allowed(found, ("archivo",))


def test_matrix_draws_probe_dump_and_lock(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "m.npz", m)
    got = {r.fila: list(r.v) for r in S.read_matrix(spark, str(tmp_path / "m.npz")).collect()}
    assert got == {i: m[i].tolist() for i in range(4)}
    df = spark.createDataFrame([("h1", 2.0), ("h0", 5.0), ("h1", 1.0)], "hilo string, x double")
    S.write_draws(df, str(tmp_path / "draws"), "hilo", "x")
    assert {r.clave: list(r.valores) for r in S.read_draws(spark, str(tmp_path / "draws")).collect()} == {"h0": [5.0], "h1": [1.0, 2.0]}
    S.write_draws(df.limit(0), str(tmp_path / "none"), "hilo", "x")
    assert S.read_draws(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"chosen": {"tau": 0.45}}))
    assert S.probe(spark, str(tmp_path / "s.json"), "chosen.tau", "double") == 0.45 and S.probe(spark, str(tmp_path / "s.json"), "chosen.x", "double") is None
    assert S.dump(df, None) is df and S.dump(df, str(tmp_path / "dump")).count() == 3 and (tmp_path / "dump").exists()
    S.lock({"tier": "L2"}, {"tier": "L2"})
    for flags in ({"tier": "L1"}, {}, {"tier": "L2", "more": 1}):
        with pytest.raises(ValueError):
            S.lock(flags, {"tier": "L2"})


def test_seal_is_order_free(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert S.seal(df).first() == S.seal(df.repartition(5).select("b", "a")).first()
    assert S.seal(df).first() != S.seal(df.limit(49)).first() and S.seal(df.limit(0)).first().filas == 0


def test_report():
    assert S.report([{"a": 1}], "T").endswith("| a |\n|---|\n| 1 |\n") and "sin filas" in S.report([], "T")


def test_scratch_drops_its_tables(spark):
    s = Scratch(spark, "t")
    df = s.write(spark.range(3))
    assert df.count() == 3
    s.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._scratch_path).count()


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 05:00:00"), (1, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "u int, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = W.tumbling(stream, "ts", "1 hour", "1 hour", "u").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sorted(map(str, W.tumbling(df, "ts", "1 hour", "1 hour", "u").collect()))
    assert sorted(map(str, spark.table("tumbling").collect())) == batch and len(batch) == 3
    assert sorted(r.n for r in W.sessions(df, "ts", "1 hour", "1 hour", "u").collect()) == [1, 1, 2]
    q = W.first_sightings(stream, "ts", "1 day", "u").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.u for r in spark.table("firsts").collect()) == [1, 2]
