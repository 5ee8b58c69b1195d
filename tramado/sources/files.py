"""Files in and out: CSV with byte order marks, JSON, whole texts, JSON inside documents, digests, and their checks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma-separated text with a header, quoted line breaks, doubled quotes and perhaps a byte order mark. The schema is
    given, so identifiers stay strings; a row that doesn't fit it fails the read."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=True)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Comma-separated text with header. Arrays and structs become JSON cells. With ``bom`` the header starts with a byte
    order mark."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])
    if bom and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON document over several lines, or one per line."""
    return spark.read.json(path, schema=schema, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def probe(spark: SparkSession, path: str, field: str, kind: str):
    """One value of a JSON summary by its path of fields (``a.b``), or null where it lacks it."""
    text = spark.read.text(path, wholetext=True)
    got = text.select(F.get_json_object("value", "$." + field).cast(kind)).first()
    return got[0] if got else None


def read_matrix(spark: SparkSession, path: str, array: str = "arr_0") -> DataFrame:
    """``(archivo, fila, v)``: the rows of a dense matrix kept in numpy archives, a file or a folder of them. A file is
    one task, so large matrices come in several."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with np.load(io.BytesIO(data), allow_pickle=False) as archive:
                    m = np.atleast_2d(archive[array]).astype(np.float32)
                for at in range(0, len(m), 10_000):
                    part = m[at : at + 10_000]
                    v = pa.ListArray.from_arrays(np.arange(0, part.size + 1, m.shape[1], dtype=np.int32), part.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(part)), pa.array(np.arange(at, at + len(part))), v], ["archivo", "fila", "v"])

    return files.mapInArrow(rows, "archivo string, fila long, v array<float>")


def write_draws(df: DataFrame, path: str, key: str, value: str) -> None:
    """Draws of a null as numpy archives, one per part of the table: in each, an array per ``key``, in order. All draws of
    a key are in one archive; the parts are written by the executors to ``path``, with a row ``(archivo, claves)`` each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = io.BytesIO()
            np.savez_compressed(out, **{k: np.asarray(v) for k, v in sorted(zip(pdf[key], pdf[value]))})
            yield pd.DataFrame({"claves": [len(pdf)], "contenido": [out.getvalue()]})

    lists = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias(value))
    lists.mapInPandas(pack, "claves int, contenido binary").write.mode("errorifexists").parquet(path)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """``(clave, valores)`` from what :func:`write_draws` wrote."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["contenido"]:
                with np.load(io.BytesIO(data), allow_pickle=False) as archive:
                    yield pd.DataFrame({"clave": archive.files, "valores": [archive[k].tolist() for k in archive.files]})

    return spark.read.parquet(path).select("contenido").mapInPandas(unpack, "clave string, valores array<double>")


def dump(df: DataFrame, path: str | None) -> DataFrame:
    """The table as it is; where a path is given, written there too and read back, so that it is computed once."""
    if not path:
        return df
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lock(flags: dict[str, object], locked: dict[str, object]) -> None:
    """Raise unless every flag of a locked experiment has the value it was locked with, and there is no other flag."""
    wrong = {k: (locked.get(k), flags.get(k)) for k in sorted({*flags, *locked}) if k not in flags or k not in locked or flags[k] != locked[k]}
    if wrong:
        raise ValueError(f"flags differ from the locked ones (locked, given): {wrong}")


def read_texts(spark: SparkSession, path: str, page_mark: str | None = None) -> DataFrame:
    """One row ``value`` per file; page marks become line breaks."""
    t = spark.read.text(path, wholetext=True)
    return t.withColumn("value", F.regexp_replace("value", page_mark, "\n")) if page_mark else t


def embedded_json(text: Column, schema: str) -> Column:
    """The JSON between the first and the last brace of a text; null if it can't be read."""
    return F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), schema)


def keyed_objects(text: Column, value: str) -> Column:
    """A JSON object of objects as an array of entries ``(key, value)``."""
    return F.map_entries(F.from_json(text, f"map<string,{value}>"))


def blocks(text: Column, anchor: str, context: int = 0) -> Column:
    """The parts of a text that an anchor opens, in order, each with up to ``context`` characters from before it."""
    parts = F.split(text, f"\\Q{anchor}\\E", -1)
    tail = lambda p: F.substring(p, F.greatest(F.length(p) - context + 1, F.lit(1)), context) if context else F.lit("")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.concat(tail(F.get(parts, i)), F.lit(anchor), p))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(archivo, bytes, sha256)`` of every file under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("archivo"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest ``(archivo, esperado)`` against digests found: ``igual``, ``distinto`` or ``falta``. An expected value
    may carry text after its 64 digits."""
    j = manifest.join(found, "archivo", "left")
    state = F.when(F.col("sha256").isNull(), "falta").when(F.col("sha256") == F.substring("esperado", 1, 64), "igual").otherwise("distinto")
    return j.select("archivo", state.alias("estado"))


def assert_frozen(found: DataFrame, manifest: DataFrame) -> None:
    """Raise unless every file of the manifest is there unchanged."""
    bad = verify(found, manifest).where("estado <> 'igual'").limit(20).collect()
    if bad:
        raise ValueError("changed or missing: " + ", ".join(f"{r['archivo']} ({r['estado']})" for r in bad))


def assert_counts(df: DataFrame, expected: dict[str, int]) -> None:
    """Raise unless aggregates, given as SQL expressions, have the expected values."""
    got = df.agg(*[F.expr(e).alias(str(i)) for i, e in enumerate(expected)]).first()
    wrong = {e: got[i] for i, e in enumerate(expected) if got[i] != expected[e]}
    if wrong:
        raise ValueError(f"expected {expected}, got {wrong}")


def seal(df: DataFrame, *order: str) -> DataFrame:
    """One row: how many rows, and a digest over their digests that doesn't depend on partitioning. Row digests are
    combined by key range, so no task holds them all."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("sello"))


def only_allowed(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The table, or an error if it has columns that a blind sheet may not show."""
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns that give answers away: {extra}")
    return df


def report(rows: list[dict], title: str) -> str:
    """A small result as a Markdown table."""
    if not rows:
        return f"# {title}\n\n(sin filas)\n"
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows]]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"
