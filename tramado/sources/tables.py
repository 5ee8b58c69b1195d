"""Readers and the shared working folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session, so that Python kernels run wherever it isn't installed. The
    archive goes to the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_tramado_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{working_folder(spark)}/package-{uuid.uuid4().hex}/tramado.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    context._tramado_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is missing on a single machine (tests) a local folder is made, once per session; on a cluster
    executors couldn't read it, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tramado.local.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tramado-")
        spark.conf.set("spark.tramado.local.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage. ``drop`` removes one as soon as it isn't needed."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{working_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
