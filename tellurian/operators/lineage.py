"""Cutting lineage with tables in the shared folder.

A cut table is written once as Parquet below ``spark.checkpoint.dir`` and read
back: what stands behind it is computed once, however often it is read, and a
lost executor costs a re-read.  Tables stay until :func:`release` drops them,
since results that read them are lazy.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset one of its own in local mode, elsewhere an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", "") or getattr(spark, "_tellurian_cuts_folder", "")
    if not folder:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tellurian-")
        spark._tellurian_cuts_folder = folder
    return folder.rstrip("/")


def reserve(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which :func:`release` will know."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    spark._tellurian_cuts = [*getattr(spark, "_tellurian_cuts", []), path]
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table."""
    spark = df.sparkSession
    path = reserve(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all reserved and cut tables; results that read them must have been written."""
    for path in getattr(spark, "_tellurian_cuts", []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    spark._tellurian_cuts = []
