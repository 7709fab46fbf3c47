"""Shared-folder tables: how the operators cut lineage and survive lost executors.

Every intermediate result that is read more than once is written as Parquet
below ``spark.checkpoint.dir``, which the driver and all executors share, and
read back from there.  A lost executor then costs a re-read, not a recompute,
and a non-deterministic step (task numbering, sampling) is fixed once.

A table stays until :func:`release` drops it, since the result that was built on
it is lazy: call it once the result is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are taken from an Arrow batch in slices of so many bytes: this bounds a
#: Python worker's memory by bytes, as Spark's own ``arrow.maxBytesPerBatch``
#: (64 MB) bounds the batch itself.  A longer text is a slice of its own.
TEXT_SLICE_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a folder of its own in local mode; elsewhere an error,
    since executors would not see the driver's folders.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", "") or getattr(spark, "_tellurian_shared", "")
    if not root:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tellurian-shared-")
        spark._tellurian_shared = root
    return root.rstrip("/")


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_tellurian_tables"):
        spark._tellurian_tables = []
    return spark._tellurian_tables


def reserve(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which :func:`release` will know."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = reserve(spark, label)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tellurian_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes one materialised table, which nothing may read any more."""
    _delete(table.sparkSession, table._tellurian_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written(spark).remove(path)


def mark(spark: SparkSession) -> int:
    """How many tables stand now; see :func:`release`."""
    return len(_written(spark))


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since that mark, but for ``keep``; results that read them must have been written."""
    kept = getattr(keep, "_tellurian_path", None)
    for path in [p for p in _written(spark)[since:] if p != kept]:
        _delete(spark, path)


def text_slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = TEXT_SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in ``column`` have about ``most`` bytes together; none is empty."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        # A text goes where it begins, so that a slice ends with the text that fills it.
        slot = (np.cumsum(sizes) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield b.slice(lo, hi - lo)
