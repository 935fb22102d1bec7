"""Shared pieces of the training-data operators: reading tables, shipping this package, Arrow helpers."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from reqlake import storage

__all__ = ["Scratch", "slices", "table", "text_bytes"]


class Scratch(storage.Scratch):
    """Written tables of plans whose shuffles are as large as their input: those shuffle files should not outlive the plan."""

    def save(self, df: DataFrame, name: str) -> DataFrame:
        saved = super().save(df, name)
        # Spark deletes shuffle files once the driver's garbage collector has found their plan unused
        if hasattr(self.spark, "_jvm"):
            self.spark._jvm.System.gc()
        return saved


@functools.cache
def _ship(context: SparkContext) -> None:
    """Sends this package to the Python workers once a context, so that it need not be installed on the executors."""
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "reqlake.zip"  # on the driver; Spark's file server hands it out
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _ship(spark.sparkContext)
    return storage.table(spark, sf_dir, name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one uint8 array, and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most_bytes`` (one row at least)."""
    if not len(batch):
        return
    sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(text)))[1])
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)
