"""Reading tables, and written intermediates in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a join: it is sorted and shuffled, never sent to the driver and broadcast.

    Spark takes a written table for as large as its compressed files' share of columns, some 30 times less than what it holds.
    """
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fixed one where that is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_CHECKPOINT_DIR


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark itself would give it, for code on the executors."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Written tables that cut lineage: a lost executor re-reads them instead of recomputing the plan.

    ``save`` writes a frame to the shared folder and returns the reread table; ``drop`` deletes one that no later
    plan reads.  What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/reqlake-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clean)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.root}/{name}")

    def _clean(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session may be gone already; the folder is then left to the cluster
            pass
