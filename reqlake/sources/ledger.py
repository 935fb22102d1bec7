"""Fetching as an append-only ledger of attempts, merged when it is read.

A run writes what it tried into a folder of its own, so a run that is repeated after a failure replaces only itself.  Pages
that failed are listed and passed over; the next run tries them again.  A page that has landed is not fetched again unless
the run refreshes it, and a refresh that fails leaves the page as it was: the latest success counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, error string, body string, run long"
Fetcher = Callable[[DataFrame], DataFrame]


class Ledger:
    """Attempts (key, error, body, run) below ``path``; an attempt without an error is a success."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._append(spark.createDataFrame([], SCHEMA).drop("run"), 0)  # an empty run, so that a new ledger can be read

    def _append(self, attempts: DataFrame, run: int) -> None:
        attempts.select("key", "error", "body").write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def attempts(self, before: int | None = None) -> DataFrame:
        """All attempts, or those of earlier runs only; other runs' folders are not read then."""
        every = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)
        return every if before is None else every.where(F.col("run") < before)

    def pending(self, wanted: DataFrame, refresh: Column | None = None, before: int | None = None) -> DataFrame:
        """Rows of ``wanted`` (key and more) without a success, and those that ``refresh`` reopens; bodies are not read.

        Null keys are never wanted; a key that is wanted several times is pending once.
        """
        wanted = wanted.where("key is not null").dropDuplicates(["key"])
        done = self.attempts(before).where("error is null").select("key").distinct().withColumn("done", F.lit(True))
        again = F.lit(False) if refresh is None else F.coalesce(refresh, F.lit(False))
        return wanted.join(done, "key", "left").where(F.col("done").isNull() | again).drop("done")

    def run(self, number: int, wanted: DataFrame, fetcher: Fetcher, refresh: Column | None = None) -> None:
        """Fetches what is pending: ``fetcher`` gives (key, error, body) for its rows, a null error where it succeeded.

        What is pending follows from the runs before, so that a repeated run tries the same pages as the first time.
        """
        if number < 1:
            raise ValueError("runs are numbered from 1")
        self._append(fetcher(self.pending(wanted, refresh, number)), number)

    def landed(self) -> DataFrame:
        """key, run, body of each key's latest success; bodies take no part in finding it."""
        good = self.attempts().where("error is null")
        latest = good.groupBy("key").agg(F.max("run").alias("run"))
        return good.join(latest, ["key", "run"]).select("key", "run", "body")

    def states(self) -> DataFrame:
        """key, status (landed or failed), run (of the latest success), attempts, failures, last_error."""
        ok = F.col("error").isNull()
        states = self.attempts().groupBy("key").agg(
            F.max(F.when(ok, F.col("run"))).alias("run"), F.count("*").alias("attempts"), F.count_if(~ok).alias("failures"), F.max_by("error", F.when(~ok, F.col("run"))).alias("last_error")
        )
        return states.select("key", F.when(F.col("run").isNull(), "failed").otherwise("landed").alias("status"), "run", "attempts", "failures", "last_error")
