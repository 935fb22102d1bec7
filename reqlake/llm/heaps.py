"""The k best rows of each of many queries: kept in bounded heaps inside a task, and merged between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64  #: heaps of a query meet in so many tasks first, then in one


class Heaps:
    """The k best (score, id) of every query number: larger scores first, then smaller ids, null ids last.

    New rows wait until they are as many as the heaps' own, so merging costs a few sorts of what has been offered.
    """

    PENDING = 200_000

    def __init__(self, queries: int, k: int, least: float | int):
        self.k = k
        self.bar = np.full(queries, least)  # what a row must reach to be among the best so far
        self.rows = (np.zeros(0, np.int64), np.zeros(0, self.bar.dtype), np.zeros(0, np.int64), np.zeros(0, bool))
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, nil: np.ndarray) -> None:
        """Rows that reach ``bar`` may be among the best; callers need not offer others."""
        self.pending.append((query, score, ids, nil))
        self.waiting += len(query)
        if self.waiting > max(self.PENDING, len(self.rows[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        """(query, score, id, whether the id is null) of the best rows so far."""
        query, score, ids, nil = (np.concatenate(x) for x in zip(self.rows, *self.pending))
        order = np.lexsort((ids, nil, -score, query))
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.bar[query[rank == self.k - 1]] = score[last]
        self.rows, self.pending, self.waiting = (query[rank < self.k], score[order], ids[order], nil[order]), [], 0
        return self.rows


def merged(rows: DataFrame, query: str, score: str, found: str, k: int) -> DataFrame:
    """The heaps of all tasks merged, with the rank (an int from 1) of each row: two rounds, so none meets a row of every task."""
    order = (F.desc(score), F.col(found).asc_nulls_last())
    rows = rows.withColumn("_salt", F.spark_partition_id() % SALTS)
    some = F.row_number().over(Window.partitionBy(query, "_salt").orderBy(*order))
    rows = rows.withColumn("_rank", some).where(F.col("_rank") <= k).drop("_salt", "_rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)
