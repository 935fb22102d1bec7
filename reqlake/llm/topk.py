"""Exact top-k by inner product over a vector-approximation file.

Every component is quantised to one of ``CELLS`` cells of its dimension's range; the file of cell numbers is an eighth of
the vectors.  With cell centres c and half widths w, the score of query q lies within q.c -+ sum |q| w.  The queries are
packed into blocks, and groups of blocks of a bounded size are broadcast, one group after the other, while the file stays
where it is.  A first scan, of a bounded part of the file, gives every query a kth best lower bound; the scan of the whole
file starts from it and keeps what can still reach the best k lower bounds.  Then exact vectors are read in the order of the
bounds: first the k most promising of a query, which gives an exact kth score, then the others whose upper bound reaches
it; after those the result is certain.  (The part of the first scan steers cost, never results.)
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

CELLS = 256  #: cells a dimension
SCALE = 1024
QUERY_EVERY = 100
QUERY_BLOCK = 512  #: queries compared with a run of cells at once
FILE_BLOCK = 4096  #: vectors in one block of the file
GROUP_BYTES = 32_000_000  #: of queries broadcast at once
FIRST_ROWS = 16  #: blocks of the file that the first scan reads, about


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(SCALE * x) of every component, of rows with an id and without null or non-finite components."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    return rows.where(x.isNotNull() & F.col(id_col).isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _ranges(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of every dimension (as many rows as dimensions come to the driver).

    What a short vector lacks counts as 0, so a dimension that some vector lacks has 0 in its range.
    """
    rows = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("d").collect()
    total = vectors.count()
    short = np.array([r.n < total for r in rows], bool)
    lo, hi = np.array([r.lo for r in rows], np.float64), np.array([r.hi for r in rows], np.float64)
    return np.where(short, np.minimum(lo, 0), lo), np.where(short, np.maximum(hi, 0), hi)


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix; what a short one lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _quantise(lo: np.ndarray, width: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), FILE_BLOCK):
                part = batch.slice(at, FILE_BLOCK)
                cells = np.clip((_padded(part.column(1), len(lo)) - lo) // width, 0, CELLS - 1).astype(np.uint8)
                ids, numbers = part.column(0).to_numpy(), part.column(2).to_numpy()
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (ids, cells, numbers)], ["ids", "cells", "numbers"])

    return run


def _pack(dims: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        q = np.zeros((len(pdf), dims))
        for row, v in zip(q, pdf.v):
            row[: len(v)] = v
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "q_rows": [pdf.q.to_numpy(np.int64).tobytes()], "q_ids": [pdf.id.to_numpy(np.int64).tobytes()], "vectors": [q.tobytes()]})

    return run


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row of k values or more, in rising order."""
    return np.sort(np.partition(values, -k, axis=1)[:, -k:], axis=1)


def _scan(lo: np.ndarray, width: np.ndarray, k: int, queries, bars=None) -> Callable:
    """Rows (ids, cells, rows) of the file against broadcast query blocks.

    Without ``bars``: (q, lower), the best k lower bounds of each query among what this task has seen.  With them, the kth
    best lower bounds known: (q, c, lower, upper), what can be among a query's best k of what this task has seen.
    """
    dims = len(lo)

    def run(batches):
        blocks = [(np.frombuffer(r, np.int64), np.frombuffer(i, np.int64), np.frombuffer(v, np.float64).reshape(-1, dims)) for r, i, v in queries.value]
        known = [np.full((len(rows), k), -np.inf) for rows, _, _ in blocks]  # best k lower bounds of each query so far
        start = [np.array([[bars.value.get(r, -np.inf)] for r in rows.tolist()]) for rows, _, _ in blocks] if bars is not None else None
        for batch in batches:
            for row in range(len(batch)):
                ids, cells, numbers = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in enumerate((np.int64, np.uint8, np.int64)))
                centres = lo + (cells.reshape(len(ids), dims) + 0.5) * width
                for at, (rows, q_ids, q) in enumerate(blocks):
                    middle = q @ centres.T
                    slack = np.abs(q) @ width / 2
                    slack = slack * (1 + 1e-9) + 1e-6 + np.abs(middle).max(axis=1, initial=0) * 1e-9  # floating-point error
                    middle[q_ids[:, None] == ids[None, :]] = -np.inf
                    lower, upper = middle - slack[:, None], middle + slack[:, None]
                    known[at] = _best(np.concatenate([known[at], lower], axis=1), k)
                    if bars is not None:
                        i, j = np.nonzero((upper >= np.maximum(start[at], known[at][:, :1])) & (middle > -np.inf))
                        yield pa.record_batch([pa.array(rows[i]), pa.array(numbers[j]), pa.array(lower[i, j]), pa.array(upper[i, j])], ["q", "c", "lower", "upper"])
        if bars is None:
            for best, (rows, _, _) in zip(known, blocks):
                yield pa.record_batch([pa.array(np.repeat(rows, k)), pa.array(best.reshape(-1))], ["q", "lower"])

    return run


def _score(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def exact_top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of every row whose id is divisible by ``query_every``.

    Scores are integer inner products of floor(SCALE * x); ties go to the smaller id; a query with fewer others has all.
    Vectors that are null or hold null or non-finite components, and null ids, take no part; an empty vector scores 0 and
    short ones count as 0 where they end.  Repeats of an id with its vector count once; an id of several vectors has each as
    a candidate, of all ids but its own, and as a query of its own.  Scaled components must fit 31 bits for a score to fit
    a long.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.save(integer_vectors(rows, id_col, vector_col).distinct().withColumn("n", F.monotonically_increasing_id()), "vectors")
    lo, hi = _ranges(vectors)
    width = np.maximum((hi - lo) / CELLS, 1e-9) * (1 + 1e-9)
    dims = len(lo)

    # of equal vectors only the k + 1 smallest ids can be in a result; the limit runs before the shuffle too
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = vectors.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).select("id", "v", "n")
    file = scratch.save(candidates.mapInArrow(_quantise(lo, width), "ids binary, cells binary, numbers binary"), "cells")
    blocks_of_file = file.count()
    first = scratch.save(file.where(F.pmod(F.xxhash64("ids"), F.lit(max(1, blocks_of_file // FIRST_ROWS))) == 0), "first-cells")

    queries = vectors.where(F.col("id") % query_every == 0)
    n_queries = queries.count()
    groups = max(1, -(-n_queries * max(dims, 1) * 8 // GROUP_BYTES))
    blocks = max(1, -(-n_queries // (groups * QUERY_BLOCK)))
    place = F.xxhash64("n")
    packed = queries.select("id", "v", F.col("n").alias("q"), F.pmod(place, F.lit(groups)).alias("group"), F.pmod(F.shiftright(place, 20), F.lit(blocks)).alias("block"))
    packed = packed.withColumn("block", F.col("group") * blocks + F.col("block"))
    packed = scratch.save(packed.groupBy("block").applyInPandas(_pack(dims), "block long, q_rows binary, q_ids binary, vectors binary"), "queries")
    # the stated queries against the whole file, one group of bounded size at a time
    found = []
    for group in range(groups):
        own = packed.where(f"block >= {group * blocks} and block < {(group + 1) * blocks}")
        asked = spark.sparkContext.broadcast([(bytes(r.q_rows), bytes(r.q_ids), bytes(r.vectors)) for r in own.collect()])
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))
        lowest = first.mapInArrow(_scan(lo, width, k, asked), "q long, lower double").withColumn("_rank", best).where(F.col("_rank") == k)
        bars = spark.sparkContext.broadcast({r.q: r.lower for r in lowest.select("q", "lower").collect()})
        found.append(scratch.save(file.mapInArrow(_scan(lo, width, k, asked, bars), "q long, c long, lower double, upper double"), f"bounds-{group}"))
    bounds = found[0]
    for more in found[1:]:
        bounds = bounds.union(more)

    promising = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower"), "c"))
    top = bounds.withColumn("_rank", promising).where(F.col("_rank") <= k).select("q", "c")
    ask = queries.select(F.col("n").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("vq"))

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(vectors.select(F.col("n").alias("c"), F.col("id").alias("found"), F.col("v").alias("vc")), "c").join(ask, "q")
        return read.select("q", "c", "query_id", "found", _score("vq", "vc").alias("score"))

    top = scratch.save(exact(top), "first")
    bar = top.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    rest = bounds.join(bar, "q").where("bar is null or upper >= bar").select("q", "c").join(top.select("q", "c"), ["q", "c"], "left_anti")
    scores = top.union(exact(rest))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "found", "c"))
    return scores.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth embedding."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
