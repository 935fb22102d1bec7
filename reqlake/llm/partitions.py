"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts.  A small classifier learns which part a vector belongs
to, and every row is indexed by it; another learns in which parts a vector's neighbours are indexed, and routes queries.  A
query is compared exactly with all rows of its most probable parts, as many as held enough neighbours of sample rows that
were kept out of the fit.  Parts are read once for each broadcast group of the queries that probe them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .heaps import Heaps, merged

QUERY_EVERY = 50
SAMPLE_ROWS = 8192  #: vectors that the partitions are learned from, at most
SAMPLE_BYTES = 64_000_000
ROWS_PER_PART = 128  #: rows a part at least
MOST_PARTS = 64
NEIGHBOURS = 10  #: edges of a vector in the graph
RECALL = 0.95  #: part of the kept-out rows' neighbours that the probed parts must hold
HELD_OUT = 8  #: one in so many sample rows is kept out of the fit
HIDDEN = 128
EPOCHS = 15
FILE_BLOCK = 4096  #: vectors in one block of the index
QUERY_BLOCK = 512
GROUP_BYTES = 32_000_000  #: of queries broadcast at once
SLACK = 1e-9  #: more than matrix products err


def _nearest(x: np.ndarray, of: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Rows of unit vectors ``of`` nearest to each row of ``x``; with ``own``, x is of and a row is not its own neighbour."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ of.T
        if own:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 10) -> np.ndarray:
    """A part of each row, of sizes within a tenth of each other, with few edges of the graph between parts.

    Halving along principal axes gives equal parts; rows then move to the part of most of their neighbours, largest gain
    first, while no part grows or shrinks beyond a tenth.
    """
    part = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        whole, part = part, part.copy()
        for p in range(whole.max() + 1):
            own = np.flatnonzero(whole == p)
            centred = x[own] - x[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            half = np.argsort(np.argsort(centred @ axis, kind="stable")) >= len(own) // 2
            part[own] = 2 * p + half
    a, b = np.repeat(np.arange(len(x)), neighbours.shape[1]), neighbours.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    least, most = int(0.9 * len(x) / parts), int(np.ceil(1.1 * len(x) / parts))
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
    return part


class Router:
    """One hidden layer from unit vectors to the logits of the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        sizes = (x.shape[1], HIDDEN, target.shape[1])
        self.weights = [w for a, b in zip(sizes, sizes[1:]) for w in (rng.normal(0, np.sqrt(2 / a), (a, b)).astype(np.float32), np.zeros(b, np.float32))]
        self.weights[0] *= np.float32(np.sqrt(x.shape[1]))  # components of unit vectors are small
        mean, square, step = [0 * w for w in self.weights], [0 * w for w in self.weights], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                step += 1
                hidden = np.maximum(x[rows] @ self.weights[0] + self.weights[1], 0)
                slope = self._softmax(hidden @ self.weights[2] + self.weights[3]) - target[rows]
                slope /= len(rows)
                below = (slope @ self.weights[2].T) * (hidden > 0)
                for w, m, s, g in zip(self.weights, mean, square, (x[rows].T @ below, below.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= np.float32(0.003) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + np.float32(1e-8))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3]


class Partitions:
    """The parts of a sample of unit vectors: where rows are indexed, and which parts a query probes."""

    def __init__(self, sample: np.ndarray, parts: int):
        x = sample.astype(np.float32)
        held = np.arange(len(x)) % HELD_OUT == 0
        fit, out = x[~held], x[held]
        rows = np.arange(len(fit))
        neighbours = _nearest(fit, fit, min(NEIGHBOURS, len(fit) - 1), True)
        own = np.zeros((len(fit), parts), np.float32)
        own[rows, balanced_parts(fit, neighbours, parts)] = 1
        self.placing = Router(fit, own)
        logits, self.bias = self.placing.logits(fit), np.zeros(parts, np.float32)
        for _ in range(200):  # what the classifier sends to a part is balanced too
            size = np.bincount((logits + self.bias).argmax(axis=1), minlength=parts)
            self.bias -= 0.1 * np.log((size + 1) / (len(fit) / parts + 1)).astype(np.float32)
        placed = self.place(fit)
        near = np.zeros((len(fit), parts), np.float32)
        np.add.at(near, (np.repeat(rows, neighbours.shape[1]), placed[neighbours].ravel()), 1 / neighbours.shape[1])
        self.routing = Router(fit, near)
        found = placed[_nearest(out, fit, min(5, len(fit)), False)]
        turn = np.take_along_axis(self.order(out).argsort(axis=1), found, axis=1)  # how far down a row's order its neighbours are
        share = np.cumsum(np.bincount(turn.ravel(), minlength=parts)) / turn.size
        self.probes = min(parts, int(np.searchsorted(share, RECALL)) + 1)

    def place(self, x: np.ndarray) -> np.ndarray:
        return (self.placing.logits(x) + self.bias).argmax(axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts, most probable first, for each row."""
        return np.argsort(-self.routing.logits(x), axis=1, kind="stable")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix of doubles; what a short one lacks is 0."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b: sums over components first to last, so equal rows give equal doubles."""
    product, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        product += a[:, d] * b[:, d]
        left += a[:, d] * a[:, d]
        right += b[:, d] * b[:, d]
    return product / (np.sqrt(left) * np.sqrt(right))


def _placed(model, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            part = model.value.place(_unit(x)) if model and len(x) else np.zeros(len(x), np.int64)
            yield pa.record_batch([pa.array(part.astype(np.int32)), batch.column(0), batch.column(1)], ["part", "id", "v"])

    return run


def _blocked(dims: int) -> Callable:
    """Rows (part, id, v) in order of their parts to blocks of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                for at in range(lo, hi, FILE_BLOCK):
                    own = slice(at, min(at + FILE_BLOCK, hi))
                    x = _matrix(batch.column(2).slice(at, own.stop - at), dims)
                    yield pa.record_batch([pa.array(part[at : at + 1]), pa.array([ids[own].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["part", "ids", "vectors"])

    return run


def _routed(model, dims: int, probes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            parts = model.value.order(_unit(x))[:, :probes] if model and len(x) else np.zeros((len(x), 1), np.int64)
            at = pa.array(np.repeat(np.arange(len(x)), parts.shape[1]))
            yield pa.record_batch([pa.array(parts.ravel().astype(np.int32)), *(batch.column(c).take(at) for c in range(3))], ["part", "q", "id", "v"])

    return run


def _packed(dims: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        x = np.zeros((len(pdf), dims))
        for row, v in zip(x, pdf.v):
            row[: len(v)] = v
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "block": [pdf.block.iloc[0]], "q": [pdf.q.to_numpy(np.int64).tobytes()], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})

    return run


def _searched(asked, dims: int, k: int) -> Callable:
    """Blocks of the index to (q, found, score): the best k of each query among the rows of this task in the parts it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        numbers = np.unique(np.concatenate([np.frombuffer(q, np.int64) for _, q, _, _ in asked.value]))
        for part, q, ids, vectors in asked.value:
            v = np.frombuffer(vectors, np.float64).reshape(-1, dims)
            blocks.setdefault(part, []).append((np.searchsorted(numbers, np.frombuffer(q, np.int64)), np.frombuffer(ids, np.int64), v, _unit(v)))
        heaps = Heaps(len(numbers), k, -np.inf)
        for batch in batches:
            for row in range(len(batch)):
                own = blocks.get(batch.column(0)[row].as_py(), ())
                ids = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                x = np.frombuffer(batch.column(2)[row].as_py(), np.float64).reshape(-1, dims)
                unit = _unit(x) if own else x
                for q, q_ids, v, q_unit in own:
                    s = q_unit @ unit.T
                    s[q_ids[:, None] == ids] = -np.inf
                    bar = heaps.bar[q]
                    if len(ids) > k:
                        bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
                    i, j = np.nonzero((s >= bar[:, None] - SLACK) & (s > -np.inf))
                    heaps.offer(q[i], cosine(v[i], x[j]), ids[j], np.zeros(len(i), bool))
        q, score, found, _ = heaps.merge()
        yield pa.record_batch([pa.array(numbers[q]), pa.array(found), pa.array(score)], ["q", "found", "score"])

    return run


def _search(index: DataFrame, queries: DataFrame, model, dims: int, probes: int, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(q, rank, found, score): the best k of each query (q, id, v) in its ``probes`` most probable parts."""
    spark = index.sparkSession
    routed = scratch.save(queries.select("q", "id", "v").mapInArrow(_routed(model, dims, probes), f"part int, q long, id long, v {queries.schema['v'].dataType.simpleString()}"), f"routed-{name}")
    counts = {r.part: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, -(-n // QUERY_BLOCK)))) if counts else F.create_map()
    packed = routed.withColumn("block", F.pmod(F.xxhash64("q"), blocks[F.col("part")]).cast("int") if counts else F.lit(0))
    packed = scratch.save(packed.groupBy("part", "block").applyInPandas(_packed(dims), "part int, block int, q binary, ids binary, vectors binary"), f"packed-{name}")
    sizes = packed.select("part", "block", F.octet_length("vectors").alias("size")).orderBy("part", "block").collect()
    groups, held = [], 0
    for r in sizes:
        if not groups or held + r.size > GROUP_BYTES:
            groups, held = [*groups, []], 0
        groups[-1].append((r.part, r.block))
        held += r.size
    found = []
    for turn, group in enumerate(groups):
        place, lo, hi = F.struct("part", "block"), *(F.struct(F.lit(p), F.lit(b)) for p, b in (group[0], group[-1]))
        asked = spark.sparkContext.broadcast([(r.part, bytes(r.q), bytes(r.ids), bytes(r.vectors)) for r in packed.where((place >= lo) & (place <= hi)).collect()])
        parts = index.where(F.col("part").between(group[0][0], group[-1][0]))
        found.append(scratch.save(parts.mapInArrow(_searched(asked, dims, k), "q long, found long, score double"), f"found-{name}-{turn}"))
    out = found[0] if found else spark.createDataFrame([], "q long, found long, score double")
    for more in found[1:]:
        out = out.union(more)
    return scratch.save(merged(out, "q", "score", "found", k), f"best-{name}")


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found other rows of every row whose id is divisible by ``query_every``.

    Nearness is the cosine in doubles, the score exactly that; ties go to the smaller id.  The index is learned from a random
    sample of at most SAMPLE_ROWS vectors (and SAMPLE_BYTES) and holds every row.  Vectors that are null, zero or hold null or
    non-finite components (or whose squared norm is no finite double), and null ids, take no part; short vectors count as 0
    where they end.  Repeats of an id with its vector count once; an id of several vectors has each as a candidate of all ids
    but its own, and as a query of its own.  A query that finds fewer than k rows in the parts probed reads them all, so with
    k others or more each has k rows, with fewer all of them.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    x = F.col(vector_col)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    norm = F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    vectors = rows.where(x.isNotNull() & F.col(id_col).isNotNull()).where(sound).where((norm > 0) & (norm < float("inf")))
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).distinct().withColumn("q", F.monotonically_increasing_id())
    vectors = scratch.save(vectors, "vectors")
    kind = vectors.schema["v"].dataType.simpleString()
    # of equal vectors only the k + 1 smallest ids can be in a result; the limit runs before the shuffle too
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = scratch.save(vectors.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).select("id", "v", (F.col("_rank") == 1).alias("first")), "candidates")
    total, dims = candidates.agg(F.count_if("first"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")

    size = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims))
    parts = min(MOST_PARTS, 1 << max(0, int(min(total, size) // ROWS_PER_PART).bit_length() - 1))
    model, probes = None, 1
    if parts > 1:
        drawn = candidates.where("first").where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.lit(int(950_000 * size / total))).select("v").limit(size)
        sample = _matrix(pa.chunked_array([b.column(0) for b in drawn.toArrow().to_batches()]).combine_chunks(), dims)
        learned = Partitions(_unit(sample), parts)
        model, probes = spark.sparkContext.broadcast(learned), learned.probes
    placed = candidates.select("id", "v").mapInArrow(_placed(model, dims), f"part int, id long, v {kind}")
    index = scratch.save(placed.repartitionByRange("part", "id").sortWithinPartitions("part").mapInArrow(_blocked(dims), "part int, ids binary, vectors binary"), "index")

    queries = vectors.where(F.col("id") % query_every == 0).select("q", "id", "v")
    best = _search(index, queries, model, dims, probes, k, scratch, "probed")
    if probes < parts:
        others = F.lit(candidates.select("id").distinct().count() - 1)
        short = queries.join(best.groupBy("q").count(), "q", "left").where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), others)).select("q", "id", "v")
        short = scratch.save(short, "short")
        if not short.isEmpty():
            rest = _search(index, short, model, dims, parts, k, scratch, "all")
            best = best.join(short.select("q"), "q", "left_anti").unionByName(rest)
    return best.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", F.col("found").alias(id_col), "score")


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))
