"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

A source's target over its size is the expected number of copies of each of its documents.  The fraction of it is
rounded dependently: two documents with fractional probabilities exchange mass (probability times size) at random until
one of them is integral, so every document keeps its expectation and the source keeps its sum of words exactly.  Blocks
of documents are rounded side by side and each leaves one fractional document; those residuals meet in blocks of
blocks, level after level, until one document a source is left and rounded alone, by a draw of its own.  That last rounding
is the only one that moves a source's sum: by less than that document's size.  Large documents meet first, so it is mostly a
small one, but where a source has few documents a large one may be left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_bytes
from .textkit import mix

WEIGHTS = (5, 2, 1)  #: of the sources by code point, repeating; null comes last
SHARE = 1.5  #: words the mix takes, as a multiple of all words
MOST_COPIES = 2  #: a source's target is at most so many times its size
BLOCK_ROWS = 4096  #: documents a leaf of the reduction tree rounds, on average
FAN_IN = 64  #: residuals an inner node of the tree combines
REPEATS = 1 << 16  #: repeats of a row that are written out at once


def _sizes(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        raw = data.tobytes()
        counts = [len(raw[lo:hi].split()) for lo, hi in zip(offsets, offsets[1:])]  # bytes.split() parts at 0x20 and 0x09-0x0D
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64())], ["id", "source", "digest", "size"])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, s, source_size, n, target): word targets by weight, stopped at MOST_COPIES times the source's size.

    What a stopped source can't take is shared among the others by weight until none is above: with the sources in
    the order of their bound over weight, a source is stopped if its bound is at most its share of what those before leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cost = Window.orderBy("ratio", "s")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("s", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") - 1) % len(WEIGHTS) + 1).cast("double")
    src = src.withColumn("weight", weight).withColumn("bound", MOST_COPIES * F.col("source_size").cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    before = F.coalesce(F.sum("bound").over(cost.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(cost.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * SHARE
    src = src.withColumn("level", (total - before) / left).withColumn("stopped", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("stopped"), F.struct("ratio", "s", "level"))).over(Window.partitionBy())["level"]
    return src.withColumn("target", F.when(F.col("stopped"), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("weight") * level))).select("source", "s", "source_size", "n", "target")


def pivotal(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds probabilities to 0 or 1 but for at most one, keeping every expectation and the sum of size * p."""
    out, held = p.copy(), -1
    for j in range(len(p)):
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        a, b, x, y = size[i], size[j], out[i], out[j]
        down = min(a * x, b * (1 - y))  # mass that can go from i to j
        up = min(a * (1 - x), b * y)
        if draws[j] * (down + up) < up:
            if a * x <= b * (1 - y):
                out[i], out[j] = 0.0, min(1.0, y + down / b)
            else:
                out[i], out[j] = max(0.0, x - down / a), 1.0
        elif a * (1 - x) <= b * y:
            out[i], out[j] = 1.0, max(0.0, y - up / b)
        else:
            out[i], out[j] = min(1.0, x + up / a), 0.0
        held = i if 0.0 < out[i] < 1.0 else j if 0.0 < out[j] < 1.0 else -1
    return out


def _round_block(seed: int, depth: int, last: bool) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, digest, turn = (pdf[c].fillna(-1).to_numpy(np.int64) for c in ("id", "digest", "turn"))
        key = mix(mix(mix(ids, seed) ^ mix(digest) ^ mix(turn, 5)) ^ pdf["size"].to_numpy(np.int64).astype(np.uint64), depth)
        # large ones first, so that they settle among each other and the many small ones bring the last one to an end
        order = np.lexsort((turn, digest, ids, key, -pdf["size"]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        size, start = pdf["size"].to_numpy(np.float64), pdf.p.to_numpy(np.float64)
        draw = lambda turn: (mix(key[order], turn) >> np.uint64(11)) / float(1 << 53)
        p = pivotal(size, start, draw(31))
        if last:  # the one that is left has a draw of its own, independent of the exchanges
            p = np.where((p > 0) & (p < 1), (draw(32) < p).astype(float), p)
        return pdf.assign(p=p)

    return run


def _plan(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, digest, source, size, source_size, target, copies) per row of ``docs``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("digest"), text.alias("text"))
    sizes = scratch.save(rows.mapInArrow(_sizes, "id long, source string, digest long, size long"), "sizes")
    src = scratch.save(targets(sizes), "targets")

    # repeats of a row are counted before the shuffle and numbered, so that they too are dealt over the blocks, alike in every run
    turns = sizes.groupBy("id", "source", "digest", "size").agg((F.count("*") - 1).alias("last"))
    turns = turns.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / REPEATS))).alias("high"))
    turns = turns.select("id", "source", "digest", "size", F.explode(F.sequence(F.col("high") * REPEATS, F.least(F.col("last"), F.col("high") * REPEATS + REPEATS - 1))).alias("turn"))
    named = src.withColumnRenamed("source", "_source")
    plan = turns.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn("rid", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "digest", "turn"), F.ceil(F.col("n") / BLOCK_ROWS))
    plan = scratch.save(plan.withColumn("block", block), "plan")

    schema = "rid long, id long, digest long, turn long, size long, s int, block long, p double"
    work, depth, done = plan.where("p > 0 and size > 0").select("rid", "id", "digest", "turn", "size", "s", "block", "p"), 0, []
    blocks = -(-(src.agg(F.max("n")).first()[0] or 1) // BLOCK_ROWS)
    while True:
        rounded = work.groupBy("s", "block").applyInPandas(_round_block(seed, depth, blocks == 1), schema)
        rounded = scratch.save(rounded, f"level-{depth}")
        done.append(rounded.where("p = 0 or p = 1").select("rid", F.col("p").cast("long").alias("extra")))
        if blocks == 1:
            break
        blocks, depth = -(-blocks // FAN_IN), depth + 1
        work = rounded.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
    extra = done[0]
    for more in done[1:]:
        extra = extra.union(more)
    out = plan.join(extra, "rid", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select("id", "digest", "source", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, taken, copies) per row of ``docs``.

    size counts runs of bytes other than ASCII white space; null and empty texts have size 0 and are taken 0 times over.
    A null source is a source of its own, the last.  Repeated rows are rounded each; all draws are keyed hashes of the id,
    the text and the number of the repeat, so reruns agree whatever the partitioning.  Where all sizes are 0, targets are
    0.  An empty table gives no rows; other columns are not read.

    Rounding keeps a source's sum but for the last document left, so its taken words differ from its target by less than
    that one's size: by 0.1 % of the target at most in tables with 50 documents a source, and 0.001 % with 500 (measured).
    A source of ten documents can be off by a fifth.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    out = _plan(docs, scratch, id_col, text_col, source_col, seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, once or twice); all columns are kept, whatever their names.

    Rows are those of ``mix_sources``; of rows that repeat an id, a source and a text, it is settled how many are taken.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    named = _plan(docs, scratch, id_col, text_col, source_col, seed).groupBy("id", "source", "digest")
    named = scratch.save(named.agg(F.sum("copies").alias("total"), F.count("*").alias("n")), "copies").where("total > 0")
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(text_col).cast("string")
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("rid"), F.col(source_col).cast("string").alias("rsource"), F.xxhash64(text).alias("rdigest"))
    out = rows.join(named, F.col("rid").eqNullSafe(F.col("id")) & F.col("rsource").eqNullSafe(F.col("source")) & (F.col("rdigest") == F.col("digest")))
    out = out.withColumn("copies", F.floor(F.col("total") / F.col("n")))
    even = out.where("copies > 0 and total % n = 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    if named.where("total % n > 0").isEmpty():
        return even.select("row.*")
    # some repeats come once more than others: equal rows are counted before the shuffle, and only different ones are ranked
    uneven = out.where("total % n > 0").groupBy("id", "source", "digest", "row", "total", "n", "copies").agg(F.count("*").alias("m"))
    rank = Window.partitionBy("id", "source", "digest").orderBy(F.xxhash64("row"), "row")
    before = F.coalesce(F.sum("m").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("m"), F.col("total") % F.col("n") - before))
    uneven = uneven.withColumn("times", F.col("copies") * F.col("m") + more).where("times > 0")
    uneven = uneven.select("row", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))).alias("part")).repartition(F.xxhash64("row", "part"))
    uneven = uneven.select("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("times") - F.col("part") * REPEATS).cast("int"))))
    return even.union(uneven).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix of all sources."""
    return mix_sources(table(spark, sf_dir, "documents"))
