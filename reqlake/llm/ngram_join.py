"""N-gram Jaccard self-join by prefix filters under several global token orders, and its connected components.

Two texts link when the Jaccard similarity of their word-shingle sets is at least num / den.  Under any global order of
the shingles, two linked sets of sizes n and m share one of their first n - ceil(t * n) + 1 (or m - ...) shingles.

1. ``order_levels``: one pass over all texts counts every shingle into a fixed number of counters.  Their logarithms are
   the leading key of order A, so shingles that many texts share come last.  (The order steers cost, never results.)
2. ``profiles``: per text its set size, a 128-bit name of its set, its prefix under order A, and three bit fields: the
   parity of all shingles, and the prefixes under the hashed orders B and C.  Texts of equal sets collapse to one entity.
3. Entities meet in buckets by order-A prefix shingle.  Many shingles have the same members: sets of members are named by
   their size and two sums of hashes, added up before the shuffle, and one shingle stands for each.  Within a bucket,
   pairs must pass the size filter, share prefix bits under orders B and C, and pass the parity bound: |x ^ y| is at least
   the number of differing parity bits and, for links, at most (1 - t) / (1 + t) * (n + m).
4. Two rounds deal a bucket into blocks of bounded size, each time anew, verify one spanning forest of each block's surviving
   pairs on the texts, and contract what links: their work is linear, and they connect a large group of near copies.
   A last round takes the buckets that still have more than one component and verifies every surviving pair whose ends
   lie in different ones.  So all links are decided, but a group of near copies never has all its pairs written out.

In the last round a large bucket is split by set size into classes of which only a class and the next can link, and those
into pairs of bounded blocks, so no task holds a whole hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Scratch, slices, table, text_bytes
from .components import connected_components

COUNTERS_BITS = 20  #: order A counts shingles into 2**20 counters; more only sharpen the order
ADDING_PARTS = 64  #: groups of tasks whose counters are added first
FILTER_BITS = 512  #: bits a prefix under order B or C is folded into
PARITY_BITS = 1024  #: least size of the parity field; larger sets have the next power of two
BLOCK = 2048  #: entities on either side of one bucket comparison, on average


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text of the batch."""
    words, at = tk.word_hashes(*text_bytes(batch.column(column)))
    shingles, out_at = tk.shingle_hashes(words, at, k)
    for row in range(len(batch)):
        yield row, np.unique(shingles[out_at[row] : out_at[row + 1]])


def order_levels(texts: DataFrame, k: int) -> np.ndarray:
    """log2 of how often the shingles of each counter occur, over all texts: 2**COUNTERS_BITS bytes, whatever the input."""
    chunks, per_chunk = 16, (1 << COUNTERS_BITS) // 16

    def count(batches):
        total = np.zeros(1 << COUNTERS_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                words, at = tk.word_hashes(*text_bytes(part.column(0)))
                shingles, _ = tk.shingle_hashes(words, at, k)
                total += np.bincount(shingles >> np.uint64(64 - COUNTERS_BITS), minlength=len(total)).astype(np.uint32)
        yield pa.record_batch([pa.array(range(chunks), pa.int32()), pa.array([x.astype(np.uint64).tobytes() for x in total.reshape(chunks, -1)], pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[chunk] = sums.get(chunk, np.zeros(per_chunk, np.uint64)) + np.frombuffer(counts.as_buffer(), np.uint64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    def logarithms(batches):
        for batch in add(batches):
            levels = [np.ceil(np.log2(np.frombuffer(x.as_buffer(), np.uint64) + 1.0)).astype(np.uint8).tobytes() for x in batch.column(1)]  # 0 .. 63, a byte a counter
            yield pa.record_batch([batch.column(0), pa.array(levels, pa.binary())], ["chunk", "levels"])

    counted = texts.select("text").mapInArrow(count, "chunk int, counts binary")
    # added up in two steps: what a task reads stays within the square root of the number of tasks before it
    some = counted.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ADDING_PARTS))).repartition("chunk", "part").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    added = some.repartition(chunks, "chunk").mapInArrow(logarithms, "chunk int, levels binary")
    levels = np.zeros((chunks, per_chunk), np.uint8)
    for row in added.collect():  # always 16 rows of 64 KiB
        levels[row.chunk] = np.frombuffer(row.levels, np.uint8)
    return levels.reshape(-1)


def _fold(values: np.ndarray, bits: int, parity: bool) -> np.ndarray:
    """A bit field of the values' low bits: their parity, or which are set."""
    spots, times = np.unique(values & np.uint64(bits - 1), return_counts=True)
    field = np.zeros(bits // 8, np.uint8)
    spots = spots[times % 2 == 1] if parity else spots
    np.bitwise_or.at(field, (spots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
    return field


def _profile_batches(levels, k: int, num: int, den: int) -> Callable:
    def run(batches):
        order = levels.value
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for _, s in _sets(part, 1, k):
                    n = len(s)
                    p = n - -(-num * n // den) + 1 if n else 0
                    ranked = (order[s >> np.uint64(64 - COUNTERS_BITS)].astype(np.uint64) << np.uint64(58)) | (tk.mix(s, 11) >> np.uint64(6))
                    by_a = s[np.argpartition(ranked, p - 1)[:p]] if p < n else s
                    width = max(PARITY_BITS, 1 << max(n - 1, 0).bit_length())
                    fields = [_fold(tk.mix(s, 12), width, True)]
                    for key in (13, 14):  # orders B and C
                        other = tk.mix(s, key)
                        fields.append(_fold(np.partition(other, p - 1)[:p] if p < n else other, FILTER_BITS, False))
                    out[0].append(n)
                    out[1].append(int(np.bitwise_xor.reduce(tk.mix(s, 15)).view(np.int64)) if n else 0)
                    out[2].append(int(np.add.reduce(tk.mix(s, 16)).view(np.int64)) if n else 0)
                    out[3].append(by_a.view(np.int64))
                    out[4].append(b"".join(x.tobytes() for x in fields) if n else None)
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())],
                    ["id", "digest", "n", "f1", "f2", "prefix", "bits"],
                )

    return run


def _words64(fields: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fields), np.uint64).reshape(len(fields), -1)


def _narrow(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity fields of a wider power of two as those of ``words`` 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _surviving(n, parity, prefix_b, prefix_c, left, right, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i from left, j from right, or either way round), each once, that pass the size, parity, order-B and order-C filters, and their slack."""
    widths = sorted({x.shape[1] for x in parity})
    for wa in widths:
        # a field of the wider size wb has more than wb / 2 shingles and one of wa at most wa, so the size filter ends here
        for wb in (w for w in widths if w == wa or (w > wa and num * w < 2 * den * wa)):
            for p, q in ((left, right), (right, left)) if wa != wb and left is not right else ((left, right),):
                rows = np.array([i for i in p if parity[i].shape[1] == wa], np.int64)
                cols = np.array([j for j in q if parity[j].shape[1] == wb], np.int64)
                if not len(rows) or not len(cols):
                    continue
                a = np.concatenate([parity[i] for i in rows])
                b = _narrow(np.concatenate([parity[j] for j in cols]), wa)
                step = max(1, 2_000_000 // (len(cols) * wa))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    total = n[some][:, None] + n[cols][None, :]
                    ok = den * np.minimum(n[some][:, None], n[cols][None, :]) >= num * np.maximum(n[some][:, None], n[cols][None, :])
                    apart = np.bitwise_count(a[lo : lo + step][:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok &= apart * (den + num) <= (den - num) * total
                    if left is right and wa == wb:
                        ok &= some[:, None] < cols[None, :]
                    i, j = np.nonzero(ok)
                    x, y = some[i], cols[j]
                    good = (prefix_b[x] & prefix_b[y]).any(axis=1) & (prefix_c[x] & prefix_c[y]).any(axis=1)
                    yield x[good], y[good], (apart[i, j] / total[i, j])[good]


def _pairs_of(e, n, bits, label, side_a, side_b, num, den, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    cut = FILTER_BITS // 8
    parity = [_words64([x[: -2 * cut]]) for x in bits]
    prefix_b, prefix_c = _words64([x[-2 * cut : -cut] for x in bits]), _words64([x[-cut:] for x in bits])
    found = list(_surviving(n, parity, prefix_b, prefix_c, side_a, side_b, num, den))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, slack = (np.concatenate(z) for z in zip(*found))
    keep = (e[x] != e[y]) & (label[x] != label[y])
    x, y, slack = x[keep], y[keep], slack[keep]
    if forest:
        parent = list(range(len(e)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        chosen, nodes = [], len(np.unique(np.concatenate([x, y])))
        hubs = np.minimum(e[x], e[y])
        for at in np.lexsort((hubs, np.floor(slack * 50))):  # surest first, then by common hubs, so buckets agree
            if (p := root(int(x[at]))) != (q := root(int(y[at]))):
                parent[p] = q
                chosen.append(at)
                if len(chosen) == nodes - 1:  # all are connected
                    break
        x, y = x[chosen], y[chosen]
    return np.minimum(e[x], e[y]), np.maximum(e[x], e[y])


def _compare(num: int, den: int, forest: bool) -> Callable:
    """Rows (s, i, j, side, e, n, bits, label) sorted by (s, i, j): candidate pairs (a, b), a < b."""

    def run(batches):
        held: pa.Table | None = None

        def groups(t: pa.Table):
            key = [t.column(c).to_numpy() for c in ("s", "i", "j")]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
            starts = np.flatnonzero(new)
            return starts, np.append(starts[1:], len(t))

        def pairs(t: pa.Table, starts, ends):
            e, n, label, side = (t.column(c).to_numpy() for c in ("e", "n", "label", "side"))
            bits = t.column("bits").to_pylist()
            a, b = [], []
            for lo, hi in zip(starts, ends):
                if label[lo:hi].min() == label[lo:hi].max():
                    continue
                if side[lo]:  # two blocks of a large bucket
                    left, right = np.flatnonzero(side[lo:hi] == 1), np.flatnonzero(side[lo:hi] == 2)
                else:
                    left = right = np.arange(hi - lo)
                p, q = _pairs_of(e[lo:hi], n[lo:hi], bits[lo:hi], label[lo:hi], left, right, num, den, forest)
                a.append(p)
                b.append(q)
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            kept = np.unique(np.stack([a, b]), axis=1) if len(a) else np.stack([a, b])
            return pa.record_batch([pa.array(kept[0]), pa.array(kept[1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            starts, ends = groups(held)
            if len(starts) > 1:
                yield pairs(held, starts[:-1], ends[:-1])
                held = held.slice(int(starts[-1])).combine_chunks()
        if held is not None and len(held):
            yield pairs(held, *groups(held))

    return run


def _verify(k: int, num: int, den: int) -> Callable:
    """Rows (a, b, text_a, text_b): those pairs whose shingle sets reach the similarity."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                for piece in slices(part, "text_b"):
                    a, b = ((s for _, s in _sets(piece, i, k)) for i in (2, 3))
                    good = []
                    for x, y in zip(a, b):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(den * common >= num * (len(x) + len(y) - common) and common > 0)
                    yield pa.record_batch([piece.column(0), piece.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _buckets(entities: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(s, size, e, size_class): the entities of every set of two or more that share an order-A prefix shingle, once a set.

    Sets of sizes n <= m can link only if n >= t * m, so only if their classes are equal or neighbours.
    """
    width = math.log(den / num) * 1.0001 if num < den else 1.0
    size_class = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    holders = entities.select(F.explode("prefix").alias("t"), "e", size_class.alias("size_class"))
    sets = holders.groupBy("t").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("e")).alias("x"), F.bit_xor(F.xxhash64("e", F.lit(1))).alias("y")).where("size > 1")
    named = scratch.save(sets.groupBy("size", "x", "y").agg(F.min("t").alias("t")).select("t", "size"), "sets")
    return scratch.save(holders.join(named, "t").select(F.col("t").alias("s"), "size", "e", "size_class"), "buckets")


def _unconnected(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets that hold more than one component, with the component of every member as its label."""
    labelled = buckets.join(roots.withColumnRenamed("node", "e"), "e", "left").withColumn("label", F.coalesce("root", "e")).drop("root")
    several = labelled.groupBy("s").agg((F.min("label") < F.max("label")).alias("several")).where("several").select("s")
    return labelled.join(several, "s", "left_semi")


def _own_block(buckets: DataFrame, turn: int) -> DataFrame:
    """Rows (s, i, j, side, e, label): every member in one block of its bucket, dealt by a hash of its own each turn."""
    block = F.pmod(F.xxhash64("e", F.lit(turn)), F.ceil(F.col("size") / BLOCK))
    return buckets.select("s", block.alias("i"), block.alias("j"), F.lit(0).alias("side"), "e", "label")


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """Rows (s, i, j, side, e, label): members by pairs of blocks that can hold links; side tells a pair's blocks apart (0: one block)."""
    small = buckets.where(F.col("size") <= BLOCK).select("s", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "e", "label")
    large = buckets.where(F.col("size") > BLOCK)
    blocks = large.groupBy("s", "size_class").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    near = F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)]))  # a class meets itself and its neighbours
    meets = blocks.select("s", near.alias("to"), F.struct("size_class", "m").alias("of")).groupBy("s", F.col("to").alias("size_class")).agg(F.collect_list("of").alias("of"))
    name = lambda c, b: F.shiftleft(c.cast("long"), 32) + b
    own = F.element_at(F.filter("of", lambda o: o["size_class"] == F.col("size_class")), 1)["m"]
    others = F.flatten(F.transform("of", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["m"] - 1), lambda b: name(o["size_class"], b))))
    large = large.join(meets, ["s", "size_class"]).withColumn("own", name(F.col("size_class"), F.pmod(F.xxhash64("e"), own)))
    large = large.select("s", "e", "label", "own", F.explode(others).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return small.union(large.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "e", "label"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest): id and digest name a row by its content, so they find it again in any later run of the plan."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, digest, n, set_id, component_id, kept) per row of ``docs``, those of a null id included; the nodes are shingle sets.

    kept marks of each component the row of the smallest id (a null id comes last) and digest, and all texts without words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    texts = _keyed(docs, id_col, text_col)
    levels = spark.sparkContext.broadcast(order_levels(texts, k))
    profiles = scratch.save(texts.mapInArrow(_profile_batches(levels, k, num, den), "id long, digest long, n long, f1 long, f2 long, prefix array<long>, bits binary"), "profiles")

    row = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    entities = profiles.where("n > 0").groupBy("f1", "f2").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    entities = scratch.save(entities.withColumn("e", F.monotonically_increasing_id()), "entities")
    nodes = scratch.save(entities.select("e", "f1", "f2", "least"), "nodes")
    members = scratch.save(profiles.select("id", "digest", "n", "f1", "f2"), "members")
    scratch.drop("profiles")

    buckets = _buckets(entities, scratch, num, den)
    wanted = nodes.join(buckets.select("e").distinct(), "e", "left_semi").select("e", F.col("least.id").alias("_id"), F.col("least.digest").alias("_digest"))
    wanted_texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("e", "text")
    wanted_texts = scratch.save(wanted_texts.dropDuplicates(["e"]), "texts")

    def candidates(dealt: DataFrame, forest: bool) -> DataFrame:
        dealt = dealt.join(entities.select("e", "n", "bits"), "e").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
        return dealt.mapInArrow(_compare(num, den, forest), "a long, b long").distinct()

    def links(pairs: DataFrame) -> DataFrame:
        left = wanted_texts.select(F.col("e").alias("a"), F.col("text").alias("text_a"))
        right = wanted_texts.select(F.col("e").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify(k, num, den), "a long, b long")

    found, live = None, buckets.withColumn("label", F.col("e"))
    for turn, name in enumerate(("first", "again", "last")):
        if name == "again" and buckets.where(F.col("size") > BLOCK).isEmpty():  # the first turn has seen each bucket whole
            continue
        dealt = _all_pairs(live) if name == "last" else _own_block(live.where(F.col("size") > BLOCK) if turn else live, turn)
        pairs = scratch.save(candidates(dealt, name != "last"), f"pairs-{name}")
        more = scratch.save(links(pairs), f"links-{name}")
        found = more if found is None else found.union(more)
        roots = scratch.save(connected_components(found, scratch, f"cc-{name}"), f"roots-{name}")
        if name != "last":
            live = scratch.save(_unconnected(buckets, roots), f"live-{name}")
    scratch.drop("buckets", "texts", "entities")

    sets = nodes.join(roots.withColumnRenamed("node", "e"), "e", "left").select("f1", "f2", "least", F.coalesce("root", "e").alias("root"))
    sets = sets.join(sets.groupBy("root").agg(F.min("least").alias("first")), "root").select("f1", "f2", F.col("least.id").alias("set_id"), "first")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    own = members.where("n > 0").join(sets, ["f1", "f2"]).select("id", "digest", "n", "set_id", F.col("first.id").alias("component_id"), kept.alias("kept"))
    alone = members.where("n = 0").select("id", "digest", "n", F.col("id").alias("set_id"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return own.union(alone)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, null_ids: bool = False) -> DataFrame:
    """(id, n_shingles, set_id, component_id) per row of ``docs``: components of texts linked at num / den similarity.

    component_id is the smallest id reachable by links, itself included; set_id the smallest id with the same shingle
    set.  Defined results: null, empty and blank texts have no shingles, are linked with nothing and stand alone; texts of
    fewer than k words are one shingle; equal texts and repeated rows link with one another (similarity 1); where an id has
    several texts each is decided by itself, so its rows can be in different components; rows of a null id are left out
    unless ``null_ids`` is set, when they take part and their ids are null wherever no other id is reachable; an empty
    table gives no rows.  Other columns are not read, whatever their names.
    """
    docs = docs if null_ids else docs.where(F.col(id_col).isNotNull())
    out = _components(docs, id_col, text_col, k, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", "component_id")


def near_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of the smallest id; all columns are kept, whatever their names.

    Texts without words stay.  Rows of a null id take part, and stay where their component has no other id (of several,
    one text).  Where an id has several texts each stays or goes by itself.  Repeats of one id and text stay or go together.
    """
    keep = _components(docs, id_col, text_col, k, num, den).where("kept").select("id", "digest").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("rid"), F.xxhash64(F.col(text_col).cast("string")).alias("rdigest"))
    return rows.join(keep, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rdigest") == F.col("digest")), "left_semi").select("row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 4-word shingles and 85 % similarity; a row per document, also of a null id."""
    return ngram_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100, null_ids=True).select("doc_id", "n_shingles", "component_id", "set_id")
