"""Repeated passages by sparse suffix arrays.

A suffix is kept where its first GRAM words are a minimiser: the smallest hashed gram of some window of grams as wide as
fits a passage of ``least`` words.  So every passage of ``least`` words that stands in two documents has a suffix kept at the
same place in both.  Suffixes whose gram stands in one document only have no neighbour and go.

A kept suffix is seen with its context: the words after its gram and, read backwards, before it, as far as a whole passage
on either side.  Equal contexts are one row with their smallest and largest document, whatever the number of copies.  Where
those differ, the whole context is a match.  The contexts are sorted twice, by what follows the gram and by what precedes it,
and each is compared with its neighbours in both orders: equal words to the right and to the left extend the match.  Longer
passages hold further kept suffixes at most a window apart, so the matches of neighbouring suffixes overlap and are merged
into maximal spans.

A neighbour in one order may share only what follows and one in the other only what precedes, while a context further away
shares a whole passage.  Two contexts that share a passage agree in the nearer half of one side at least.  So where three or
more contexts agree in such a half, their windows of ``least`` words that hold it are named, and windows of two documents are
matches as well.  (Two that agree are neighbours in that side's order.)

Contexts are sorted in range partitions and compared batch by batch, so contexts of one gram are dealt over tasks like all
others; only a partition's outermost rows are compared across partitions.  No result depends on where partitions are cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Scratch, slices, table, text_bytes

GRAM = 8  #: words that name a kept suffix
LEAST = 50  #: words of the shortest passage reported
_NO = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of x[i : i + w] for every i with a full window."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def minimisers(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the words at which a suffix is kept, and the grams there; texts shorter than ``least`` have none."""
    w = least - GRAM + 1
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = tk.mix(np.arange(GRAM), 51) | np.uint64(1)
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for i, f in enumerate(factors):
        grams += words[i : i + len(grams)] * f
    grams = tk.mix(grams, 52) >> np.uint64(1)
    lowest = _sliding(grams, w, True)
    ends = np.repeat(at[1:], np.diff(at))  # of the text a word is in
    first = np.arange(len(lowest))
    lowest = np.where(first + least <= ends[first], lowest, np.uint64(0))  # a window must lie in one text
    padded = np.concatenate([np.zeros(w - 1, np.uint64), lowest, np.zeros(w - 1, np.uint64)])
    kept = np.flatnonzero(_sliding(padded, w, False)[: len(grams)] == grams)
    kept = kept[grams[kept] > 0]
    repeat = np.concatenate([[False], (np.diff(kept) == 1) & (grams[kept[1:]] == grams[kept[:-1]])]) if len(kept) else np.zeros(0, bool)
    kept = kept[~repeat]  # a run of one repeated word keeps its first place
    return kept, grams[kept]


def _keep(least: int) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, at = tk.word_hashes(*text_bytes(part.column(2)))
                kept, grams = minimisers(words, at, least)
                row = np.searchsorted(at, kept, "right") - 1
                own = pa.array(row)
                yield pa.record_batch([pa.array(grams.view(np.int64)), part.column(0).take(own), part.column(1).take(own), pa.array((kept - at[row]).astype(np.int32))], ["h", "id", "digest", "pos"])

    return run


def _contexts(least: int) -> Callable:
    """Rows (id, digest, text, places): for each place its gram and 16-bit names of the words after and, backwards, before it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, at = tk.word_hashes(*text_bytes(part.column(2)))
                names = (words >> np.uint64(48)).astype(">u2").tobytes()
                backwards = (words[::-1] >> np.uint64(48)).astype(">u2").tobytes()
                out: list[list] = [[], [], [], [], []]
                for row, places in enumerate(part.column(3).to_pylist()):
                    lo, hi = int(at[row]), int(at[row + 1])
                    for pos in places:
                        i = lo + pos
                        out[0].append(i)
                        out[1].append(names[2 * (i + GRAM) : 2 * min(hi, i + least)])
                        j = len(words) - i  # the word before i is the first of the reversed words from here
                        out[2].append(backwards[2 * j : 2 * min(j + least - GRAM, len(words) - lo)])
                        out[3].append(row)
                        out[4].append(pos)
                grams = words[np.array(out[0], np.int64)[:, None] + np.arange(GRAM)] if out[0] else np.zeros((0, GRAM), np.uint64)
                h = tk.mix((grams * (tk.mix(np.arange(GRAM), 51) | np.uint64(1))).sum(axis=1, dtype=np.uint64), 52).view(np.int64)
                own = pa.array(out[3], pa.int64())
                yield pa.record_batch(
                    [pa.array(h), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), part.column(0).take(own), part.column(1).take(own), pa.array(out[4], pa.int32())],
                    ["h", "after", "before", "id", "digest", "pos"],
                )

    return run


def _names(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 16-bit names as rows of a matrix, and their lengths."""
    data, offsets = text_bytes(column)
    lengths = np.diff(offsets) // 2
    flat = data.view(">u2") if len(data) else np.zeros(0, ">u2")
    out = np.zeros((len(column), width), np.uint16)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] // 2, lengths)] = flat
    return out, lengths


def _common(names: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal names at the start of every row and the next."""
    width = names.shape[1]
    apart = (names[1:] != names[:-1]) | (np.arange(width) >= np.minimum(lengths[1:], lengths[:-1])[:, None])
    return np.where(apart.any(axis=1), apart.argmax(axis=1), width)


_CONTEXT = ["h", "after", "before", "c", "low", "high"]
_NEIGHBOURS = "edge boolean, h long, after binary, before binary, c long, low long, high long, left int, right int"


def _neighbours(least: int, with_edges: bool) -> Callable:
    """Sorted contexts: matches of ``least`` words of contexts of one document, and the partition's first and last row."""

    def edge(row: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([True]), *row.columns, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())], ["edge", *_CONTEXT, "left", "right"])

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            if held is None and with_edges:
                yield edge(batch.slice(0, 1))
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(len(batch) - 1)
            h, c, low, high = (t.column(i).to_numpy() for i in (0, 3, 4, 5))
            right, left = _common(*_names(t.column(1), least - GRAM)), _common(*_names(t.column(2), least - GRAM))
            good = np.flatnonzero((h[1:] == h[:-1]) & (left + GRAM + right >= least))
            x, y = np.concatenate([good, good + 1]), np.concatenate([good + 1, good])
            left, right = np.tile(left[good], 2), np.tile(right[good], 2)
            some = (low[x] == high[x]) & ((low[y] != low[x]) | (high[y] != low[x]))  # of one document, with a context that another has
            n, x, y = int(some.sum()), x[some], y[some]
            yield pa.record_batch(
                [pa.array([False] * n, pa.bool_()), pa.array(h[x]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(c[x]), pa.array(low[y]), pa.array(high[y]),
                 pa.array(left[some].astype(np.int32)), pa.array(right[some].astype(np.int32))],
                ["edge", *_CONTEXT, "left", "right"],
            )
        if held is not None and with_edges:
            yield edge(held)

    return run


def _windows(least: int) -> Callable:
    """Rows (side, h, after, before, c, low, high): a row per window of ``least`` words that holds the gram and the nearer half of that side."""
    rest = least - GRAM
    half = -(-rest // 2)
    place, lefts = tk.mix(np.arange(2 * rest), 53) | np.uint64(1), tk.mix(np.arange(rest + 1), 54)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.slice(at, 20_000)
                side, h = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
                sums, have = [], []
                for column, factors in ((2, place[:rest]), (3, place[rest:])):
                    names, lengths = _names(part.column(column), rest)
                    total = np.zeros((len(part), rest + 1), np.uint64)
                    np.cumsum(tk.mix(names, 55) * factors, axis=1, out=total[:, 1:])
                    sums.append(total)
                    have.append(lengths)
                left = np.arange(rest + 1)
                fits = (left <= have[1][:, None]) & (rest - left <= have[0][:, None])
                fits &= np.where(side[:, None] == 0, left <= rest - half, left > rest - half)
                row, left = np.nonzero(fits)
                names = tk.mix(h[row] + lefts[left] + sums[0][row, rest - left] + sums[1][row, left], 56)
                taken = part.take(pa.array(row))
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(left.astype(np.int32)), *(taken.column(i) for i in (1, 4, 5, 6))], ["w", "left", "h", "c", "low", "high"])

    return run


def _window_matches(contexts: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Matches of contexts of one document among three or more that agree in the nearer half of a side."""
    rest = least - GRAM
    half = -(-rest // 2)
    sides = []
    for number, (column, words) in enumerate((("after", half), ("before", rest - half + 1))):
        key = F.xxhash64(F.lit(number), F.col("h"), F.substring(column, 1, 2 * words))
        sides.append(F.when(F.octet_length(column) >= 2 * words, F.struct(F.lit(number).alias("side"), key.alias("g"))))
    sided = contexts.select(*_CONTEXT, F.explode(F.array_compact(F.array(*sides))).alias("s")).select(*_CONTEXT, "s.side", "s.g")
    many = sided.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("low") == F.col("high")).alias("single")).where("n > 2 and single > 0").select("g")
    many = scratch.save(many, "many")
    windows = sided.join(many, "g", "left_semi").select("side", *_CONTEXT).mapInArrow(_windows(least), "w long, left int, h long, c long, low long, high long")
    windows = scratch.save(windows, "windows")
    shared = windows.groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    found = windows.where("low = high").select("w", "left", "h", "c").join(shared, "w")
    return found.select("h", "c", "left", (rest - F.col("left")).alias("right"), "low", "high")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, first_word, last_word, n_words, partner_id): maximal spans of at least ``least`` words found in other documents.

    Words are runs of bytes other than ASCII white space with A-Z lower-cased, numbered from 0; last_word is included.
    partner_id is the smallest id among the matches that make up the span.  Null, empty and shorter texts have no span;
    repeats inside one document, and rows that repeat an id, are not passages across documents; where an id has several
    texts each has its own spans, once however often it is repeated; rows of a null id are left out; an empty table gives
    no rows; other columns are not read.
    """
    if least < GRAM:
        raise ValueError(f"passages have {GRAM} words at least")
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")).where("id is not null")
    kept = scratch.save(texts.mapInArrow(_keep(least), "h long, id long, digest long, pos int"), "kept")
    # grams of two documents: a map-side minimum and maximum, written, so that Spark can split the semi join's hot keys
    several = kept.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    several = scratch.save(several, "several")
    shared = scratch.save(kept.join(several, "h", "left_semi"), "shared")
    scratch.drop("kept", "several")
    places = shared.groupBy("id", "digest").agg(F.collect_set("pos").alias("places"))  # of one text: as long as it at most
    suffixes = texts.join(places, ["id", "digest"]).select("id", "digest", "text", "places")
    suffixes = suffixes.mapInArrow(_contexts(least), "h long, after binary, before binary, id long, digest long, pos int")
    suffixes = scratch.save(suffixes.withColumn("c", F.xxhash64("after", "before")), "suffixes")
    scratch.drop("shared")
    contexts = suffixes.groupBy("h", "after", "before", "c").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    contexts = scratch.save(contexts.select(*_CONTEXT), "contexts")

    def matches(order: list[str], name: str) -> DataFrame:
        found = contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(least, True), _NEIGHBOURS)
        found = scratch.save(found, name)
        edges = found.where("edge").select(*_CONTEXT)  # two rows a partition
        across = edges.repartition("h").sortWithinPartitions(*order).mapInArrow(_neighbours(least, False), _NEIGHBOURS)
        return found.where("not edge").union(across).select("h", "c", "left", "right", "low", "high")

    words = lambda column: (F.octet_length(column) / 2).cast("int")
    found = contexts.where("low < high").select("h", "c", words("before").alias("left"), words("after").alias("right"), "low", "high")
    found = found.union(matches(["h", "after", "before"], "by-after")).union(matches(["h", "before", "after"], "by-before"))
    found = found.union(_window_matches(contexts, scratch, least))
    # all matches of a context hold its gram, so together they are one span
    found = found.groupBy("h", "c").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = scratch.save(found, "matches")
    partner = F.when(F.col("low") != F.col("id"), F.col("low")).otherwise(F.col("high"))
    spans = suffixes.select("h", "c", "id", "digest", "pos").join(found, ["h", "c"])
    spans = spans.select("id", "digest", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + GRAM + F.col("right")).alias("last"), partner.alias("partner"))
    spans = spans.groupBy("id", "digest", "first", "last").agg(F.min("partner").alias("partner"))
    order = Window.partitionBy("id", "digest").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy("id", "digest", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("partner").alias("partner"))
    return spans.select(
        F.col("id").alias(id_col), F.col("first").cast("long").alias("first_word"), (F.col("last") - 1).cast("long").alias("last_word"), (F.col("last") - F.col("first")).cast("long").alias("n_words"),
        F.col("partner").alias("partner_id"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
