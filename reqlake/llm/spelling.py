"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

With letter counts x and y, |x|^2 + |y|^2 - 2xy is 2 for words of one length that differ by a replaced letter and 1 for
words of adjacent lengths that differ by an inserted one; NumPy products of whole blocks give it for all their pairs, and
pairs of at most 2 are verified letter by letter.  A product of all words of two lengths would grow with their square, so
the shorter word's letters are cut into four segments: an edit lies in one of them and leaves the other three alone.  A
block holds the words of one length, and the next, that agree in three segments.  Each pair is reported in the one block
whose segment holds its first difference.  A block too large for one product is cut finer, segment by segment, until it
fits or its segment is one letter, which leaves as few words as there are letters; no pair is lost on the way.

All letters lie in ASCII and U+00C0 to U+00FF, so a word is a Latin-1 byte string, whose byte order is code-point order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table, text_bytes
from .runs import LATIN, binary_array, gathered, latin_runs
from .textkit import mix

LEAST_LETTERS = 7
LEAST_COUNT = 2
TYPO_EVERY = 31
TIMES = 10  #: how much more frequent a form is than its variant
SEGMENTS = 4
BLOCK = 1024  #: words of a block that are compared at once; a larger one is cut finer
LONG = 64  #: bytes from which checksums are taken run by run

_LETTERS = np.zeros(256, np.int64)  # Latin-1 letters by number
_LETTERS[0x61:0x7B] = np.arange(26)
_LETTERS[0xC0:] = np.arange(26, 90)
_N_LETTERS = 90

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1)


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each piece of ``data`` after what has the checksum ``before``, one byte of all pieces at a time."""
    order = np.argsort(-sizes, kind="stable")
    start, size = starts[order], sizes[order]
    state = before[order].astype(np.uint32)
    n_long = int((size > LONG).sum())
    for i in range(n_long):
        state[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(state[i]))
    short = ~state[n_long:]
    start, size = start[n_long:], size[n_long:]
    active = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
    for at, n in enumerate(active.tolist()):
        short[:n] = _CRC[(short[:n] ^ data[start[:n] + at]) & 0xFF] ^ (short[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = np.concatenate([state[:n_long], ~short])
    return out


def _counted(least: int, typo_every: int | None) -> Callable:
    """Rows (id, text) to (word, n): runs of the texts with their planted deletions, as Latin-1, of ``least`` letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                data, starts, ends, lengths, text = latin_runs(part.column(1), least)
                sizes = ends - starts
                drop = np.full(len(starts), -1)
                if typo_every:
                    ids = part.column(0).to_pylist()
                    prefix = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in ids], np.uint32)
                    h = checksums(data, starts, sizes, prefix[text]).astype(np.int64)
                    hit = (h % typo_every == 0) & ~part.column(0).is_null().to_numpy(zero_copy_only=False)[text]
                    drop = np.where(hit, h % lengths, -1)
                flat = gathered(data, starts, sizes)
                wide = np.append(False, flat[:-1] == LATIN)
                flat = np.where(wide, flat + 0x40, flat)[flat != LATIN]
                kept = np.ones(len(flat), bool)
                kept[(np.cumsum(lengths) - lengths + drop)[drop >= 0]] = False
                left = lengths - (drop >= 0)
                long = left >= least
                words = binary_array(flat[kept & np.repeat(long, lengths)], left[long])
                counts = pc.value_counts(words)
                yield pa.record_batch([counts.field(0), counts.field(1)], ["word", "n"])

    return run


def words_of(documents: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """(word, n) of rows (id, text): Latin-1 words of ``least`` letters or more that occur ``least_count`` times or more."""
    counted = documents.select("id", "text").mapInArrow(_counted(least, typo_every), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any head or tail of a word is one difference."""
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    end = np.repeat(lengths, lengths) - place
    value = mix(data, 11)
    head, tail = value * (mix(place, 12) | np.uint64(1)), value * (mix(end, 13) | np.uint64(1))
    zero = np.zeros(1, np.uint64)
    return np.concatenate([zero, np.cumsum(head)]), np.concatenate([zero, np.cumsum(tail)])


def _keys(head, tail, start, end, low, high, length) -> np.ndarray:
    """The name of all but the letters low to high - 1, for words of ``length`` or one more letter (whose gap is one longer)."""
    longer = (end - start) - length
    rest = mix(head[start + low] - head[start], 14) + mix(tail[end] - tail[start + high + longer], 15)
    return mix(rest + mix(length * 65_537 + low, 16) + mix(high, 17), 18)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) to (key, length, low, high, word, n): every word as one of its length, and of the length before."""
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            part = batch.slice(at, 20_000)
            data, offsets = text_bytes(part.column(0))
            head, tail = _sums(data, offsets)
            start, end = offsets[:-1], offsets[1:]
            for length in (end - start, end - start - 1):
                for s in range(SEGMENTS):
                    low, high = s * length // SEGMENTS, (s + 1) * length // SEGMENTS
                    key = _keys(head, tail, start, end, low, high, length).view(np.int64)
                    yield pa.record_batch([pa.array(key), pa.array(length), pa.array(low), pa.array(high), part.column(0), part.column(1)], ["key", "length", "low", "high", "word", "n"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of blocks that were too large, with half of the segment each."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        head, tail = _sums(data, offsets)
        length, low, high = (batch.column(c).to_numpy() for c in range(3))
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle, high)):
            key = _keys(head, tail, offsets[:-1], offsets[1:], a, b, length).view(np.int64)
            yield pa.record_batch([pa.array(key), pa.array(length), pa.array(a), pa.array(b), batch.column(3), batch.column(4)], ["key", "length", "low", "high", "word", "n"])


def _verified(data, offsets, low, high, length, i, j) -> np.ndarray:
    """Which pairs (i of ``length`` letters, j of as many or one more) are one edit apart, the first difference in low to high - 1."""
    out = np.zeros(len(i), bool)
    size = length[i]
    longer = (offsets[j + 1] - offsets[j]) - size
    for n in np.unique(size):  # words of one length are rows of a matrix
        for more in (0, 1):
            at = np.flatnonzero((size == n) & (longer == more))
            for some in np.array_split(at, max(1, len(at) * int(n) // 4_000_000)):
                a, b = i[some], j[some]
                place = np.arange(n)
                x, y = data[offsets[a][:, None] + place], data[offsets[b][:, None] + place]
                unlike = x != y
                first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), n)
                if more:
                    unlike = (x != data[offsets[b][:, None] + place + 1]) & (place >= first[:, None])
                    good = ~unlike.any(axis=1)
                else:
                    good = unlike.sum(axis=1) == 1
                last = high[a] == n  # an added last letter belongs to the last segment
                out[some] = good & (first >= low[a]) & ((first < high[a]) | (last & (first == n)))
    return out


def _near_in(words: pa.Array, key: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words within the blocks of equal keys, by products of their letter counts.

    Blocks of about one size are stacked and multiplied together.
    """
    data, offsets = text_bytes(words)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    found = []
    step = 2
    while True:
        own = np.flatnonzero((size > step // 2) & (size <= step) & (size > 1))
        for blocks in np.array_split(own, max(1, len(own) * step // 40_000)) if len(own) else []:
            rows = first[blocks][:, None] + np.arange(step)
            real = np.arange(step) < size[blocks][:, None]
            rows = np.where(real, rows, first[blocks][:, None])
            flat = rows.ravel()
            lengths = (offsets[1:] - offsets[:-1])[flat]
            letters = _LETTERS[gathered(data, offsets[flat], lengths)]
            x = np.bincount(np.repeat(np.arange(len(flat)), lengths) * _N_LETTERS + letters, minlength=len(flat) * _N_LETTERS)
            x = x.astype(np.float64 if lengths.max() > 2_000 else np.float32).reshape(len(blocks), step, _N_LETTERS)
            norm = (x * x).sum(axis=2)
            distance = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            shorter = (lengths.reshape(rows.shape) == length[flat].reshape(rows.shape)) & real
            # of two words of the shorter length each pair once; two of the longer are another block's
            pair = (distance <= 2) & real[:, None, :] & shorter[:, :, None] & (~shorter[:, None, :] | (np.arange(step)[:, None] < np.arange(step)))
            b, u, v = np.nonzero(pair)
            i, j = rows[b, u], rows[b, v]
            good = _verified(data, offsets, low, high, length, i, j)
            found.append((i[good], j[good]))
        if step >= size.max(initial=0):
            break
        step *= 2
    return tuple(np.concatenate([f[e] for f in found]) if found else np.zeros(0, np.int64) for e in (0, 1))


def _near(block: int) -> Callable:
    """Sorted blocks to (word, near, near_n), a row in each direction, and members (with low and high) of blocks too large."""
    names = ["word", "near", "near_n", "length", "low", "high", "n"]

    def pairs(part: pa.Table) -> pa.RecordBatch:
        key, length, low, high = (part.column(c).to_numpy() for c in range(4))
        words, n = part.column(4).combine_chunks(), part.column(5).combine_chunks()
        i, j = (pa.array(x) for x in _near_in(words, key, length, low, high))
        a, b = pa.concat_arrays([words.take(i), words.take(j)]), pa.concat_arrays([words.take(j), words.take(i)])
        empty = pa.nulls(len(a), pa.int64())
        return pa.record_batch([a, b, pa.concat_arrays([n.take(j), n.take(i)]), empty, empty, empty, empty], names)

    def large(part: pa.Table) -> Iterator[pa.RecordBatch]:
        for x in part.to_batches():
            yield pa.record_batch([x.column(4), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64()), x.column(1), x.column(2), x.column(3), x.column(5)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None  # the last block so far, which may go on; the key of one known to be too large
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if held is not None:
                now, held = pa.concat_tables([held, now]), None
            key = now.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            high = now.column(3).to_numpy()[first] - now.column(2).to_numpy()[first]
            too_large = ((size > block) | (key[first] == passing)) & (high > 1)
            goes_on = np.zeros(len(first), bool)
            goes_on[-1] = not too_large[-1]
            whole = np.repeat(~too_large & ~goes_on, size)
            if whole.any():
                yield pairs(now.filter(pa.array(whole)))
            if too_large.any():
                yield from large(now.filter(pa.array(np.repeat(too_large, size))))
            passing = key[-1] if too_large[-1] else None
            held = now.filter(pa.array(np.repeat(goes_on, size))) if goes_on[-1] else None
        if held is not None:
            yield pairs(held)

    return run


def near_words(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of rows (word, n): every word one edit away, with its n, a row in each direction."""
    kinds = "key long, length long, low long, high long, word binary, n long"
    blocks, found, turn = words.select("word", "n").mapInArrow(_cut, kinds), [], 0
    while True:
        sorted_ = blocks.repartition("key").sortWithinPartitions("key")
        out = scratch.save(sorted_.mapInArrow(_near(block), "word binary, near binary, near_n long, length long, low long, high long, n long"), f"near-{turn}")
        found.append(out.where("near is not null").select("word", "near", "near_n"))
        rest = out.where("near is null")
        if rest.isEmpty():
            break
        blocks, turn = rest.select("length", "low", "high", "word", "n").mapInArrow(_finer, kinds), turn + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = TYPO_EVERY, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts, as in ``op13_spelling_variants``.

    A null text has no words and a row of a null id no planted deletions; rows repeated count each time.  A run of any
    length is one word.  An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = scratch.save(words_of(docs, typo_every=typo_every), "words")
    near = near_words(words, scratch, block)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    form_n = -F.col("best.minus")
    is_form = form_n >= TIMES * F.col("n")
    known = known.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, form_n).alias("form_n"))
    known = scratch.save(known, "forms")
    # each form is TIMES as frequent as the word before, so a chain is as long as the largest count has digits; a round doubles the steps
    forms = known.where("form is not null").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), TIMES)))
    for turn in range((steps - 1).bit_length()):
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        forms = scratch.save(forms.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{turn}")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    out = known.join(forms, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(text("word").alias("word"), text("form").alias("form"), text("root").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with the frequent word that each is one edit away from.

    Runs of [A-Za-zÀ-ÿ], A-Z lower-cased; where 31 divides the crc32 h of "doc_id:run", the run loses the letter h % length.
    Words have 7 letters and 2 occurrences or more.  form is the near word of largest n (ties: the first) where that is at
    least 10 times the word's n; root is the last of the forms from a word on.
    """
    return variants(table(spark, sf_dir, "documents"))
