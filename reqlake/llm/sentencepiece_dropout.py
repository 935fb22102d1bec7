"""SentencePiece BPE encoding with seeded merge dropout, and decoding.

The agenda of a text holds its adjacent symbol pairs whose concatenation is a piece; the best-scored (then leftmost) pair
is taken off and merged, unless a keyed hash of (seed, document, place, left piece, right piece) falls below the dropout
rate, in which case that candidate is discarded.  Rate 0 is plain SentencePiece BPE.  The hash makes segmentations vary by
seed, document and place, yet any rerun gives the same pieces.

No piece of such a model continues past a space, so spans that start at a space after a non-space are independent.  Spans
up to ``SPAN`` characters of a batch are processed side by side as matrices of equal length; longer ones one by one
with a heap.  Characters without a piece become byte pieces; a literal U+2581 does too, so decoding is lossless.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table
from .textkit import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
SPAN = 48  #: characters of the longest span processed in matrices
NONE = np.int32(2**31 - 1)
_META = "▁"


class Pieces:
    """The merge table of a model: pair of pieces -> merged piece, and the order in which merges are taken."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in plain}
        if any(_META in name.lstrip(_META) for name in ids):
            raise ValueError("a piece of this model continues past a space")
        self.bytes = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(names[i][3:-1], 16)])
                self.byte_ids[self.bytes[i][0]] = i
        for name, i in ids.items():
            self.bytes[i] = name.replace(_META, " ").encode()
        self.chars = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1 and name != _META:
                self.chars[ord(name)] = i
        self.chars[0x20] = ids[_META]
        scores = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(n + 1, NONE, np.int32)
        self.merged: dict[int, int] = {}
        for name, i in ids.items():
            self.rank[i] = scores[sp.get_score(i)]
            for j in range(1, len(name)):
                if name[:j] in ids and name[j:] in ids:
                    self.merged[ids[name[:j]] << 32 | ids[name[j:]]] = i
        # hash tables without probing: what collides in one goes to the next
        self.tables, rest = [], np.array(list(self.merged), np.int64)
        while len(rest):
            key, bits = len(self.tables) + 1, max(10, (4 * len(rest)).bit_length())
            spot = self._spot(rest, key, bits)
            _, first = np.unique(spot, return_index=True)
            keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, n, np.int32)
            keys[spot[first]] = rest[first]
            values[spot[first]] = [self.merged[int(k)] for k in rest[first]]
            self.tables.append((key, bits, keys, values))
            rest = np.delete(rest, first)

    @staticmethod
    def _spot(pairs: np.ndarray, key: int, bits: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * key + 1)) & (1 << 64) - 1)
        x = pairs.astype(np.uint64)
        return (((x ^ (x >> np.uint64(23))) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of every pair; the number of pieces where there is none."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        pairs[(left < 0) | (right < 0)] = -2
        out = np.full(len(pairs), len(self.bytes), np.int32)
        for key, bits, keys, values in self.tables:
            spot = self._spot(pairs, key, bits)
            hit = keys[spot] == pairs
            out[hit] = values[spot[hit]]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _skipped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, below: np.uint64) -> np.ndarray:
    pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    return mix(mix(key ^ place.astype(np.uint64), 41) ^ pair, 42) < below


def threshold(dropout: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(dropout * 2**64)))


def agenda(model: Pieces, symbols: list[int], places: list[int], key: int, below: np.uint64) -> list[tuple[int, int]]:
    """(place, piece) of one span by a heap of candidates; -1 stands for a character without a piece."""
    n = len(symbols)
    symbols, nxt, prv = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
            m = model.merged.get(symbols[i] << 32 | symbols[j])
            if m is not None:
                heapq.heappush(heap, (int(model.rank[m]), i, symbols[i], symbols[j], m))

    for i in range(n - 1):
        offer(i)
    dead = [False] * n
    one = lambda x: np.array([x])
    while heap:
        _, i, left, right, m = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j < 0 or symbols[i] != left or symbols[j] != right:
            continue
        if below and _skipped(np.array([key], np.uint64), one(places[i]), one(left), one(right), below)[0]:
            continue
        symbols[i], dead[j], nxt[i] = m, True, nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [(places[i], symbols[i]) for i in range(n) if not dead[i]]


def _matrix(model: Pieces, symbols: np.ndarray, places: np.ndarray, keys: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of many spans of one length: final symbols, and which of them are left."""
    rows, n = symbols.shape
    sym = np.ascontiguousarray(symbols)
    if n == 1:
        return sym, np.ones((rows, 1), bool)
    merged = np.full((rows, n), len(model.bytes), np.int32)
    merged[:, :-1] = model.merge(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, n - 1)
    rank = model.rank[merged]
    nxt = np.tile(np.arange(1, n + 1, dtype=np.int32), (rows, 1))  # n: none
    prv = np.tile(np.arange(-1, n - 1, dtype=np.int32), (rows, 1))
    alive = np.ones((rows, n), bool)
    flat = [x.reshape(-1) for x in (sym, merged, rank, nxt, prv, alive)]
    sym1, merged1, rank1, nxt1, prv1, alive1 = flat
    live = np.arange(rows)
    while len(live):
        best = rank[live].argmin(axis=1) if len(live) < rows else rank.argmin(axis=1)
        at = live * n + best
        more = rank1[at] != NONE
        live, best, at = live[more], best[more], at[more]
        if not len(live):
            break
        right = live * n + nxt1[at]
        rank1_at = at
        if below:
            skip = _skipped(keys[live], places[live] + best, sym1[at], sym1[right], below)
            rank1[at[skip]] = NONE
            go = ~skip
            rank1_at, right, best, base = at[go], right[go], best[go], live[go] * n
        else:
            base = live * n
        at = rank1_at
        sym1[at] = merged1[at]
        alive1[right] = False
        rank1[right] = NONE
        after = nxt1[right]
        nxt1[at] = after
        rank1[at] = NONE
        has = after < n
        x, y = at[has], base[has] + after[has]
        prv1[y] = best[has]
        m = model.merge(sym1[x], sym1[y])
        merged1[x], rank1[x] = m, model.rank[m]
        before = prv1[at]
        has = before >= 0
        x, y = base[has] + before[has], at[has]
        m = model.merge(sym1[x], sym1[y])
        merged1[x], rank1[x] = m, model.rank[m]
    return sym, alive


def document_key(seed: int, ids: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64), 43) ^ np.uint64(seed), 44)


def encode_texts(model: Pieces, texts: list[str], ids: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts one after the other, and n + 1 offsets; an empty text has no pieces."""
    below = threshold(dropout)
    full = [" " + t if t else "" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in full])])
    code = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int32), at
    symbols = model.chars[code]
    space = code == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(starts)
    lengths = np.diff(np.append(starts, len(code)))
    doc = np.searchsorted(at, starts, "right") - 1
    keys = document_key(seed, ids)[doc]
    place = starts - at[doc]
    out, alive = symbols.copy(), np.ones(len(code), bool)
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        if n > SPAN:
            for w in which:
                lo, hi = starts[w], starts[w] + n
                alive[lo:hi] = False
                base = int(place[w])
                for p, m in agenda(model, symbols[lo:hi].tolist(), list(range(base, base + int(n))), int(keys[w]), below):
                    out[lo + p - base], alive[lo + p - base] = m, True
            continue
        cells = starts[which][:, None] + np.arange(n)
        sym, left = _matrix(model, symbols[cells], place[which], keys[which], below)
        out[cells], alive[cells] = sym, left
    kept = np.flatnonzero(alive)
    found = out[kept]
    counts = np.ones(len(kept), np.int64)
    unknown = np.flatnonzero(found < 0)
    raw = [chr(code[kept[u]]).encode() for u in unknown]
    counts[unknown] = [len(r) for r in raw]
    ends = np.cumsum(counts)
    result = np.empty(int(ends[-1]), np.int32)
    known = found >= 0
    result[(ends - counts)[known]] = found[known]
    for u, r in zip(unknown, raw):
        result[ends[u] - counts[u] : ends[u]] = model.byte_ids[list(r)]
    offsets = np.concatenate([[0], ends])[np.searchsorted(kept, at)]
    return result, offsets


def _encode(path: str, dropout: float, seed: int, columns: list[str]) -> Callable:
    def run(batches):
        model = pieces(path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                ids, turns = (part.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (0, 2))
                ids = np.where(turns > 0, mix(ids ^ mix(turns, 41).view(np.int64), 42).view(np.int64), ids)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found, offsets = encode_texts(model, texts, ids, dropout, seed)
                flat, lossless = found.tolist(), []
                for text, lo, hi in zip(texts, offsets.tolist(), offsets[1:].tolist()):
                    lossless.append(model.decode(flat[lo:hi]) == text.encode())
                yield pa.record_batch(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found)), pa.array(np.diff(offsets)), pa.array(lossless, pa.bool_()), *part.columns[3:]],
                    ["id", "pieces", "n_pieces", "lossless", *columns],
                )

    return run


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, per_copy: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, pieces, n_pieces, lossless) per row of ``docs``: the pieces of the whole text under merge dropout.

    lossless tells that decoding the pieces gave the text back (null counts as the empty text, which has no pieces).
    Repeated rows get equal pieces, or with ``per_copy`` pieces of their own, keyed by the number of the repeat; equal texts
    of different ids differ as their keys do.  A null id is keyed as -1.  An empty table gives no rows; of the other columns
    those of ``keep`` come along, and the rest are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("turn"), *keep)
    if per_copy:
        of = Window.partitionBy("id", F.xxhash64("text")).orderBy(F.lit(0))  # equal rows: any order numbers them alike
        rows = rows.withColumn("turn", F.row_number().over(of).cast("long") - 1)
    schema = "id long, pieces array<int>, n_pieces long, lossless boolean" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_encode(model, dropout, seed, list(keep)), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """(id, text) of pieces; null or empty pieces give the empty text, null elements are passed over."""

    def run(batches):
        table_ = pieces(model)
        for batch in batches:
            texts = [table_.decode([i for i in ids or () if i is not None]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text of documents, decoded again."""
    return encode(table(spark, sf_dir, "documents"))
