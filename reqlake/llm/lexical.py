"""Ranked lexical search, reversed: the items' inverted index is broadcast and every document streams through it.

There are few items and many documents, so documents are never indexed.  A first pass reads every text once and writes,
block by block, how often a document holds each term of the items (a list a document, in proportion to the input), with the
corpus counts.  A second pass over that table adds up the scores of a block's documents against all items that share a term
and updates one bounded heap per item and task; the heaps are merged in two rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .heaps import Heaps, merged
from .runs import terms

GROUP_BYTES = 16_000_000  #: of item texts whose index is broadcast at once (or one item, where that is longer)
BLOCK_CELLS = 4_000_000  #: scores of documents against items, and their summands, held at once
PARTS = ("docs", "nil", "n", "counts", "terms", "tf")
KINDS = (np.int64, bool, np.int64, np.int32, np.int32, np.int32)


class Index:
    """Items by term: ``vocabulary`` in sorted order, and for each term the items that hold it, and how often."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        found, at = terms(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = pc.unique(found)
        self.vocabulary = self.vocabulary.take(pc.sort_indices(self.vocabulary))
        term = pc.index_in(found, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.repeat(np.arange(len(items)), np.diff(at))
        pairs, self.times = np.unique(term * max(len(items), 1) + item, return_counts=True)
        self.items = pairs % max(len(items), 1)
        self.at = np.searchsorted(pairs // max(len(items), 1), np.arange(len(self.vocabulary) + 1))


def _postings(vocabulary: pa.Array) -> Callable:
    """Rows (doc_id, text) to blocks of term counts: of documents that hold a term of the items, and the block's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                found, at = terms(part.column(1))
                n = np.diff(at)
                term = pc.fill_null(pc.index_in(found, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), n)[term >= 0]
                pairs, tf = np.unique(doc * len(vocabulary) + term[term >= 0], return_counts=True)
                counts = np.bincount(pairs // len(vocabulary), minlength=len(part)) if len(vocabulary) else np.zeros(len(part), np.int64)
                held = np.flatnonzero(counts)
                ids = part.column(0)
                values = (ids.fill_null(0).to_numpy()[held], ids.is_null().to_numpy(zero_copy_only=False)[held], n[held], counts[held], pairs % max(len(vocabulary), 1), tf)
                binaries = [pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for v, kind in zip(values, KINDS)]
                yield pa.record_batch([*binaries, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], [*PARTS, "n_docs", "n_terms"])

    return run


def _frequencies(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for block in batch.column(0):
                df += np.bincount(np.frombuffer(block.as_py(), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], ["term", "df"])

    return run


def _scores(asked, total_docs: int, total_terms: int, k: int) -> Callable:
    """Blocks of term counts to (item, doc_id, score): the best k of every item among the documents of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = asked.value
        n_items = len(index.ids)
        width = np.diff(index.at)
        heaps = Heaps(n_items, k, np.int64(1))
        for batch in batches:
            for row in range(len(batch)):
                docs, nil, n, counts, term, tf = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in enumerate(KINDS))
                if not len(docs):
                    continue
                first = np.append(0, np.cumsum(counts))
                m = 25 + 75 * n * total_docs // total_terms
                tf = tf.astype(np.int64)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, counts)))
                spread = np.append(0, np.cumsum(width[term]))[first]  # summands up to each document
                block = (spread[1:] + n_items * np.arange(1, len(docs) + 1)) // BLOCK_CELLS
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(docs)]
                for lo, hi in zip(cuts, cuts[1:]):
                    own = slice(first[lo], first[hi])
                    times = width[term[own]]
                    at = np.repeat(index.at[term[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    cell = np.repeat(np.repeat(np.arange(hi - lo), counts[lo:hi]) * n_items, times) + index.items[at]
                    score = np.zeros((hi - lo) * n_items, np.int64)
                    np.add.at(score, cell, np.repeat(impact[own], times) * index.times[at])
                    doc, item = np.nonzero(score.reshape(hi - lo, n_items) >= heaps.bar)
                    heaps.offer(item, score[doc * n_items + item], docs[lo:hi][doc], nil[lo:hi][doc])
        item, score, ids, nil = heaps.merge()
        yield pa.record_batch([pa.array(item), pa.array(ids, mask=nil), pa.array(score)], ["item", "doc", "score"])

    return run


def _item_groups(items: DataFrame) -> list[DataFrame]:
    """The items in groups of GROUP_BYTES of text at most, packed from small buckets of known size."""
    size = F.sum(F.octet_length("text") + 16)
    total = items.select(size).first()[0]
    if not total:
        return []
    buckets = max(1, 4 * total // GROUP_BYTES)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(buckets)))
    groups, held = [[]], 0
    for r in items.groupBy("bucket").agg(size.alias("size")).orderBy("bucket").collect():
        if held and held + r["size"] > GROUP_BYTES:
            groups, held = [*groups, []], 0
        groups[-1].append(r.bucket)
        held += r["size"]
    return [items.where(F.col("bucket").between(g[0], g[-1])) for g in groups]


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item, equal scores by rising id.

    Terms, weights and scores are as in ``op12_lexical_search``.  A null text has no terms.  Every row of ``documents`` is a
    document of its own, so repeated rows take a rank each; null ids come last among equal scores.  Items of a null id take
    no part and repeats of an item with its text count once; an item of several texts has a ranking of each.  Empty tables
    give no rows.  Every group of items reads all documents once, so scans grow with the bytes of items over GROUP_BYTES.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    documents = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    found = []
    for turn, group in enumerate(_item_groups(items)):
        index = Index([(r.item, r.text) for r in group.select("item", "text").orderBy("item", "text").collect()])
        if not len(index.vocabulary):
            continue
        kinds = ", ".join(f"{p} binary" for p in PARTS)
        postings = scratch.save(documents.mapInArrow(_postings(index.vocabulary), f"{kinds}, n_docs long, n_terms long"), f"postings-{turn}")
        n_docs, n_terms = postings.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            continue
        df = np.zeros(len(index.vocabulary), np.int64)
        for r in postings.select("terms").mapInArrow(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        ids, index.vocabulary = index.ids, None  # the second pass needs numbers only
        asked = spark.sparkContext.broadcast((index, weight))
        best = merged(postings.select(*PARTS).mapInArrow(_scores(asked, n_docs, n_terms, k), "item long, doc long, score long"), "item", "score", "doc", k)
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        found.append(scratch.save(best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), f"best-{turn}"))
        scratch.drop(f"postings-{turn}")
    out = found[0] if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item.

    Terms are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.  With N documents that have a term,
    L terms in all, n a document's terms, df a term's documents and tf its count: a term weighs w = floor(1000 ln((2N + 2) /
    (2df + 1))) and, with m = 25 + (75 n N div L), adds w (10^9 tf div (1000 tf + 8m)) each time that the item has it.
    """
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, corpus GROUP BY term, n_docs),
item AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) GROUP BY ALL),
scored AS (
  SELECT i, item_id, d.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN post USING (term) JOIN d ON d.r = post.r, corpus GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
