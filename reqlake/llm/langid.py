"""Language identification by compression: the language whose zstandard raw-content dictionary shortens a text most.

The whole lower-cased text is encoded, block by block, once per language with that language's dictionary; the languages'
sizes are summed over the blocks.  The smallest sum names the language; its relative margin to the next is the score, and
a narrow margin rejects the text.  Independent blocks let the dictionary count alike at a text's start and end, and every
block is encoded several times in a row, because zstandard stores a block raw, whatever the dictionary, where too few bytes
repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE_DOCS = 110  #: distinct labelled texts a language that training reads, about: those of the smallest keyed hashes
PASSAGE_CHARS = 1_000  #: all passages of those documents, of so many characters each, make the dictionary
BLOCK_BYTES, COPIES = 4_096, 4  #: of a text: bytes encoded at once, and how many times in a row
NARROW = 0.004  #: relative margin below which a text is rejected
HELD_OUT_MOD = 5


def held_out(id_column: Column) -> Column:
    """True for the fifth of ids that training never sees; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % HELD_OUT_MOD == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, the language of most distinct labelled texts first.

    It is learned from a bounded sample of texts, about SAMPLE_DOCS a language, of which every passage is used; those passages
    are all that comes to the driver.  Texts are drawn, not ids, so neither many rows of an id nor many copies of a text
    change how much is learned.  Equal passages count once, and a label goes with its own row's text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"))
    rows = rows.where("id is not null and lang is not null").where(~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()  # a row a language
    if not counts:
        return {}
    scale = 1 << 31
    shares = docs.sparkSession.createDataFrame([(r.lang, min(scale, SAMPLE_DOCS * scale // max(1, r.n))) for r in counts], "lang string, share long")
    chosen = rows.where("text <> ''").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit("langid"), F.col("text")), F.lit(scale)) < F.col("share"))
    passages = chosen.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("passage")).distinct()
    content: dict[str, list[str]] = {r.lang: [] for r in sorted(counts, key=lambda r: (-r.n, r.lang))}
    for r in sorted(passages.withColumn("hash", F.xxhash64("passage")).collect(), key=lambda r: (r.hash, r.passage)):
        content[r.lang].append(r.passage)
    return {lang: "\n".join(parts).encode("utf-8", "replace") for lang, parts in content.items()}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in dictionaries.items():
        # short matches count as evidence, so the least match is 4 bytes; greedy search keeps it fast
        parameters = zstandard.ZstdCompressionParameters.from_level(
            6, dict_size=len(content), source_size=BLOCK_BYTES, min_match=4, strategy=zstandard.STRATEGY_GREEDY, search_log=2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        if len(content) < 8:
            made.append((lang, zstandard.ZstdCompressor(compression_params=parameters)))
            continue
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        made.append((lang, zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)))
    return made


def classify(text: str | None, made: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text; ties go to the language of more distinct training texts."""
    if not made or not any(map(str.isalpha, text or "")):
        return "und", 0.0, True
    data, sizes = text.lower().encode("utf-8", "replace"), [0] * len(made)
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES] * COPIES
        for i, (_, compressor) in enumerate(made):
            sizes[i] += len(compressor.compress(block))
    order = sorted(range(len(made)), key=lambda i: (sizes[i], i))
    margin = 1.0 - sizes[order[0]] / sizes[order[1]] if len(made) > 1 else 1.0
    return made[order[0]][0], margin, margin < NARROW


def _predict(dictionaries) -> Callable:
    def run(batches):
        made = compressors(dictionaries.value)
        for batch in batches:
            found = [classify(x.as_py(), made) for x in batch.column(2)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) per row of ``docs``, learned from its labelled rows not held out.

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text where no row is labelled.
    With one language learned, every other text is that language at score 1.  Repeated rows are predicted alike; other
    columns are not read; an empty table gives no rows.
    """
    dictionaries = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predict(dictionaries), "id long, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever their names.

    Texts that are null or have no letter go, and so do all where no row is labelled; repeated rows stay or go together.
    """
    dictionaries = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches):
        made = compressors(dictionaries.value)
        for batch in batches:
            yield batch.filter(pa.array([not classify(x.as_py(), made)[2] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    return identify(table(spark, sf_dir, "documents"))
