"""Stage by stage: what each keeps of its own input, and its columns."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from reqlake.llm import ngram_join

from .test_operators import LOWER, brute_components, documents, words


def test_stages_do_what_they_say(spark):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}", len(t or "")) for i, t in documents(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece_dropout"]

    told = stages["language_id"](spark, docs, "")
    kept = {r.doc_id for r in told.collect()}
    assert kept <= {i for i, t, *_ in rows if t and t.strip()}  # labels are random here: test_operators measures accuracy
    exact = stages["exact_dedup"](spark, docs, "")
    last: dict = {}
    for i, t, *_ in rows:
        last[(t or "").encode().translate(LOWER)] = i
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    near = stages["ngram_jaccard_join"](spark, docs, "")
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in brute_components([r[:2] for r in rows], 5, 4, 5).items() if i == c}
    mixed = stages["source_mixing"](spark, docs, "")
    total = sum(len(words(t)) for _, t, *_ in rows)
    taken = sum(len(words(r.text)) for r in mixed.collect())
    assert abs(taken - 1.5 * total) <= 4 * max(len(words(t)) for _, t, *_ in rows)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    for stage in (told, exact, near, mixed):
        assert stage.columns == docs.columns
    last_stage = stages["sentencepiece_dropout"](spark, docs, "")
    assert last_stage.columns == ["doc_id", "pieces", "n_pieces", "lossless", "lang", "source"]
    assert last_stage.where("not lossless").count() == 0 and last_stage.count() == len(rows)


def test_near_stage_keeps_null_ids_and_each_text_of_an_id(spark):
    prose = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(4)]
    near = [f"{t} more" for t in prose]
    rows = [(1, prose[0]), (3, prose[1]), (3, near[0]), (4, near[1]), (None, prose[2]), (None, near[2]), (None, near[1]), (None, prose[3]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "").collect()}
    assert len(out & {(None, prose[2]), (None, near[2])}) == 1
    assert out - {(None, prose[2]), (None, near[2])} == {(1, prose[0]), (3, prose[1]), (None, prose[3]), (None, None)}
    found = ngram_join.ngram_components(docs, null_ids=True).collect()
    ids = sorted((r.doc_id or 0, r.component_id or 0) for r in found)
    assert ids == [(0, 0), (0, 0), (0, 0), (0, 0), (0, 3), (1, 1), (3, 1), (3, 3), (4, 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows():
    """Nulls in every column, empties, a very long text, ties, repeated rows and ids of several texts."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "water", "stone", "under", "light", "green", "river", "house"]) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))
    rows = [(i, prose(rng.randint(5, 90)), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, prose(6000), None, "s1", 1), (None, prose(50), "en", "s1", 1), (None, None, None, None, None)]
    rows += [rows[3]] * 3 + [rows[43]] * 2 + [(5, prose(70), "fr", "s0", 2), (200, rows[4][1].upper(), None, "s0", 1)]
    return rows


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows_and_empty_tables(spark, name):
    stage, rows = dict(corpus_pipeline.STAGES)[name], hard_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    for extra in ("_id", "_digest", "_sha", "id", "row", "copies", "label", "_lang"):  # names the operators use themselves
        docs = docs.withColumn(extra, F.lit("clash"))
    out = stage(spark, docs, "")
    found = out.collect()
    assert stage(spark, docs.limit(0), "").count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and {(r.doc_id, r.text) for r in found} <= {(r[0], r[1]) for r in rows}
    else:
        assert len(found) == len(rows) and all(r.lossless for r in found)


def test_copies_of_a_document_get_pieces_of_their_own(spark):
    text = "international organization of independent implementations " * 20
    docs = spark.createDataFrame([(1, text, "en", "s", 1)] * 3 + [(2, text, "en", "s", 1)], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["sentencepiece_dropout"]
    out, again = (sorted((r.doc_id, r.pieces) for r in stage(spark, d, "").collect()) for d in (docs, docs.repartition(3)))
    assert len({tuple(p) for _, p in out}) == 4 and out == again


def test_run_applies_the_stages_to_the_documents(spark, tmp_path):
    rows = hard_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
    expected = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) > 20 and sorted(map(repr, out)) == sorted(map(repr, expected))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
