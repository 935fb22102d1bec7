"""Work that must be done once, however often a plan reads its result."""

from __future__ import annotations

from itertools import groupby

import pytest
from pyspark.sql import functions as F

from reqlake.operators import graph, outliers, trees
from reqlake.queries import building, dataset, text
from reqlake.sources import catalogue
from reqlake.storage import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [text.coverage_audit, text.negation_strip])
def test_texts_are_written_once(spark, query):
    """What is read from texts is joined to them, and the edges behind the texts are not found again for that."""
    assert not [f for f in query(spark, SF).inputFiles() if "lineitem" in f]


def test_a_hop_shuffles_trees_and_not_their_nodes(spark, monkeypatch):
    """A tree of a thousand options is one row of what a hop meets students' transcripts with."""
    edges = spark.range(1000).select(F.lit(5000).cast("long").alias("p"), F.col("id").alias("q"), F.col("id").alias("rn"), F.lit(0).alias("grp"), F.lit(False).alias("external"))
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    scratch = Scratch(spark, "test")
    targets, taken = spark.createDataFrame([(1, 5000), (2, 5000), (3, 5000)], "student long, course long"), spark.createDataFrame([(1, 7), (2, 5001)], "student long, pk long")
    members = spark.createDataFrame([], "node long, cycle long, members long")
    got = {r.student: r.remaining for r in graph.student_plans(targets, edges, taken, members, scratch).collect()}
    assert got == {1: [], 2: [0], 3: [0]}
    assert saved["tree-steps"].count() == 1 and saved["tree-taken"].count() == 2


def _shuffles(df, column):
    """How often a plan shuffles rows by a key that begins with the column."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({column}#")


def test_a_hop_shuffles_paths_once(spark, monkeypatch):
    """Paths are merged where they meet the next step, and only those of cyclic components are merged once more."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (1, 5)], "p long, q long")
    members = spark.createDataFrame([(2, 2, 2), (3, 2, 2)], "node long, cycle long, members long")
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: save(self, plans.setdefault(name, df), name))
    out = graph.chain_expand(edges, Scratch(spark, "test"), 4, members)
    assert _shuffles(plans["hops-0"], "root") == 0
    assert _shuffles(out, "root") == 1 and "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    found = {(1, 2, 0), (1, 5, 0), (1, 3, 1), (1, 4, 2), (1, 5, 3), (2, 3, 0), (2, 2, 1), (2, 4, 1), (2, 5, 2), (3, 2, 0), (3, 4, 0), (3, 3, 1), (3, 5, 1), (3, 4, 2), (3, 5, 3), (4, 5, 0)}
    assert {tuple(r)[:3] for r in out.collect()} == found


def test_outliers_read_written_texts(spark, monkeypatch):
    """Findings are read twice (sketch and recount), and the edges behind the texts are not found again for that."""
    read, ranked = [], outliers.ranked
    monkeypatch.setattr(outliers, "ranked", lambda findings, limit: read.append(findings.inputFiles()) or ranked(findings, limit))
    for query in (text.outlier_codes, text.outlier_labels):
        query(spark, SF)
    assert len(read) == 2 and not [f for files in read for f in files if "lineitem" in f]


def test_pairs_of_levels_repeat_themselves(spark):
    """A deal's pairs are of one subject after the other, with a block's courses in one order for each student, so that they take little room."""
    needs = spark.range(60).select(F.format_string("C%d", "id").alias("course"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("subject"), F.lit(300).alias("need"))
    best = spark.range(120).select((F.col("id") % 40).alias("student"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("subject"), F.lit(400).alias("best"))
    got = trees.level_pairs(needs, best, Scratch(spark, "test")).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == len({(r.student, r.course) for r in got}) == 40 * 60
    of = lambda r: (r.part, int(r.course[1:]) % 3)
    runs = [(k, [r.course for r in rows]) for k, rows in groupby(got, of)]
    assert len(runs) == len({k for k, _ in runs}) == 3
    assert all(courses == courses[:20] * 40 for _, courses in runs)


@pytest.mark.parametrize("query", [dataset.dataset_reread, building.dataset_counts, building.course_cards, building.report_lists])
def test_no_table_of_courses_is_broadcast(spark, monkeypatch, query):
    """However small Spark takes a written table of courses for, the driver is sent none (keys of courses only while they are few)."""
    monkeypatch.setattr(catalogue, "KEYS", 0)
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.append(df) or save(self, df, name))
    plans.append(query(spark, SF))
    assert len(plans) > 3
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]
