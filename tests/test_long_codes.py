"""Catalogues of more than 900 courses a subject, whose numbers have four digits and more, pages that share a URL, and pairs that are asked for."""

import pytest
from pyspark.sql import functions as F

from reqlake.functions import codes
from reqlake.operators import graph, outliers, trees
from reqlake.plans import grammar
from reqlake.queries import dataset, eligibility, text
from reqlake.sources import catalogue, pages
from reqlake.storage import Scratch

VOCABULARY = grammar.Vocabulary(("SUBA", "SUBB"))


def test_long_numbers_in_requirement_text(spark):
    said = [("Prerequisites: one of SUBA 1001 or 1002, and SUBB 48099.", "A(O(SUBA 1001, SUBA 1002), SUBB 48099)", "parsed"), ("Prerequisite: SUBA 101 or any 300-level course.", "O(SUBA 101, L(300 SUBB))", "partial")]
    rows = spark.createDataFrame([(i, s[0], "SUBB") for i, s in enumerate(said)], "k int, t string, home string")
    got = {r.k: (r.tree, r.parse_status) for r in grammar.parse(rows, "k", "t", "home", VOCABULARY).collect()}
    assert got == {i: s[1:] for i, s in enumerate(said)}
    text = F.lit("Credit cannot be obtained for both SUBA 1001 and SUBB 48099.")
    assert spark.range(1).select(grammar.credit_exclusions(text, F.lit("SUBA 1001"), F.lit("SUBA"), VOCABULARY)).first()[0] == ["SUBB 48099"]
    unknown = outliers.unknown_codes(rows, "k", "t", ("SUBA",)).collect()
    assert [(r.key, r.finding) for r in unknown] == [(0, "SUBB")]


def test_long_numbers_in_headings(spark):
    page = spark.createDataFrame([("https://catalogue.example.org/catalogue/course/suba/48099", "<h1>SUBA 48099 - Large</h1>")], "url string, html string")
    row = pages.course_fields(page).first()
    assert (row.code, row.number, row.title) == ("SUBA 48099", "48099", "Large")


def test_level_of_long_numbers(spark):
    rows = spark.createDataFrame([("SUBA 999",), ("SUBA 1234",), ("SUBA 48099",), ("MATH 30-1",), ("MAPH 451AB",)], "c string")
    assert [r[0] for r in rows.select(codes.level_of(F.col("c"))).collect()] == [999, 123, 4809, 0, 451]


def test_no_level_is_met_by_a_long_number(spark, tmp_path):
    part = [(pk, "p") for pk in (0, 2500, 22_500, 25_000)]  # SUBA 100, 200, 1000, 1100
    spark.createDataFrame(part, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 22_500, 1), (1, 2500, 2), (2, 25_000, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, eligibility.level_min_match(spark, str(tmp_path)).collect()))
    assert got == [(7, "SUBA", 100, "SUBA 200"), (7, "SUBA", 200, "SUBA 200")]


@pytest.fixture(scope="module")
def long_catalogue(spark, tmp_path_factory):
    """SUBU 1000 needs SUBP 101 and excludes SUBV 1000, which SUBC 1900 needs."""
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(pk, "p") for pk in (40, 22_520, 22_521, 45_002)], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    lines = [(1, 22_520, 1), (1, 40, 2), (2, 45_002, 1), (2, 22_521, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_long_numbers_in_excluding_sentences(spark, long_catalogue):
    assert [tuple(r) for r in text.negation_strip(spark, long_catalogue).collect()] == [("SUBU 1000", "SUBP 101", "SUBU 1000,SUBV 1000")]


def test_long_numbers_of_unknown_subjects(spark, long_catalogue):
    assert [tuple(r) for r in text.outlier_codes(spark, long_catalogue).collect()] == [("SUBV", 1, "SUBC 1900")]


@pytest.fixture
def shared_urls(spark, tmp_path):
    rows = [(1, "u", "ab"), (3, "u", "abc"), (24, "v", "x"), (5, None, "y"), (6, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_pages_that_share_a_url_are_fetched_each(spark, shared_urls):
    states = sorted((r.key or "", r.status, r.attempts, r.n_chars or 0) for r in dataset.fetch_ledger(spark, shared_urls).collect())
    again = 1 + len(dataset.TOLD)
    assert states == [("", "landed", 2, again), ("u", "failed", 3, 0), ("u", "landed", 1, 2), ("v", "failed", 3, 0), ("w", "landed", 1, 0)]
    assert sorted(map(tuple, dataset.fetch_pending(spark, shared_urls).collect())) == [(3, "u"), (24, "v")]


def test_only_asked_pairs_are_judged(spark):
    rows = spark.createDataFrame([("SUBA 1", "L(200 SUBB)"), ("SUBA 2", "O(SUBB 300, SUBB 400)"), ("SUBA 3", "A(SUBB 300, L(500 SUBB))")], "code string, tree string")
    nodes = trees.nodes_of(rows, "code", "tree")
    taken = spark.createDataFrame([(s, "SUBB 300") for s in range(50)], "student long, code string")
    asked = spark.createDataFrame([(1, "SUBA 1"), (2, "SUBA 2"), (3, "SUBA 3"), (99, "SUBA 1")], "student long, course string")
    assert sorted(map(tuple, trees.satisfied_courses(nodes, taken, pairs=asked).collect())) == [(1, "SUBA 1"), (2, "SUBA 2")]
    assert trees.satisfied_leaves(nodes, taken, asked).count() == 3  # and not 50 students times the leaves that each meets


def test_capped_courses_keep_a_row_a_course(spark):
    layers = [(i * 10 + a, i * 10 + 10 + b) for i in range(14) for a in range(4) for b in range(4)]  # 4 ** 14 chains
    scratch = Scratch(spark, "test")
    out = graph.capped_courses(spark.createDataFrame(layers, "p long, q long"), scratch)
    assert {r.course for r in out.collect()} == {i * 10 + a for i in range(2) for a in range(4)}
    assert spark.read.parquet(f"{scratch.root}/capped-4").columns == ["p"]


def test_partitions_of_orders_keep_their_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(pk, "p") for pk in range(16)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, (o * k) % 17, k) for o in range(40) for k in (1, 3, 5, 7, 7)] + [(None, 1, 1), (None, 15, 2), (41, None, 1)]  # part 16 is not in the catalogue
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalogue, "LINES", 10)
    found = catalogue.edges(spark, str(tmp_path))
    pairs = {(p, q) for o, p, _ in lines for r, q, _ in lines if o == r and None not in (o, p, q) and p < 16 and q // 2 < p // 2}
    order = {p: sorted((q for a, q in pairs if a == p), key=lambda q: ((q * 7919 + p * 31) % 10007, q))[:4] for p, _ in pairs}
    assert sorted(map(tuple, found.collect())) == sorted((p, q, i + 1, i // 2) for p, qs in order.items() for i, q in enumerate(qs))
    shuffles = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
    parts = (len(lines) - 2) // catalogue.LINES + spark.sparkContext.defaultParallelism
    assert len(shuffles) == 2 and all(f"], {parts}" in x for x in shuffles)


def test_levels_that_meet_trees_alone(spark, monkeypatch):
    said = {
        "1": "O(SUBA 101, L(300 SUBB))", "2": "A(O(SUBA 101, SUBA 102), L(200 SUBB))", "3": "A(L(200 SUBB), O(L(300 SUBB), SUBA 101))", "4": "O(L(300 SUBB), L(200 SUBA))", "5": "A(L(200 SUBB), L(200 SUBA))",
        "6": "L(400 SUBB)", "7": "SUBA 101", "8": "O(SUBA 101, A(SUBA 102, L(200 SUBB)))", "9": "O(A(L(400 SUBB), SUBA 101), A(L(200 SUBB), L(300 SUBB)))",
    }
    nodes = trees.nodes_of(spark.createDataFrame(list(said.items()), "code string, tree string"), "code", "tree")
    held = ("SUBA 101", "SUBA 102", "SUBA 250", "SUBB 210", "SUBB 310", "SUBB 4100")
    taken = spark.createDataFrame([(s, c) for s in range(64) for i, c in enumerate(held) if s >> i & 1], "student long, code string")
    needs, mixed = trees.level_needs(nodes)
    assert sorted(map(tuple, needs.collect())) == [("1", "SUBB", 300), ("3", "SUBB", 300), ("6", "SUBB", 400), ("9", "SUBB", 300)]
    assert {r.course for r in mixed.collect()} == {"4", "5"}
    monkeypatch.setattr(trees, "PAIRS", 7)
    monkeypatch.setattr(trees, "BLOCK", 1)
    alone = trees.level_pairs(needs, trees.best_levels(taken), Scratch(spark, "test"))
    got = [tuple(r) for r in alone.select("student", "course").union(trees.satisfied_otherwise(nodes, taken, needs, mixed)).collect()]
    assert sorted(got) == sorted(map(tuple, trees.satisfied_courses(nodes, taken).collect())) and len(got) > 200
    plan = alone._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")  # pairs are made behind every shuffle
    assert len(plan) == 2 and "Join" not in plan[0] and "Repartition" not in plan[0] and "Aggregate" not in plan[0]
