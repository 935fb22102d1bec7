"""Trees as JSON and back, datasets with damaged lines, the fetch ledger, and course codes by a vocabulary table."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from reqlake.functions import spans
from reqlake.operators import trees
from reqlake.sources import dataset
from reqlake.sources.ledger import Ledger

NODE = "course, path, parent, ord, depth, type, code, subject, min_level"


def drawn(rng, depth):
    """A tree in the notation and as JSON."""
    kind = rng.choice("AOCL" if depth else "CL")
    if kind == "C":
        code = f"X Y {rng.randint(100, 999)}"
        return code, {"type": "COURSE", "code": code, "external": False}
    if kind == "L":
        level = rng.choice((100, 200))
        return f"L({level} MA PH)", {"type": "LEVEL_MIN", "subject": "MA PH", "min_level": level}
    parts = [drawn(rng, depth - 1) for _ in range(rng.randint(2, 12))]
    return f"{kind}({', '.join(p for p, _ in parts)})", {"type": {"A": "AND", "O": "OR"}[kind], "children": [t for _, t in parts]}


def test_trees_go_to_json_and_back(spark):
    rng = random.Random(5)
    pairs = [(i, *drawn(rng, 4)) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in pairs], "k int, tree string")
    nodes = trees.nodes_of(rows, "k", "tree")
    text = {r.course: r.tree for r in dataset.tree_json(nodes.withColumn("external", F.lit(False))).collect()}
    assert {i: json.loads(t) for i, t in text.items()} == {i: t for i, _, t in pairs}
    read = spark.createDataFrame(list(text.items()), "k int, json string").select("k", F.parse_json("json").alias("tree"))
    back = dataset.nodes_of_json(read, "k", "tree")
    columns = NODE.split(", ")
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, nodes.select(*columns).collect()))
    assert {r.course: r.tree for r in dataset.tree_notation(back).collect()} == {i: t for i, t, _ in pairs}


def test_odd_trees(spark):
    odd = {
        1: '{"type":"AND","children":[]}', 2: '{"type":"XOR","children":[{"type":"COURSE","code":"A 1"}]}', 3: '"A 1"', 4: "null", 5: '{"type":"OR","children":{"type":"COURSE"}}',
        6: '{"type":"LEVEL_MIN","subject":"A","min_level":"high"}', 7: None, 8: '{"\\u0063hildren":[{"type":"COURSE","code":"a[b"}],"type":"OR"}',
    }
    rows = spark.createDataFrame(list(odd.items()), "k int, j string").select("k", F.parse_json("j").alias("tree"))
    out = {(r.course, r.path): (r.type, r.code, r.min_level) for r in dataset.nodes_of_json(rows, "k", "tree").collect()}
    assert out == {
        (1, "r"): ("AND", None, None), (2, "r"): ("XOR", None, None), (2, "r.0"): ("COURSE", "A 1", None), (3, "r"): (None, None, None), (5, "r"): ("OR", None, None),
        (6, "r"): ("LEVEL_MIN", None, None), (8, "r"): ("OR", None, None), (8, "r.0"): ("COURSE", "a[b", None),
    }
    empty = spark.createDataFrame([], "k int, tree string")
    assert dataset.tree_json(trees.nodes_of(empty, "k", "tree").withColumn("external", F.lit(None).cast("boolean"))).collect() == []
    childless = dataset.nodes_of_json(rows.where("k = 1"), "k", "tree")
    assert [r.tree for r in dataset.tree_json(childless).collect()] == ['{"type":"AND","children":[]}']


def test_lines_are_counted_in_one_reading(spark, tmp_path):
    (tmp_path / "courses").mkdir()
    (tmp_path / "courses" / "part.json").write_text('{"code":"A 1"}\n{"code":"A 2","level":"high"}\n{"level":103}\n   \n{"code":"A 3"}')
    counts = dataset.line_counts(spark, str(tmp_path))
    assert tuple(counts.first()) == (2, 2)
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1


def test_damaged_lines_are_listed(spark, tmp_path):
    lines = [
        '{"code":"A 1","level":101,"prerequisite_tree":{"type":"COURSE","code":"B 2"},"more":1}', '{"code":"A 2","level":"high"}', '{"code":"A 3","notes":["x"', '{"level":103}', "   ",
        '["A 5"]', '{"code":"A 6","notes":["x",null],"corequisite_tree":null}',
    ]
    (tmp_path / "courses").mkdir()
    (tmp_path / "courses" / "part.json").write_text("\n".join(lines))
    courses, damaged = dataset.read_dataset(spark, str(tmp_path))
    assert sorted(r.code for r in courses.collect()) == ["A 1", "A 6"]
    assert sorted(r.line for r in damaged.collect()) == sorted([lines[1], lines[2], lines[3], lines[5]])
    assert [r.code for r in dataset.nodes_of_json(courses, "code", "prerequisite_tree").collect()] == ["B 2"]
    assert dataset.nodes_of_json(courses, "code", "corequisite_tree").collect() == []


@pytest.fixture
def site(spark):
    def at(answers):
        table = spark.createDataFrame(list(answers.items()), "key string, said string")
        bad = F.col("said").startswith("!")
        return lambda wanted: wanted.select("key").join(table, "key").select("key", F.when(bad, F.col("said")).alias("error"), F.when(~bad, F.col("said")).alias("body"))

    return at


def test_ledger(spark, site, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "attempts"))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "key string")
    assert ledger.landed().collect() == [] and sorted(r.key for r in ledger.pending(wanted).collect()) == ["a", "b", "c"]
    ledger.run(1, wanted, site({"a": "one", "b": "!late", "c": "!gone"}))
    assert sorted(r.key for r in ledger.pending(wanted).collect()) == ["b", "c"]
    for _ in range(2):  # a run that is repeated replaces itself and loses nothing
        ledger.run(2, wanted, site({"a": "never asked", "b": "two", "c": "!gone"}))
    ledger.run(3, wanted, site({"a": "!busy", "b": "three", "c": "!lost"}), F.col("key").isin("a", "b"))
    assert sorted(map(tuple, ledger.landed().collect())) == [("a", 1, "one"), ("b", 3, "three")]
    assert sorted(map(tuple, ledger.states().collect())) == [("a", "landed", 1, 2, 1, "!busy"), ("b", "landed", 3, 3, 1, "!late"), ("c", "failed", None, 3, 3, "!lost")]
    assert [r.key for r in ledger.pending(wanted).collect()] == ["c"]
    with pytest.raises(ValueError, match="from 1"):
        ledger.run(0, wanted, site({}))


def test_codes_by_a_vocabulary_table(spark):
    text = "Take E E 380 or MA PH  MA PH 251, then Math 101 and CMPUT 1234, CMPUT 20, xCMPUT 301; don't take PH 451AB or E E\n380."
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing known")], "k int, t string")
    subjects = spark.createDataFrame([("E E",), ("MA PH",), ("PH",), ("CMPUT",), ("CMPUT",), (None,)], "name string")
    found = spans.code_spans(rows, "k", "t", subjects)
    cut = rows.select(F.col("k").alias("key"), spans.tokens(F.col("t")).alias("tok"))
    said = found.join(cut, "key").select("first", F.array_join(F.slice("tok", F.col("first") + 1, F.col("last") - F.col("first") + 1), "").alias("s")).orderBy("first")
    assert [r.s for r in said.collect()] == ["E E 380", "MA PH 251", "CMPUT 20", "PH 451AB", "E E\n380"]
    words = spans.words_outside(rows, "k", "t", found)
    assert sorted(r.word for r in words.where("key = 1").collect()) == sorted("take or ma ph then math and cmput xcmput don't take or".split())
    assert sorted(r.word for r in words.where("key <> 1").collect()) == ["known", "nothing"]


def test_a_vocabulary_of_100_000_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("S"), F.translate(F.col("id").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("name"))
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("Needs S"), F.translate((F.col("id") * 997 % 120_000).cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" 201.")).alias("t"))
    found = spans.code_spans(rows, "k", "t", names)
    assert sorted(r.key for r in found.collect()) == [k for k in range(200) if k * 997 % 120_000 < 100_000]
