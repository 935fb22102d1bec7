"""Plans over nested trees, guards as sets, and cycles in few rounds, on small hand-made graphs."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from reqlake.operators import graph, tree_plans, trees
from reqlake.storage import Scratch

# A small catalogue with levels, courses of elsewhere and cycles, trees by code; then targets, completed courses and what is left
MINI = {
    "CMPUT 174": None, "CMPUT 274": None, "CMPUT 175": "O(CMPUT 174, ENCMP 100)", "CMPUT 201": "CMPUT 175", "CMPUT 275": "CMPUT 274", "CMPUT 301": "O(CMPUT 201, CMPUT 275)",
    "CMPUT 229": "O(CMPUT 201, CMPUT 275)", "CMPUT 415": "A(O(CMPUT 229, E E 380, ECE 212), L(300 CMPUT))", "CMPUT 900": "CMPUT 901", "CMPUT 901": "CMPUT 900", "CMPUT 902": "CMPUT 902",
    "DEEP 1": "A(O(A(CMPUT 175, L(200 MATH)), A(O(CMPUT 201, CMPUT 275), CMPUT 174)), CMPUT 174)",
    "LOST 1": "O(CMPUT 902, A(CMPUT 174, CMPUT 274))", **{f"LONG {i}": f"LONG {i + 1}" for i in range(100, 116)}, "LONG 116": None,
}
CASES = [
    ("CMPUT 301", "", "CMPUT 274, CMPUT 275", {"r": "CMPUT 174, CMPUT 175, CMPUT 201 | CMPUT 274, CMPUT 275"}, ""), ("CMPUT 301", "CMPUT 201", None, {"r": "CMPUT 274, CMPUT 275"}, ""),
    ("CMPUT 415", "CMPUT 229", "CMPUT 300+", {"r.0": "E E 380 | ECE 212"}, ""), ("CMPUT 415", "CMPUT 229, CMPUT 301", None, {"r.0": "E E 380 | ECE 212"}, ""),
    ("CMPUT 415", "CMPUT 229, CMPUT 201", "CMPUT 300+", {"r.0": "E E 380 | ECE 212"}, ""), ("CMPUT 415", "CMPUT 229, MATH 314", "CMPUT 300+", {"r.0": "E E 380 | ECE 212"}, ""),
    ("CMPUT 415", "", "E E 380, CMPUT 300+", {"r.0": "CMPUT 274, CMPUT 275, CMPUT 229 | E E 380 | ECE 212"}, ""), ("CMPUT 175", "", "CMPUT 174", {"r": "CMPUT 174 | ENCMP 100"}, ""),
    ("CMPUT 175", "ENCMP 100", None, {"r": "CMPUT 174"}, ""), ("CMPUT 174", "", None, {}, ""), ("CMPUT 900", "", "CMPUT 901, CMPUT 900", {}, "cycle at CMPUT 901"),
    ("CMPUT 902", "", "CMPUT 902", {}, "cycle at CMPUT 902"),
    ("DEEP 1", "CMPUT 174", "CMPUT 175, MATH 200+", {"r.0": "CMPUT 175, MATH 200+ | CMPUT 175, CMPUT 201", "r.0.1.0": "CMPUT 175, CMPUT 201 | CMPUT 274, CMPUT 275"}, ""),
    ("DEEP 1", "CMPUT 275, CMPUT 174", None, {"r.0": "CMPUT 175, MATH 200+", "r.0.1.0": "CMPUT 175, CMPUT 201"}, ""),
    ("LOST 1", "", "CMPUT 902", {"r": "CMPUT 902 | CMPUT 174, CMPUT 274"}, "cycle at CMPUT 902"),
    ("LONG 100", "", ", ".join(f"LONG {i}" for i in range(113, 100, -1)), {}, "chain cut at LONG 113"), ("LONG 106", "", ", ".join(f"LONG {i}" for i in range(116, 106, -1)), {}, ""),
]


def said(steps):
    return ", ".join(k.removeprefix("course:") if k.startswith("course:") else k.removeprefix("level:").replace(":", " ") + "+" for k in steps)


def catalogue(spark, trees_by_code):
    rows = spark.createDataFrame(list(trees_by_code.items()), "code string, tree string")
    return rows.select("code"), trees.nodes_of(rows, "code", "tree")


def test_plans_over_nested_trees(spark):
    courses, nodes = catalogue(spark, MINI)
    odd = spark.createDataFrame([("ODD 1", "r", None, 0, 0, "OR", None), ("ODD 1", "r.0", "r", 0, 1, "XOR", None), ("ODD 1", "r.1", "r", 1, 1, "COURSE", "CMPUT 175")], "course string, path string, parent string, ord int, depth int, type string, code string")
    nodes = nodes.unionByName(odd, allowMissingColumns=True)
    courses = courses.union(odd.select("course"))
    cases = [*CASES, ("ODD 1", "", "CMPUT 174, CMPUT 175", {"r": "CMPUT 174, CMPUT 175"}, "node type XOR")]
    targets = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(99, "CMPUT 999")], "student long, course string")
    done = [(i, d.strip()) for i, c in enumerate(cases) for d in c[1].split(",") if d]
    taken, scratch = spark.createDataFrame(done, "student long, code string"), Scratch(spark, "test")
    members = scratch.save(graph.cycle_members(tree_plans.needs(nodes, courses), scratch), "cycles")
    got = {r.student: r for r in tree_plans.tree_plans(targets, nodes, courses, taken, members, scratch).collect()}
    assert got[99].found is False and got[99].satisfied is None and got[99].remaining is None
    for i, (target, have, remaining, choices, errors) in enumerate(cases):
        r = got[i]
        assert (r.satisfied, said(r.remaining)) == (remaining is None, remaining or ""), target
        assert {a.path: " | ".join(map(said, a.plans)) for a in r.alternatives} == choices, (target, have)
        assert "|".join(r.errors) == errors, target
    # completing a plan satisfies its course, by the evaluator of trees
    after = taken.union(spark.createDataFrame([(i, k) for i, r in got.items() for k in r.remaining or ()], "student long, k string").select("student", tree_plans.completing(F.col("k"))))
    met = {(r.student, r.course) for r in trees.satisfied_courses(nodes, after.distinct()).collect()}
    assert all((i, c[0]) in met for i, c in enumerate(cases) if MINI.get(c[0]))


def test_guards_are_sets_in_a_dense_component(spark):
    """In a complete graph of six courses there are as many rows as sets of visited courses and their last course."""
    rows = [(p, q) for p, q in itertools.permutations(range(6), 2)]
    edges, scratch = spark.createDataFrame(rows, "p long, q long"), Scratch(spark, "test")
    members = scratch.save(graph.cycle_members(edges, scratch), "cycles")
    got = {(r.root, r.node, r.hop): r.n_paths for r in graph.chain_expand(edges, scratch, 6, members).collect()}
    want: dict = {}
    paths = [(p, (q,)) for p, q in rows]
    sets = set()
    while paths:
        for root, path in paths:
            sets.add((root, frozenset(path), path[-1]))
            want[root, path[-1], len(path) - 1] = want.get((root, path[-1], len(path) - 1), 0) + 1
        paths = [(root, (*path, q)) for root, path in paths for p, q in rows if p == path[-1] and q not in path]
    assert got == want
    written = sum(spark.read.parquet(f"{scratch.root}/hops-{h}").count() for h in (0, 4))
    assert written == len(sets)


def strong(edges):
    """(node: least node of its component, size) of nodes on a cycle, by reachability."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    reach = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after[b]
        reach[a] = seen
    groups = {a: [b for b in r if a in reach[b]] for a, r in reach.items() if a in r}
    return {a: (min(g), len(g)) for a, g in groups.items()}


def test_components_of_two_way_chains_ladders_and_rings(spark, monkeypatch):
    """Each shape far longer than the rounds it takes; all are one graph, so that one search answers."""
    rng = random.Random(4)
    two_way = [e for i in range(250) for e in ((i, i + 1), (i + 1, i))]
    ladder = [e for i in range(60) for e in ((1000 + i, 1001 + i), (1000 + i, 2001 + i), (2000 + i, 1001 + i), (2000 + i, 2001 + i))]
    ring = [(3000 + i, 3000 + (i + 1) % 90) for i in range(90)] + [(3010, 3050), (3020, 3020)]
    pairs = [e for i in range(4000, 4080, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    loose = [(5000 + rng.randrange(60), 5000 + rng.randrange(60)) for _ in range(90)]
    edges = two_way + ladder + ring + pairs + loose + [(100, 1000), (1060, 3000), (3005, 4000), (4080, 5001)]
    saves = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saves.append(name) or save(self, df, name))
    out = graph.cycle_members(spark.createDataFrame(edges, "p long, q long"), Scratch(spark, "test")).collect()
    assert {r.node: (r.cycle, r.members) for r in out} == strong(edges)
    assert len(saves) < 60


def test_long_paths_reach_their_targets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHORT", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 60), (60, 501), (700, 701)], "p long, q long")
    targets = spark.createDataFrame([(80,), (701,), (900,)], "node long")
    scratch = Scratch(spark, "test")
    found = {r.node for r in graph.reaching(edges, targets, scratch).collect()}
    assert found == {*range(81), 500, 700, 701, 900}
    assert list(Path(scratch.root.removeprefix("file:")).glob("reaching-taken-*"))
