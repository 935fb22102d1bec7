"""Chains of requirements: expansion by hops, shortest remaining plans, cycles.

Every loop runs on the driver over hops or rounds, works on tables, and writes them so that a lost executor re-reads them.
A path may not repeat a course.  Only courses of a cycle can repeat, so a path carries those it has visited in the cyclic
component it is in, as a set in canonical order, and nothing outside of one: paths that agree in these have the same future
and are one row, whatever the order they went in.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlake.operators import tree_plans
from reqlake.storage import Scratch

MOST_HOPS = tree_plans.MOST_HOPS
HOPS_AT_ONCE = 4  #: hops of one written table
SHORT = 4  #: tables of hops that a search takes before paths count as long
STEPS = 100_000  #: edges to a partition of paths


def union_all(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _steps(edges: DataFrame, members: DataFrame | None) -> DataFrame:
    """(node, q, inside, stays): the distinct edges, see ``tree_plans.with_components``."""
    step = edges.select(F.col("p").alias("node"), "q").distinct()
    if members is None:
        return step.withColumn("inside", F.lit(None).cast("long")).withColumn("stays", F.lit(False))
    return tree_plans.with_components(step, "node", "q", members)


def chain_expand(edges: DataFrame, scratch: Scratch, most_hops: int = MOST_HOPS, members: DataFrame | None = None) -> DataFrame:
    """root, node, hop, n_paths: how many chains lead from a root to a node in so many hops, none through a course twice.

    A path begins at the root's first step, so a loop through the root is met one hop later.  ``members`` is the result of
    ``cycle_members``; without it the edges are taken to have no cycle, and no path has a guard.  Paths are counted and not
    listed, so without cycles the table stays within roots times reachable nodes times hops, and in a cyclic component
    within roots times sets of visited courses.  A hop is one shuffle of the paths: they lie by node, where they are merged
    and meet the next step.
    """
    step = scratch.save(_steps(edges, members), "steps")
    n = step.count() // STEPS + step.sparkSession.sparkContext.defaultParallelism
    key = ["root", "node"] if members is None else ["root", "node", "guard"]
    visited = [] if members is None else [tree_plans.visited(F.col("guard"), F.col("q"), F.col("inside"), F.col("stays")).alias("guard")]
    open_ = F.lit(True) if members is None else ~F.array_contains("guard", F.col("q"))
    first = edges.select(F.col("p").alias("root"), F.col("p").alias("node"), "q").join(step, ["node", "q"]).withColumn("guard", F.array().cast("array<long>"))
    first = first.withColumn("stays", F.lit(False))  # the root itself is not on its paths
    work = first.select("root", F.col("q").alias("node"), *visited).repartition(n, "node").groupBy(*key).agg(F.count("*").alias("n_paths"))
    found, hop = [], 0
    while hop < most_hops:
        tables = []
        for at in range(hop, min(hop + HOPS_AT_ONCE, most_hops)):
            if at:
                grown = work.join(step, "node").where(open_)
                work = grown.select("root", F.col("q").alias("node"), *visited, "n_paths").repartition(n, "node").groupBy(*key).agg(F.sum("n_paths").alias("n_paths"))
            tables.append(work.withColumn("hop", F.lit(at)))
        out = scratch.save(union_all(tables), f"hops-{hop}")
        found.append(out)
        hop += HOPS_AT_ONCE
        work = out.where(F.col("hop") == hop - 1).drop("hop")
        if work.isEmpty():
            break
    out = union_all(found)
    if members is None:  # no guards: one row already
        return out.select("root", "node", "hop", "n_paths")
    alone = F.size("guard") == 0  # the node is in no component, so all its paths have this guard: one row already
    merged = out.where(~alone).groupBy("root", "node", "hop").agg(F.sum("n_paths").alias("n_paths"))
    return out.where(alone).select("root", "node", "hop", "n_paths").union(merged)


def capped_courses(edges: DataFrame, scratch: Scratch, most_hops: int = MOST_HOPS, members: DataFrame | None = None) -> DataFrame:
    """course: those with a chain that the cap on hops cuts.

    Without cycles whether there is such a chain needs no roots: a course has a chain of n edges if one of its courses has one
    of n - 1.  A hop is a pass over the edges, and a row a course is kept.
    """
    if members is None:
        step = scratch.save(edges.select("p", "q").distinct(), "capped-steps")
        found = step.select("p").distinct()
        for hop in range(1, most_hops + 1):
            found = step.join(found.select(F.col("p").alias("q")), "q", "left_semi").select("p").distinct()
            if hop % HOPS_AT_ONCE == 0:
                found = scratch.save(found, f"capped-{hop}")
        return found.select(F.col("p").alias("course"))
    last = chain_expand(edges, scratch, most_hops, members).where(F.col("hop") == most_hops - 1)
    return last.join(edges.select(F.col("p").alias("node")).distinct(), "node", "left_semi").select(F.col("root").alias("course")).distinct()


def _ordered_union(lists: Column) -> Column:
    """One list of the lists' elements, each where it first occurs."""
    return F.array_distinct(F.flatten(lists))


def remaining_plans(courses: DataFrame, edges: DataFrame, scratch: Scratch, bands: int) -> DataFrame:
    """course, remaining, groups: the shortest ordered plan of every course from nothing completed.

    A group's plan is the shortest of its options' (the first of equals); an option's plan is its own remaining courses
    and then itself; a course's is the ordered union over its groups.  ``groups`` holds (grp, options) with every
    option's plan.  Bands go bottom-up: a course's options lie in lower bands, so each is computed once.
    """
    level = courses.select(F.col("pk").alias("course"), "band")
    known = scratch.save(level.where("band = 0").select("course", F.array().cast("array<bigint>").alias("remaining"), F.array().cast("array<struct<grp:int,options:array<array<bigint>>>>").alias("groups")), "band-0")
    by_band = edges.join(level.withColumnRenamed("course", "p"), "p")
    tables = [known]
    for band in range(1, bands):
        below = tables[0].select("course", "remaining")
        for more in tables[1:]:
            below = below.union(more.select("course", "remaining"))
        option = by_band.where(F.col("band") == band).join(below.select(F.col("course").alias("q"), "remaining"), "q")
        option = option.withColumn("plan", F.array_union("remaining", F.array("q")))
        group = option.groupBy("p", "grp").agg(F.array_sort(F.collect_list(F.struct("rn", "plan"))).alias("o"), F.min_by("plan", F.struct(F.size("plan"), "rn")).alias("best"))
        course = group.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("grp", "best", F.col("o.plan").alias("options")))).alias("g"))
        course = course.select(F.col("p").alias("course"), _ordered_union(F.col("g.best")).alias("remaining"), F.transform("g", lambda x: F.struct(x["grp"].alias("grp"), x["options"].alias("options"))).alias("groups"))
        empty = level.where(F.col("band") == band).join(course.select("course"), "course", "left_anti").select("course", F.array().cast("array<bigint>").alias("remaining"), F.array().cast("array<struct<grp:int,options:array<array<bigint>>>>").alias("groups"))
        tables.append(scratch.save(course.unionByName(empty), f"band-{band}"))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def student_plans(targets: DataFrame, edges: DataFrame, taken: DataFrame, members: DataFrame, scratch: Scratch, most_hops: int = MOST_HOPS) -> DataFrame:
    """student, course, remaining: the shortest ordered plan of each target for a transcript.

    ``targets`` has distinct (student, course), ``edges`` (p, q, rn, grp, external), ``taken`` distinct (student, pk), and
    ``members`` is the result of ``cycle_members``.  The edges are read as trees, all groups of one option each, and
    ``tree_plans`` answers; an external option is a step without a plan of its own.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    node = lambda rows, path, parent, ord_, depth, kind, code=none, external=F.lit(False): rows.select(
        text("p").alias("course"), path.alias("path"), parent.alias("parent"), ord_.cast("int").alias("ord"), F.lit(depth).alias("depth"), F.lit(kind).alias("type"), code.alias("code"),
        none.alias("subject"), F.lit(None).cast("int").alias("min_level"), external.alias("external"),
    )
    group = F.concat(F.lit("r."), text("grp"))
    leaves = node(edges, F.concat(group, F.lit("."), text("rn")), group, F.col("rn"), 2, "COURSE", text("q"), F.col("external"))
    nodes = leaves.union(node(edges.select("p", "grp").distinct(), group, F.lit("r"), F.col("grp"), 1, "OR")).union(node(edges.select("p").distinct(), F.lit("r"), none, F.lit(0), 0, "AND"))
    courses = edges.select(text("p").alias("code")).union(edges.select(text("q"))).union(targets.select(text("course")))
    named = members.select(text("node").alias("node"), text("cycle").alias("cycle"))
    plans = tree_plans.tree_plans(targets.select("student", text("course").alias("course")), nodes, courses, taken.select("student", text("pk").alias("code")), named, scratch, most_hops)
    remaining = F.transform("remaining", lambda k: tree_plans.completing(k).cast("long"))
    return plans.select("student", F.col("course").cast("long").alias("course"), remaining.alias("remaining"))


def _stripped(edges: DataFrame, times: int) -> DataFrame:
    """Edges between nodes that have a predecessor and a successor, so many layers of others taken off."""
    for _ in range(times):
        edges = edges.join(edges.select(F.col("p").alias("q")).distinct(), "q", "left_semi").join(edges.select(F.col("q").alias("p")).distinct(), "p", "left_semi").select("p", "q")
    return edges


def _eliminable(edges: DataFrame, kept: DataFrame | None) -> DataFrame:
    """node: none of ``kept``; an independent set of nodes that can be taken out of the graph without it getting more edges.

    Taking a node out joins each predecessor to each successor, so it may have one of either, two of each, or none.  Of
    neighbours that qualify the one of the highest hashed rank goes first; a second pass adds those that are near none chosen.
    """
    ins, outs = edges.groupBy(F.col("q").alias("node")).agg(F.count("*").alias("i")), edges.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("o"))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    able = ins.join(outs, "node", "full").where(i * o <= i + o).select("node", F.struct(F.xxhash64("node"), "node").alias("rank"))
    able = able if kept is None else able.join(kept, "node", "left_anti")
    both = edges.select(F.col("p").alias("node"), F.col("q").alias("near")).union(edges.select("q", "p")).join(able, "node")

    def highest(able: DataFrame) -> DataFrame:
        beaten = both.select(F.col("near").alias("node"), F.col("rank").alias("other")).join(able, "node").where("other > rank").select("node")
        return able.join(beaten, "node", "left_anti")

    first = highest(able)
    near = both.join(first.select("node"), "node", "left_semi").select(F.col("near").alias("node"))
    rest = able.join(first.select("node").union(near), "node", "left_anti")
    both = both.join(rest.select("node"), "node", "left_semi")
    return first.select("node").union(highest(rest).select("node"))


def cyclic_core(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(core, loops, rounds): what is left of a graph after taking out nodes that do not matter for the cycles of the others.

    Nodes on no cycle are peeled off, mutual pairs merged, and what that sets free peeled off again: a catalogue has little more.
    Of the rest, nodes of few neighbours are taken out and their neighbours joined (``_taken_out``): chains, rings and ladders, one-way or two-way, shrink
    by a good part of their nodes a turn, whatever their length.  loops has the nodes that came to precede themselves.
    """
    edges = edges.select("p", "q").distinct()
    loops = edges.where("p = q").select(F.col("p").alias("node"))
    work = _peeled(scratch.save(edges.where("p <> q"), "core"), scratch, "stripped")
    if work.isEmpty():
        return work, loops, []
    pairs = scratch.save(_merged_pairs(work), "pairs")
    for end in ("p", "q"):
        work = work.join(pairs.select(F.col("v").alias(end), F.col("u").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    work = _peeled(scratch.save(work.where("p <> q").select("p", "q").distinct(), "merged"), scratch, "peeled")
    work, rounds = _taken_out(work, None, scratch, "cycles")
    rounds = [pairs, *rounds]
    for cut in rounds:
        loops = loops.union(cut.where("u = w").select(F.col("u").alias("node")))
    return work, loops, rounds


def _peeled(work: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Edges without nodes on no cycle, three layers a turn, as long as a turn halves the edges."""
    now, turn = work.count(), 0
    while now:
        turn += 1
        work = scratch.save(_stripped(work, 3), f"{label}-{turn}")
        before, now = now, work.count()
        if now > before / 2:
            break
    return work


def _merged_pairs(edges: DataFrame) -> DataFrame:
    """(v, u, w): nodes v that are merged into u, to which they have an edge there and back; w is u, and no u is a v.

    A node points to its partner of the least hashed rank, if that is less than its own; of those, nodes whose partner does
    not point on are merged.
    """
    back = edges.select(F.col("q").alias("p"), F.col("p").alias("q"))
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    points = edges.join(back, ["p", "q"], "left_semi").groupBy(F.col("p").alias("v")).agg(F.min_by("q", rank("q")).alias("u")).where(rank("u") < rank("v"))
    return points.join(points.select(F.col("v").alias("u")), "u", "left_anti").select("v", "u", F.col("u").alias("w"))


def _taken_out(work: DataFrame, kept: DataFrame | None, scratch: Scratch, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, rounds): a graph from which independent sets of nodes were taken out as long as each took an eighth of the nodes.

    rounds has the (v, u, w) taken out between a predecessor u and a successor w (null where v had none), first to last.
    """
    rounds, turn = [], 0
    while not work.isEmpty():
        turn += 1
        out = _eliminable(work, kept).withColumnRenamed("node", "v")
        before, after = work.select(F.col("q").alias("v"), F.col("p").alias("u")), work.select(F.col("p").alias("v"), F.col("q").alias("w"))
        cut = scratch.save(out.join(before, "v", "left").join(after, "v", "left"), f"{label}-taken-{turn}")
        gone = cut.select("v").distinct()
        if gone.count() < work.select("p").union(work.select("q")).distinct().count() / 8:
            break
        rounds.append(cut)
        rest = work.join(gone.select(F.col("v").alias("p")), "p", "left_anti").join(gone.select(F.col("v").alias("q")), "q", "left_anti").select("p", "q")
        joined = cut.where("u <> w").select(F.col("u").alias("p"), F.col("w").alias("q"))
        work = scratch.save(rest.union(joined).distinct(), f"{label}-rest-{turn}")
    return work, rounds


def least_sources(edges: DataFrame, rank: Column, scratch: Scratch, label: str) -> DataFrame:
    """(node, source): of the nodes from which a node of the edges can be reached, itself included, that of the least rank.

    ``rank`` is an expression over node; equal ranks go by node.  Every node keeps the least source known; in a step it looks
    at its predecessors' and, as a source's sources are its own, at its source's.  A table, of one row a node, is written every
    HOPS_AT_ONCE steps.  Steps grow with the hops between nodes, so this is for cores, which ``cyclic_core`` has made short.
    """
    nodes = edges.select(F.col("p").alias("node")).union(edges.select("q")).distinct()
    known = scratch.save(nodes.withColumn("least", F.struct(rank.alias("rank"), F.col("node").alias("source"))), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        now = known
        for step in range(HOPS_AT_ONCE):
            of = now.select(F.col("node").alias("p"), "least")
            told = [now, edges.join(of, "p").select(F.col("q").alias("node"), "least")]
            if not step:
                # many nodes share a source: each source's row is met once, and joined to the nodes as they lie
                sources = now.select(F.col("least.source").alias("p")).distinct().join(of, "p")
                told.append(now.select("node", F.col("least.source").alias("p")).join(sources, "p").select("node", "least"))
            now = union_all(told).groupBy("node").agg(F.min("least").alias("least"))
        changed = now.join(known.select("node", F.col("least").alias("before")), "node")
        out = scratch.save(changed.select("node", "least", (F.col("least") < F.col("before")).alias("new")), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        known = out.drop("new")
        if out.where("new").isEmpty():
            return known.select("node", F.col("least.source").alias("source"))


def _strong_components(core: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, cycle) of strongly connected components with two nodes or more.

    Every node takes the least node that reaches it as its colour, by hashed ranks, so that no order of the keys is bad.  The
    nodes that reach that node within their colour, which is to say those whose least reachable node it is, are its
    component.  They go, edges between colours go, as no component lies in two, and what is left is coloured again: with hashed
    ranks some log n times.  A row a node and an edge, no pairs of nodes.
    """
    rank, found, turn = F.xxhash64("node"), [], 0
    while not core.isEmpty():
        turn += 1
        colour = scratch.save(least_sources(core, rank, scratch, f"colour-{turn}"), f"colours-{turn}")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("source").alias("cycle"))  # noqa: E731, B023
        same = scratch.save(core.join(of("p"), "p").join(of("q"), ["q", "cycle"]).select("p", "q"), f"same-{turn}")
        reached = least_sources(same.select(F.col("q").alias("p"), F.col("p").alias("q")), rank, scratch, f"reached-{turn}")
        inside = scratch.save(reached.join(colour, ["node", "source"]).select("node", F.col("source").alias("cycle")), f"inside-{turn}")
        found.append(inside)
        gone = inside.select(F.col("node").alias("p"))
        left = same.join(gone, "p", "left_anti").join(gone.withColumnRenamed("p", "q"), "q", "left_anti").select("p", "q")
        core = scratch.save(_stripped(left, 2), f"left-{turn}")
    if not found:
        return None
    out = union_all(found)
    return scratch.save(out.join(out.groupBy("cycle").count().where("count > 1"), "cycle", "left_semi").select("node", "cycle"), "coloured")


def cycle_members(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, cycle, members: nodes on a cycle, the smallest node of their strongly connected component, and its size."""
    core, loops, rounds = cyclic_core(edges, scratch)
    members = _strong_components(core, scratch)
    loops = loops.distinct().withColumn("cycle", F.col("node"))
    members = loops if members is None else members.union(loops.join(members, "node", "left_anti"))
    members = scratch.save(members, "members")
    for turn, cut in reversed(list(enumerate(rounds))):  # a node taken out is on a cycle if two of its neighbours are on the same
        of = lambda end: members.select(F.col("node").alias(end), "cycle")  # noqa: E731, B023
        more = cut.join(of("u"), "u").join(of("w"), ["w", "cycle"]).select(F.col("v").alias("node"), "cycle").distinct()
        members = members.join(more, "node", "left_anti").select("node", "cycle").union(more)
        if turn % 3 == 0:
            members = scratch.save(members, f"members-{turn}")
    named = members.groupBy("cycle").agg(F.min("node").alias("least"), F.count("*").alias("members"))
    return members.join(named, "cycle").select("node", F.col("least").alias("cycle"), "members")


def reaching(edges: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """node: all nodes with a path to one of the targets (those included).

    The search goes hop by hop.  Where paths turn out to be longer than a few tables of hops, nodes of few neighbours are taken
    out as for cycles, which makes them short; one taken out reaches a target if one of its successors does.
    """
    wanted = scratch.save(targets.select("node").distinct(), "wanted")
    core = scratch.save(edges.where("p <> q").select("p", "q").distinct(), "edges-reaching")

    def searched(core: DataFrame, label: str, most: int | None) -> DataFrame | None:
        found, size, turn = wanted, None, 0
        back = core.select("p", F.col("q").alias("node"))
        while (now := found.count()) != size:
            if turn == most:
                return None
            size, turn = now, turn + 1
            grown = found
            for _ in range(HOPS_AT_ONCE):
                grown = grown.union(grown.join(back, "node").select(F.col("p").alias("node"))).distinct()
            found = scratch.save(grown, f"{label}-{turn}")
        return found

    found, rounds = searched(core, "near", SHORT), []
    if found is None:
        core, rounds = _taken_out(core, wanted, scratch, "reaching")
        found = searched(core, "far", None)
    for turn, cut in reversed(list(enumerate(rounds))):
        more = cut.select(F.col("v").alias("p"), F.col("w").alias("node")).join(found, "node", "left_semi").select(F.col("p").alias("node"))
        found = found.union(more).distinct()
        if turn % 3 == 0:
            found = scratch.save(found, f"found-{turn}")
    return found


def cycle_points(core: DataFrame, entries: DataFrame, scratch: Scratch, most_hops: int = MOST_HOPS) -> DataFrame:
    """root, point: where the path guard stops an expansion inside the cyclic core that begins at an entry.

    The first node of a path is the entry's first step, so a cycle through the entry itself is met one hop later.
    """
    step = core.select(F.col("p").alias("last"), F.col("q").alias("nxt"))
    work = entries.select(F.col("node").alias("last"), F.col("node").alias("root")).join(step, "last").select("root", F.col("nxt").alias("last"), F.array("nxt").alias("seen"))
    points = []
    for hop in range(1, most_hops):
        grown = work.join(step, "last")
        grown = scratch.save(grown.select("root", "seen", "nxt", F.array_contains("seen", F.col("nxt")).alias("stop")), f"guard-{hop}")
        points.append(grown.where("stop").select("root", F.col("nxt").alias("point")).distinct())
        work = grown.where("not stop").select("root", F.col("nxt").alias("last"), F.array_sort(F.array_append("seen", F.col("nxt"))).alias("seen")).distinct()
        if grown.where("not stop").isEmpty():
            break
    out = points[0]
    for more in points[1:]:
        out = out.union(more)
    return out.distinct()
