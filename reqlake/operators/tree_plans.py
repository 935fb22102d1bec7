"""Plans over nested requirement trees: what a student has still to take, in order, and every OR's choices.

A course needs its tree, whose leaves are courses with trees of their own: an AND-OR graph.  Downwards, the trees that a
target needs are opened hop by hop, one row per student, course and guard.  Upwards, each hop's trees are folded from their
leaves, and their plans become leaves of the trees above.  A tree, the reading of one text, is folded as one row, level by
level from its deepest, so a hop costs one shuffle whatever the depth of its trees.

The guard holds the courses that a path has visited in the cyclic component it is in, as a set in canonical order: paths that
visit the same courses in different order are one row.  It has as many members as the path has hops in the component, 12 at
most, where a bitmap would have as many bits as the component has courses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlake.functions.codes import level_of, requirement_key, subject_of
from reqlake.storage import Scratch

MOST_HOPS = 12
CYCLE, CAP, TYPE = "cycle at ", "chain cut at ", "node type "
INNER = ("AND", "OR")


def visited(guard: Column, course: Column, inside: Column, stays: Column) -> Column:
    """The guard after a step to ``course``: its own component's visited courses, in canonical order; empty outside of any."""
    return F.when(inside.isNull(), F.slice(guard, 1, 0)).when(stays, F.array_sort(F.array_append(guard, course))).otherwise(F.array(course))


def with_components(steps: DataFrame, source: str, target: str, members: DataFrame) -> DataFrame:
    """``steps`` with inside, the component of the target (null for none), and stays: whether the source is in it too."""
    of = lambda end, name: members.select(F.col("node").alias(end), F.col("cycle").alias(name))
    steps = steps.join(of(target, "inside"), target, "left").join(of(source, "_own"), source, "left")
    return steps.withColumn("stays", F.coalesce(F.col("inside") == F.col("_own"), F.lit(False))).drop("_own")


def _union(lists: Column) -> Column:
    """One list of the lists' elements, each where it first occurs."""
    return F.array_distinct(F.flatten(lists))


def _shortest(plans: Column) -> Column:
    """The shortest plan, of equals the first; an empty one where there is none."""
    start = F.slice(F.flatten(F.slice(plans, 1, 1)), 1, 1_000_000_000)
    return F.aggregate(plans, start, lambda best, plan: F.when(F.size(plan) < F.size(best), plan).otherwise(best))


def _settled(level: Column, below: Column) -> Column:
    """The nodes of one depth with met, plan and plans (an OR's choices), given the settled nodes below them."""
    leaf = F.array().cast("array<array<string>>")
    families = F.transform(level, lambda n: F.struct(n.alias("n"), F.array_sort(F.filter(below, lambda c: c["parent"] == n["path"]), lambda a, b: a["ord"] - b["ord"]).alias("children")))

    def judged(family: Column) -> Column:
        node, children = family["n"], family["children"]
        met = F.when(node["type"] == "AND", F.forall(children, lambda c: c["met"])).when(node["type"] == "OR", F.exists(children, lambda c: c["met"])).otherwise(node["met"])
        plans = F.filter(F.transform(F.filter(children, lambda c: ~c["met"]), lambda c: c["plan"]), lambda p: F.size(p) > 0)
        return F.struct(node.alias("n"), met.alias("met"), F.when(node["type"].isin(*INNER), plans).otherwise(leaf).alias("plans"))

    def planned(family: Column) -> Column:
        node, plans = family["n"], family["plans"]
        plan = F.when(~node["type"].isin(*INNER), node["plan"]).when(family["met"], F.slice(node["plan"], 1, 0)).when(node["type"] == "AND", _union(plans)).otherwise(_shortest(plans))
        return F.struct(*(node[c].alias(c) for c in ("path", "parent", "ord", "type")), family["met"].alias("met"), plan.alias("plan"), plans.alias("plans"))

    return F.transform(F.transform(families, judged), planned)


def folded(trees: DataFrame, deepest: int) -> DataFrame:
    """``trees`` with root and alternatives, folded from the column items: node rows whose leaves are settled.

    AND: met if all children are; else the union of its unmet children's plans.  OR: met if one child is; its choices are the
    plans of its unmet children, kept even where it is met, and its plan is the shortest.  A plan of no step is no choice.
    A column a depth, so that each level is computed once.
    """
    at = lambda d: F.filter("items", lambda n: n["depth"] == d)
    trees = trees.withColumn(f"_{deepest + 1}", F.filter("items", lambda n: F.lit(False)))
    trees = trees.withColumn(f"_{deepest}", _settled(at(deepest), F.col(f"_{deepest + 1}")))
    for depth in range(deepest - 1, -1, -1):
        trees = trees.withColumn(f"_{depth}", _settled(at(depth), F.col(f"_{depth + 1}")))
    ors = F.filter(F.flatten(F.array(*(f"_{d}" for d in range(deepest + 1)))), lambda n: n["type"] == "OR")
    trees = trees.withColumn("root", F.col("_0")[0]).withColumn("alternatives", F.transform(ors, lambda n: F.struct(n["path"].alias("path"), n["plans"].alias("plans"))))
    return trees.drop(*(f"_{d}" for d in range(deepest + 2)))


def tree_plans(targets: DataFrame, nodes: DataFrame, courses: DataFrame, taken: DataFrame, members: DataFrame, scratch: Scratch, most_hops: int = MOST_HOPS) -> DataFrame:
    """student, course, found, satisfied, remaining, alternatives, errors of each target for a transcript.

    ``targets`` has distinct (student, course), ``nodes`` the rows of ``trees.nodes_of`` (with ``external`` for leaves that are
    not to be opened, if any), ``courses`` the codes of the catalogue, ``taken`` distinct (student, code), ``members`` the result of ``cycle_members`` over the courses' needs.

    ``remaining`` lists requirement keys.  A completed course needs nothing; another is the plan of its own tree and then
    itself.  A course that the catalogue lacks, one that the path has visited already (an error) and one at the cap on hops
    (an error if it has a tree) are steps without a plan of their own.  A level is met by a completed course of the subject
    at or above it and else a step of its own.  A node of an unknown type is never met and has no plan (an error).  A target
    that the catalogue lacks is not found and has nulls; one without a tree is satisfied.  ``alternatives`` has (path, plans) of
    the target's ORs, ``errors`` what was met on the way, sorted.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    key = requirement_key(F.when(F.col("type") == "COURSE", "course").otherwise("level"), F.col("code"), F.col("subject"), F.col("min_level"))
    tracked = courses.select(F.col("code"), F.lit(True).alias("tracked")).distinct()
    rooted = nodes.select(F.col("course").alias("code"), F.lit(True).alias("has_tree")).distinct()
    step = nodes.withColumn("key", key).join(tracked, "code", "left").join(rooted, "code", "left")
    own = ~F.coalesce("external", F.lit(False)) if "external" in nodes.columns else F.lit(True)
    step = step.withColumn("has_tree", F.coalesce(F.col("tracked") & F.col("has_tree") & own, F.lit(False))).drop("tracked")
    step = with_components(step, "course", "code", members)
    item = F.struct(*(c for c in ("path", "parent", "depth", "ord", "type", "code", "subject", "min_level", "key", "has_tree", "inside", "stays")))
    step = scratch.save(step.groupBy("course").agg(F.collect_list(item).alias("items")), "tree-steps")
    # a transcript is one row, and so is a tree: a hop's nodes are told apart behind its shuffles
    done = taken.select("student", "code").distinct()
    best = done.groupBy("student", subject_of(F.col("code")).alias("subject")).agg(F.max(level_of(F.col("code"))).alias("best"))
    best = best.where("subject is not null").groupBy("student").agg(F.map_from_entries(F.collect_list(F.struct("subject", "best"))).alias("levels"))
    done = done.groupBy("student").agg(F.collect_list("code").alias("done"))
    levels = not nodes.where("type = 'LEVEL_MIN'").isEmpty()
    have = done.join(best, "student", "left") if levels else done.withColumn("levels", F.lit(None).cast("map<string,int>"))
    have = scratch.save(have, "tree-taken")

    state = ["student", "course", "guard"]
    front = targets.select("student", "course", F.array().cast("array<string>").alias("guard"))
    opened = []
    for hop in range(most_hops + 1):
        rows = front.join(step, "course").join(have, "student", "left")
        rows = rows.select(*state, F.array_intersect("items.code", "done").alias("done"), "levels", "items").select(*state, "done", "levels", F.inline("items"))
        rows = rows.withColumn("done", F.array_contains("done", F.col("code"))).withColumn("best", F.try_element_at("levels", F.col("subject")))
        leaf, kind = F.col("type") == "COURSE", F.col("type")
        met = F.when(leaf, F.coalesce("done", F.lit(False))).when(kind == "LEVEL_MIN", F.coalesce(F.col("best") >= F.col("min_level"), F.lit(False))).otherwise(False)
        again = leaf & ~met & F.array_contains("guard", F.col("code"))
        deeper = leaf & ~met & ~F.coalesce(again, F.lit(False)) & F.col("has_tree")
        error = F.when(again, F.concat(F.lit(CYCLE), "code")).when(deeper & F.lit(hop == most_hops), F.concat(F.lit(CAP), "code"))
        error = error.when(~F.coalesce(kind.isin("AND", "OR", "COURSE", "LEVEL_MIN"), F.lit(False)), F.concat(F.lit(TYPE), F.coalesce(kind, F.lit("null"))))
        step_key = F.when(~met & kind.isin("COURSE", "LEVEL_MIN"), F.array("key")).otherwise(F.array().cast("array<string>"))
        rows = rows.select(
            *state, "path", "parent", "depth", "ord", "type", "code", met.alias("met"), step_key.alias("plan"), (deeper & F.lit(hop < most_hops)).alias("open"),
            F.when(leaf, visited(F.col("guard"), F.col("code"), F.col("inside"), F.col("stays"))).alias("next"), error.alias("error"),
        )
        rows = scratch.save(rows, f"opened-{hop}")
        opened.append(rows)
        front = rows.where("open").select("student", F.col("code").alias("course"), F.col("next").alias("guard")).distinct()
        if rows.where("open").isEmpty():
            break

    known = None
    for hop, rows in reversed(list(enumerate(opened))):
        errors = F.array_compact(F.array("error"))
        if known is not None:
            # only leaves that were opened look for a plan: the others must not meet under one null key
            deeper = known.select("student", F.col("course").alias("code"), F.col("guard").alias("next"), "remaining", F.col("errors").alias("more"))
            opens = rows.where("open").join(deeper, ["student", "code", "next"], "left")
            opens = opens.withColumn("plan", F.array_distinct(F.concat("remaining", "plan"))).withColumn("all", F.col("more"))
            rows = rows.where("not open").withColumn("all", errors).unionByName(opens.select(*rows.columns, "all"))
        else:
            rows = rows.withColumn("all", errors)
        item = F.struct("path", "parent", "depth", "ord", "type", "met", "plan")
        trees = rows.groupBy(*state).agg(F.collect_list(item).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("errors"))
        known = folded(trees, deepest).select(*state, F.col("root.met").alias("satisfied"), F.col("root.plan").alias("remaining"), *(["alternatives"] if hop == 0 else []), "errors")
        known = scratch.save(known, f"plans-{hop}")
        scratch.drop(f"opened-{hop}", *([f"plans-{hop + 1}"] if hop + 1 < len(opened) else []))

    out = targets.select("student", "course").join(known.drop("guard"), ["student", "course"], "left")
    out = out.join(tracked.select(F.col("code").alias("course"), F.col("tracked").alias("found")), "course", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    empty = lambda c: F.when(F.col("found"), F.coalesce(c, F.array().cast(known.schema[c].dataType)))
    satisfied = F.when(F.col("found"), F.coalesce("satisfied", F.lit(True)))
    return out.select("student", "course", "found", satisfied.alias("satisfied"), *(empty(c).alias(c) for c in ("remaining", "alternatives", "errors")))


def needs(nodes: DataFrame, courses: DataFrame) -> DataFrame:
    """(p, q): which courses of the catalogue a course's tree names, for ``cycle_members``."""
    known = courses.select(F.col("code").alias("q")).distinct()
    return nodes.where("type = 'COURSE'").select(F.col("course").alias("p"), F.col("code").alias("q")).distinct().join(known, "q", "left_semi").select("p", "q")


def completing(requirement: Column) -> Column:
    """A course code that meets a requirement key: the course itself, or one at the level."""
    level = F.regexp_replace(requirement, r"^level:(.*):(\d+)$", "$1 $2")
    return F.when(requirement.startswith("course:"), F.substring(requirement, 8, 1_000_000)).otherwise(level)
