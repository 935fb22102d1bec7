"""Integrity checks of a catalogue: each is an anti-pattern, and no rows means it passes.

``course_findings`` looks at every course once, with a summary of its tree, and gives a row per broken rule; ``node_findings``
does so for tree nodes, ``reference_findings`` for references between courses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlake.operators import evaluate

CODE_SHAPE = r"^[A-Z]{1,8}(?: [A-Z]{1,4})? \d{2,4}[A-Z]{0,2}$"
STATUSES = ("parsed", "partial", "unparsed")
TYPES = ("AND", "OR", "COURSE", "LEVEL_MIN")
REQUIRED = ("code", "subject", "level", "parse_status", "url")
DEEP = 6


def finding(rows: DataFrame, check: str, severity: str, code: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), code.alias("code"), message.alias("message"))


def _broken(*rules: tuple[Column, str, str, Column | str]) -> Column:
    """Array of (check, severity, message) of the rules whose condition holds; a null condition does not."""
    row = lambda check, severity, message: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    return F.array_compact(F.array(*[F.when(holds, row(check, severity, message)) for holds, check, severity, message in rules]))


def broken(rows: DataFrame, *rules: tuple[Column, str, str, Column | str]) -> DataFrame:
    """check, severity, code, message: a row per rule (condition, check, severity, message) that a row of ``rows`` breaks."""
    return rows.select("code", F.inline(_broken(*rules))).select("check", "severity", "code", "message")


def course_findings(courses: DataFrame, nodes: DataFrame, site: str) -> DataFrame:
    """check, severity, code, message of broken rules of single courses.

    ``courses`` has pk, code, subject, level, url, parse_status, text, has_unrepresented; ``nodes`` are of trees by pk.  What a
    student with nothing completed is told is ``evaluate.defaults``' answer; ``honesty`` holds a whole engine to account.
    """
    summary = nodes.groupBy(F.col("course").alias("pk")).agg(F.max("depth").alias("deepest"), F.count_if(F.col("type").isin("COURSE", "LEVEL_MIN")).alias("leaves"))
    told = evaluate.defaults(courses, nodes.select(F.col("course").alias("p"))).select(F.col("p").alias("pk"), "eligible")
    rows = courses.join(summary, "pk", "left").join(told, "pk", "left")
    status, tree, eligible = F.col("parse_status"), F.col("deepest").isNotNull(), F.col("eligible")
    gaps = F.col("has_unrepresented") == 1
    missing = [(F.col(c).isNull(), "required field", "error", c) for c in REQUIRED]
    rules = [
        *missing, (~F.col("code").rlike(CODE_SHAPE), "code shape", "error", ""), (~status.isin(*STATUSES), "status", "error", status), (~F.col("url").startswith(site), "url", "error", F.col("url")),
        ((status == "unparsed") & tree, "unparsed with a tree", "error", ""), ((status == "parsed") & gaps, "parsed but incomplete", "error", ""),
        (tree & (F.coalesce("text", F.lit("")) == ""), "tree without text", "error", ""), (F.col("deepest") > DEEP, "deep tree", "warn", F.col("deepest").cast("string")),
        ((status == "unparsed") & eligible.isNotNull(), "unread but judged", "error", ""), (eligible.isNull() & F.col("url").isNull(), "cannot judge and no page", "error", ""),
        ((status == "parsed") & ~tree & ~F.coalesce(eligible, F.lit(False)), "needs nothing but not eligible", "error", ""), (tree & F.coalesce(eligible, F.lit(False)), "eligible with nothing completed", "error", ""),
        (~F.coalesce(eligible, F.lit(True)) & (F.col("leaves") == 0), "not eligible but names nothing", "error", ""),
    ]
    return broken(rows, *rules)


def node_findings(courses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Broken rules of tree nodes; ``nodes`` have course, path, parent, type, code, external, subject, min_level."""
    children = nodes.where("parent is not null").groupBy("course", F.col("parent").alias("path")).agg(F.count("*").alias("n"))
    known = courses.select(F.col("code"), F.lit(True).alias("known")).distinct()
    rows = nodes.join(children, ["course", "path"], "left").join(known, "code", "left")
    kind, leaf, inner = F.col("type"), F.col("type") == "COURSE", F.col("type").isin("AND", "OR")
    rules = [
        (~F.coalesce(kind.isin(*TYPES), F.lit(False)), "node type", "error", F.concat_ws(" ", "path", "type")), (leaf & ~F.coalesce(F.col("code").rlike(CODE_SHAPE), F.lit(False)), "course node without a code", "error", F.col("path")),
        (leaf & F.col("external").isNull(), "course node without a flag", "error", F.col("path")), ((kind == "LEVEL_MIN") & F.col("min_level").isNull(), "level node without a level", "error", F.col("path")),
        ((kind == "LEVEL_MIN") & (F.coalesce("subject", F.lit("")) == ""), "level node without a subject", "error", F.col("path")),
        (inner & (F.coalesce("n", F.lit(0)) < 2), "node with one child", "error", F.col("path")), (leaf & F.col("code").isNotNull() & (F.col("external") != F.col("known").isNull()), "external flag", "error", F.col("code")),
    ]
    out = rows.select("course", F.inline(_broken(*rules)))
    return out.join(courses.select(F.col("pk").alias("course"), F.col("code").alias("of")), "course").select("check", "severity", F.col("of").alias("code"), "message")


def reference_findings(courses: DataFrame, edges: DataFrame, coreqs: DataFrame, exclusions: DataFrame, cycles: DataFrame) -> DataFrame:
    """Broken rules of references; ``edges`` and ``coreqs`` have (p, q), ``cycles`` is the result of ``cycle_members``."""
    own, none = courses.select(F.col("pk").alias("p"), "code"), F.lit("")
    known = courses.select(F.col("pk").alias("q"), F.col("code").alias("q_code"))
    on_cycle = cycles.select(F.col("node").alias("p"), "cycle", "members").join(own, "p")
    checks = [
        finding(edges.where("p = q").join(own, "p"), "own prerequisite", "error", F.col("code"), none),
        finding(exclusions.where("pk = ex").join(own, F.col("pk") == F.col("p")), "own exclusion", "error", F.col("code"), none),
        finding(edges.select("p", "q").join(coreqs.select("p", "q"), ["p", "q"]).distinct().join(own, "p").join(known, "q"), "prerequisite and corequisite", "warn", F.col("code"), F.col("q_code")),
        finding(coreqs.select("p", "q").union(edges.select("p", "q")).join(known, "q", "left_anti").join(own, "p"), "dangling reference", "warn", F.col("code"), F.col("q").cast("string")),
        finding(on_cycle.where("members > 1"), "cycle", "warn", F.col("code"), F.col("cycle").cast("string")),
        finding(courses.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where("n > 1"), "duplicate", "error", F.col("code"), F.col("n").cast("string")),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.union(more)
    return out


def envelope_findings(envelope: DataFrame, courses: DataFrame) -> DataFrame:
    """A finding where the envelope's course_count is not the number of courses."""
    rows = envelope.select("course_count", courses.select(F.count("*")).scalar().alias("n"))
    return finding(rows.where("course_count <> n"), "course count", "error", F.lit(None).cast("string"), F.concat_ws(" ", F.col("course_count").cast("string"), F.col("n").cast("string")))


def exit_status(findings: DataFrame) -> DataFrame:
    """errors, warnings, status: any error fails the catalogue."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, 1).otherwise(0))
