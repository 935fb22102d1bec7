"""Plans over the requirement trees that were read from text: levels, nested choices and courses the catalogue lacks included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake.operators import graph, honesty, tree_plans, trees
from reqlake.queries.building import read_shapes
from reqlake.queries.eligibility import wanted
from reqlake.sources import catalogue as cat
from reqlake.sources import requirement_text as rt
from reqlake.sources import shapes
from reqlake.storage import Scratch


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.transcript(spark, sf_dir).select("student", cat.code_of(F.col("pk")).alias("code"))


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plans of every student for the course asked for, the trees' nodes and the transcripts."""
    scratch = Scratch(spark, "tree-plans")
    nodes = scratch.save(trees.nodes_of(read_shapes(spark, sf_dir), "code", "tree"), "nodes")
    courses = cat.courses(spark, sf_dir).select("code")
    taken = scratch.save(_taken(spark, sf_dir), "taken")
    members = scratch.save(graph.cycle_members(tree_plans.needs(nodes, courses), scratch), "cycles")
    targets = wanted(spark, sf_dir, taken).select("student", cat.code_of(F.col("course")).alias("course"))
    return scratch.save(tree_plans.tree_plans(targets, nodes, courses, taken, members, scratch), "plans"), nodes, taken


def tree_student_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every student has still to take for the course asked for, as its requirement was read from text."""
    plans = _planned(spark, sf_dir)[0]
    return plans.select("student", "course", "satisfied", F.size("remaining").cast("long").alias("n_remaining"), F.array_join("remaining", ",").alias("remaining"), F.array_join("errors", ",").alias("errors"))


def tree_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choices of every OR of the course that a student asks for, each with its own plan, in order."""
    choice = _planned(spark, sf_dir)[0].select("student", "course", F.explode("alternatives").alias("a"))
    return choice.select("student", "course", F.col("a.path").alias("path"), F.array_join(F.transform("a.plans", lambda p: F.array_join(p, ",")), "|").alias("alternatives"))


def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completing a plan must satisfy its course, and leaving out its last step must not.

    The second is not asked of plans of one step or with a level, which another step may meet.  ``satisfied`` comes from the
    evaluator of trees, not from the plan.
    """
    plans, nodes, taken = _planned(spark, sf_dir)
    plans = plans.where("size(remaining) > 0").select("student", "course", "remaining")
    asked = plans.select("student", "course").distinct()

    def after(steps: F.Column, name: str) -> DataFrame:
        more = plans.select("student", F.explode(steps).alias("k")).select("student", tree_plans.completing(F.col("k")).alias("code"))
        have = taken.join(asked.select("student"), "student", "left_semi").union(more).distinct()
        return trees.satisfied_courses(nodes, have, pairs=asked).withColumn(name, F.lit(True))

    steps = F.size("remaining")
    out = plans.join(after(F.col("remaining"), "all"), ["student", "course"], "left").join(after(F.slice("remaining", 1, steps - 1), "short"), ["student", "course"], "left")
    checked = (steps > 1) & ~F.exists("remaining", lambda k: k.startswith("level:"))
    return out.select("student", "course", steps.cast("long").alias("steps"), F.coalesce("all", F.lit(False)).alias("satisfied"), F.when(checked, F.coalesce("short", F.lit(False))).alias("satisfied_without_last"))


#: Defects that ``honesty_findings`` plants: trees of an unknown node type, courses without a page, and answers changed afterwards.
UNKNOWN_TYPE, NO_PAGE = "pk % 54 = 8", "pk % 30 = 7"
SAYS_YES, SAYS_NO, NO_FLAG, LESS = (f"pk % 23 = {i}" for i in (1, 2, 3, 4))


def honesty_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for an empty transcript that cannot be right, among the engine's answers with defects planted by rule.

    Planted are node types that the engine does not know, and answers that were changed after it gave them.
    """
    scratch = Scratch(spark, "honesty")
    read = read_shapes(spark, sf_dir)
    nodes = trees.nodes_of(read, "code", "tree").join(read.select(F.col("code").alias("course"), "pk"), "course")
    nodes = scratch.save(nodes.withColumn("type", F.when(F.expr(UNKNOWN_TYPE) & (F.col("depth") == 0), "XOR").otherwise(F.col("type"))).drop("pk"), "nodes")
    told = read.select("code", F.col("parse_status").alias("told"), (F.size("unrepresented") > 0).cast("int").alias("gaps"))
    courses = cat.courses(spark, sf_dir).select("pk", "code").join(told, "code", "left")
    unread = F.when(F.expr("pk % 10 = 7"), "unparsed").otherwise("parsed")
    url = F.when(~F.expr(NO_PAGE), F.concat(F.lit("https://catalogue.example.org/"), "code"))
    courses = scratch.save(courses.select("pk", "code", url.alias("url"), F.coalesce("told", unread).alias("parse_status"), F.coalesce("gaps", F.lit(0)).alias("has_unrepresented")), "courses")
    rows = honesty.cold_verdicts(courses, nodes, scratch)
    yes, no, flag, less = (F.expr(r) for r in (SAYS_YES, SAYS_NO, NO_FLAG, LESS))
    less = less & ~F.exists("remaining", lambda k: k.startswith("level:"))  # another step may meet a level that is left out
    rows = rows.withColumn("eligible", F.when(yes, True).when(no, False).otherwise(F.col("eligible"))).withColumn("eligibility_unknown", F.col("eligibility_unknown") & ~(yes | no | flag))
    short = F.slice("remaining", 1, F.greatest(F.size("remaining") - 1, F.lit(0)))
    rows = scratch.save(rows.withColumn("remaining", F.when(no, F.slice("remaining", 1, 0)).when(less, short).otherwise(F.col("remaining"))), "answers")
    return honesty.verdict_findings(honesty.after_advice(rows, nodes))


#: Every student's target, and the courses that each student has completed.
_EACH = "SELECT DISTINCT student, c.code AS course FROM transcript JOIN course c ON c.pk = (student * 31 + 7) % (SELECT count(*) FROM part)"


def _sql(wanted: str = _EACH, taken: str = "taken", unknown: str = "false") -> str:
    """Plans of the courses that each student's target needs, lowest band first; trees are unread where ``unknown`` holds.

    Per course: x and y (with dx and dy where they are completed, px and py their plans), lm whether the level is met, lp its step.
    """
    union = lambda a, b: f"list_concat({a}, list_filter({b}, lambda v: NOT list_contains({a}, v)))"
    shorter = lambda a, b: f"CASE WHEN len({b}) < len({a}) THEN {b} ELSE {a} END"
    outside = f"['course:{shapes.OUTSIDE}']"
    either = f"CASE WHEN dx OR dy THEN [] ELSE {shorter('px', 'py')} END"
    plan = f"""CASE k WHEN 0 THEN {union(f'({either})', 'lp')} WHEN 1 THEN CASE WHEN dx THEN [] ELSE {shorter('px', outside)} END WHEN 5 THEN CASE WHEN dx OR lm THEN [] ELSE {shorter('px', 'lp')} END
      WHEN 6 THEN {either} WHEN 7 THEN CASE WHEN dx OR (dy AND lm) THEN [] ELSE {shorter('px', f'({union("py", "lp")})')} END WHEN 8 THEN px ELSE {union('px', 'py')} END"""
    plan = f"CASE WHEN {unknown} THEN [] ELSE {plan} END"
    met = "CASE k WHEN 0 THEN (dx OR dy) AND lm WHEN 1 THEN dx WHEN 5 THEN dx OR lm WHEN 6 THEN dx OR dy WHEN 7 THEN dx OR (dy AND lm) WHEN 8 THEN dx ELSE dx AND dy END"
    steps = [f"""WITH RECURSIVE {cat.SQL}, {rt.SQL}, {shapes.SQL},
wanted AS ({wanted}), have AS (SELECT * FROM {taken}),
names AS (SELECT code, x AS q FROM shape UNION SELECT code, y FROM shape WHERE k NOT IN (1, 5, 8)),
need(student, code) AS (SELECT student, course FROM wanted UNION
  SELECT n.student, q FROM need n JOIN names s ON s.code = n.code WHERE NOT EXISTS (SELECT 1 FROM have t WHERE t.student = n.student AND t.code = q)),
best AS (SELECT student, subject, max(level) AS level FROM have GROUP BY student, subject),
asked AS (
  SELECT n.student, s.*, CASE k WHEN 7 THEN split_part(y, ' ', 1) ELSE s.subject END AS ls, CASE k WHEN 5 THEN 300 ELSE 200 END AS lv FROM need n JOIN shape s USING (code)),
told AS (
  SELECT a.*, c.band, tx.code IS NOT NULL AS dx, ty.code IS NOT NULL AS dy, coalesce(b.level >= lv, false) AS lm, CASE WHEN coalesce(b.level >= lv, false) THEN [] ELSE [concat('level:', ls, ':', lv)] END AS lp
  FROM asked a JOIN course c USING (code) LEFT JOIN have tx ON tx.student = a.student AND tx.code = x LEFT JOIN have ty ON ty.student = a.student AND ty.code = y
  LEFT JOIN best b ON b.student = a.student AND b.subject = ls),
s0 AS (SELECT student, code, CAST([] AS VARCHAR[]) AS remaining FROM told WHERE false)"""]
    for b in range(1, cat.BANDS):
        below = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(b))
        steps.append(f"""
p{b} AS (
  SELECT t.*, CASE WHEN dx THEN [] ELSE list_append(coalesce(rx.remaining, []), concat('course:', x)) END AS px, CASE WHEN dy THEN [] ELSE list_append(coalesce(ry.remaining, []), concat('course:', y)) END AS py
  FROM told t LEFT JOIN ({below}) rx ON rx.student = t.student AND rx.code = x LEFT JOIN ({below}) ry ON ry.student = t.student AND ry.code = y WHERE band = {b}),
s{b} AS (SELECT student, code, {plan} AS remaining FROM p{b})""")
    every = " UNION ALL ".join(f"SELECT student, code, pk, k, dx, dy, lm, px, py, lp FROM p{b}" for b in range(1, cat.BANDS))
    return ", ".join(steps) + f""", leaves AS (SELECT l.* FROM ({every}) l JOIN wanted w ON w.student = l.student AND w.course = l.code),
plan AS (SELECT w.student, w.course, coalesce({met}, true) AS satisfied, CASE WHEN k IS NULL THEN [] ELSE {plan} END AS remaining, k
  FROM wanted w LEFT JOIN leaves l ON l.student = w.student AND l.code = w.course),
choice AS (
  SELECT student, code AS course, CASE k WHEN 0 THEN 'r.0' ELSE 'r' END AS path,
         CASE k WHEN 1 THEN [px, {outside}] WHEN 5 THEN [px, lp] WHEN 7 THEN [px, CASE WHEN dy AND lm THEN [] ELSE {union('py', 'lp')} END] ELSE [px, py] END AS plans
  FROM leaves WHERE k IN (0, 1, 5, 6, 7))"""


_PLANS = _sql()
_COLD = _sql("SELECT 0 :: BIGINT AS student, code AS course FROM course", "taken WHERE false", UNKNOWN_TYPE)
_HONEST = f"""{_COLD},
reach(code, q) AS (SELECT code, code FROM shape UNION SELECT r.code, n.q FROM reach r JOIN shape s ON s.code = r.q AND NOT s.{UNKNOWN_TYPE} JOIN names n ON n.code = r.q),
raised AS (SELECT DISTINCT r.code FROM reach r JOIN shape s ON s.code = r.q WHERE s.{UNKNOWN_TYPE}),
cold AS (
  SELECT c.pk, c.code, s.pk IS NOT NULL AS tree, CASE WHEN s.k IN (5, 8) THEN 'partial' WHEN s.pk IS NULL AND c.pk % 10 = 7 THEN 'unparsed' ELSE 'parsed' END AS status,
         coalesce(p.remaining, []) AS r, c.{NO_PAGE} AS pageless, c.{SAYS_YES} AS yes, c.{SAYS_NO} AS no, c.{NO_FLAG} AS flag,
         c.{LESS} AND len(list_filter(coalesce(p.remaining, []), lambda s: starts_with(s, 'level:'))) = 0 AS less
  FROM course c LEFT JOIN shape s ON s.pk = c.pk LEFT JOIN plan p ON p.course = c.code),
answer AS (
  SELECT *, CASE WHEN yes THEN true WHEN no THEN false WHEN status = 'unparsed' THEN NULL ELSE NOT tree END AS eligible, status = 'unparsed' AND NOT (yes OR no OR flag) AS unsure,
         CASE WHEN no THEN [] WHEN less THEN r[1:len(r) - 1] ELSE r END AS advice
  FROM cold)"""
_RULES = {
    "unread but judged": "status = 'unparsed' AND eligible IS TRUE", "unread but not flagged": "status = 'unparsed' AND NOT unsure", "cannot judge and no page": "unsure AND pageless",
    "needs nothing but not eligible": "status = 'parsed' AND NOT tree AND eligible IS NOT TRUE", "eligible with nothing completed": "tree AND eligible IS TRUE",
    "not eligible but names nothing": "tree AND eligible IS FALSE AND len(advice) = 0",
}

QUERIES = {"honesty_findings": honesty_findings, "tree_student_plans": tree_student_plans, "tree_alternatives": tree_alternatives, "tree_round_trip": tree_round_trip}

ORACLE_SQL = {
    "honesty_findings": _HONEST + " UNION ALL ".join(f"\nSELECT '{name}' AS \"check\", 'error' AS severity, code, '' AS message FROM answer WHERE {rule}" for name, rule in _RULES.items())
    + """ UNION ALL SELECT 'evaluation raised', 'error', code, 'node type XOR' FROM raised
        UNION ALL SELECT 'advice does not help', 'error', code, array_to_string(advice, ',') FROM answer WHERE tree AND less AND len(advice) > 0 AND eligible IS NOT TRUE""",
    "tree_student_plans": f"{_PLANS} SELECT student, course, satisfied, len(remaining) AS n_remaining, array_to_string(remaining, ',') AS remaining, '' AS errors FROM plan",
    "tree_alternatives": f"""{_PLANS} SELECT student, course, path, array_to_string(list_transform(list_filter(plans, lambda p: len(p) > 0), lambda p: array_to_string(p, ',')), '|') AS alternatives FROM choice""",
    "tree_round_trip": f"""{_PLANS} SELECT student, course, len(remaining) AS steps, true AS satisfied,
        CASE WHEN len(remaining) > 1 AND len(list_filter(remaining, lambda s: starts_with(s, 'level:'))) = 0 THEN false END AS satisfied_without_last FROM plan WHERE len(remaining) > 0""",
}
