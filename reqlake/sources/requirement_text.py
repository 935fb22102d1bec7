"""Catalogue descriptions written out from the derived catalogue, so that what reading them must give is known.

``texts`` gives per course its requirement sentence and its whole description.  The sentence templates cover the grammar's
brackets and precedences; statuses follow the catalogue: unread texts, dropped remarks, asides, and fragments that
no tree represents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake.sources import catalogue as cat
from reqlake.storage import shuffled, table

#: Columns x, y, z, w are the codes of a course's options; ys and ws are y and w as a list after x and z would write them.
SENTENCE = """
CASE WHEN pk % 10 = 7 THEN 'Prerequisites are determined by the instructor in the course outline.'
     WHEN x IS NULL THEN NULL
     ELSE concat(
       CASE WHEN y IS NULL THEN concat('Prerequisite: ', x)
            WHEN z IS NULL THEN CASE pk % 3 WHEN 0 THEN concat('Prerequisites: ', x, ' or ', ys) WHEN 1 THEN concat('Prerequisite: one of ', x, ' or ', ys)
                                ELSE concat('Prerequisite: either ', x, ' or ', ys) END
            WHEN w IS NULL THEN CASE pk % 3 WHEN 0 THEN concat('Prerequisites: ', x, ' or ', ys, ', and ', z) WHEN 1 THEN concat('Prerequisites: one of ', x, ' or ', ys, '; and ', z)
                                ELSE concat('Prerequisites: either ', x, ' or ', ys, ' and ', z) END
            ELSE CASE pk % 3 WHEN 0 THEN concat('Prerequisites: one of ', x, ' or ', ys, ', and one of ', z, ' or ', ws) WHEN 1 THEN concat('Prerequisites: ', x, ' or ', ys, ', and ', z, ' or ', ws)
                 ELSE concat('Prerequisites: either ', x, ' or ', ys, ' and one of ', z, ', ', ws) END END,
       CASE WHEN pk % 20 = 5 THEN '; and a reading list agreed in advance' WHEN pk % 10 IN (3, 5) THEN '; and permission of the Department'
            WHEN pk % 30 = 1 THEN concat(' (', code, ' recommended)') ELSE '' END, '.') END
"""
#: The description's sentences in order; null ones are left out.
INTRO = "concat('An introduction to ', title, '.')"
COREQ = "CASE WHEN pk % 8 = 2 THEN concat('Corequisite: ', next_code, '.') END"
EXCLUSION = "CASE WHEN ex_code IS NOT NULL THEN concat('Credit cannot be obtained for both ', code, ' and ', ex_code, '.') END"
NOTE = "CASE WHEN pk % 9 = 4 THEN 'Note: offered in alternate years.' END"
REVERSE = "CASE WHEN pk % 11 = 3 THEN concat('This course is a prerequisite for ', next_code, '.') END"

#: ``texts`` as common table expressions after those of the catalogue.
SQL = f"""
opt AS (
  SELECT p, max(CASE WHEN rn = 1 THEN code END) AS x, max(CASE WHEN rn = 2 THEN code END) AS y, max(CASE WHEN rn = 3 THEN code END) AS z, max(CASE WHEN rn = 4 THEN code END) AS w
  FROM edge JOIN course ON pk = q GROUP BY p),
wide AS (
  SELECT c.*, x, y, z, w, CASE WHEN split_part(x, ' ', 1) = split_part(y, ' ', 1) THEN split_part(y, ' ', 2) ELSE y END AS ys,
         CASE WHEN split_part(z, ' ', 1) = split_part(w, ' ', 1) THEN split_part(w, ' ', 2) ELSE w END AS ws,
         concat('SUB', chr(CAST(65 + (pk + 1) % 25 AS INT)), ' ', CAST(100 + CAST(floor((pk + 1) / 25) AS INT) AS VARCHAR)) AS next_code, ec.code AS ex_code
  FROM course c LEFT JOIN opt ON p = c.pk LEFT JOIN excl USING (pk) LEFT JOIN (SELECT pk AS ex, code FROM course) ec USING (ex)),
texts AS (SELECT *, {SENTENCE} AS sentence, {INTRO} AS intro, {COREQ} AS coreq, {EXCLUSION} AS exclusion, {NOTE} AS note, {REVERSE} AS reverse FROM wide),
tree AS (
  SELECT *, CASE WHEN pk % 10 = 7 OR x IS NULL THEN NULL WHEN y IS NULL THEN x WHEN z IS NULL THEN concat('O(', x, ', ', y, ')')
                 WHEN w IS NULL THEN concat('A(O(', x, ', ', y, '), ', z, ')') ELSE concat('A(O(', x, ', ', y, '), O(', z, ', ', w, '))') END AS tree,
         CASE WHEN pk % 10 = 7 THEN 'unparsed' WHEN x IS NULL THEN 'parsed' WHEN pk % 10 IN (3, 5) OR pk % 30 = 1 THEN 'partial' ELSE 'parsed' END AS read_status
  FROM texts)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's columns and x, y, z, w, sentence, description, and the description's parts."""
    course = cat.courses(spark, sf_dir)
    named = cat.edges(spark, sf_dir).select("p", "rn", cat.code_of(F.col("q")).alias("c"))
    options = named.groupBy(F.col("p").alias("pk")).agg(*[F.max(F.when(F.col("rn") == i + 1, F.col("c"))).alias(n) for i, n in enumerate("xyzw")])
    rows = course.join(shuffled(options), "pk", "left").join(shuffled(cat.exclusions(spark, sf_dir).select("pk", cat.code_of(F.col("ex")).alias("ex_code"))), "pk", "left")
    short = lambda a, b: F.when(F.split_part(a, F.lit(" "), F.lit(1)) == F.split_part(b, F.lit(" "), F.lit(1)), F.split_part(b, F.lit(" "), F.lit(2))).otherwise(b)
    rows = rows.withColumn("ys", short(F.col("x"), F.col("y"))).withColumn("ws", short(F.col("z"), F.col("w"))).withColumn("next_code", cat.code_of(F.col("pk") + 1))
    for name, sql in (("sentence", SENTENCE), ("intro", INTRO), ("coreq", COREQ), ("exclusion", EXCLUSION), ("note", NOTE), ("reverse", REVERSE)):
        rows = rows.withColumn(name, F.expr(sql))
    return rows.withColumn("description", F.concat_ws(" ", "intro", "sentence", "coreq", "exclusion", "note", "reverse"))


def subject_codes(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The catalogue's subjects: SUBJECTS at most, however many courses there are."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % cat.SUBJECTS).alias("s")).distinct().collect()
    return tuple(sorted(f"SUB{chr(65 + r.s)}" for r in rows))
