"""Queries that build the catalogue from its pages and read requirement trees as rows: fields, course rows, shapes, labels, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqlake.functions import sentences
from reqlake.functions.codes import describe_requirement, level_of, requirement_key, subject_of
from reqlake.operators import evaluate, render, trees
from reqlake.plans import grammar
from reqlake.queries.text import _vocabulary
from reqlake.sources import catalogue as cat
from reqlake.sources import course_pages
from reqlake.sources import pages as html
from reqlake.sources import requirement_text as rt
from reqlake.sources import shapes
from reqlake.storage import Scratch, shuffled

PER_SUBJECT = 5
UNDERGRAD = 500
SNIPPET = 130
NOT_ENFORCED = " (informational -- not enforced in the graph)"
_WITH = f"WITH {cat.SQL}, {rt.SQL}"


def subject_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the registry page, with a flag for those that the science page lists too."""
    found = html.subjects(course_pages.registries(spark, sf_dir))
    science = found.where("page = 'science'").select("slug", F.lit(True).alias("listed"))
    return found.where("page = 'all'").join(science, "slug", "left").select("slug", "code", "name", F.coalesce("listed", F.lit(False)).alias("science"))


def course_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.course_numbers(course_pages.indexes(spark, sf_dir))


def course_numbers_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first courses of each subject: what a trial run fetches."""
    return html.first_per_subject(course_numbers(spark, sf_dir), PER_SUBJECT).select("slug", "number")


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses that an index lists and no landed page has: pages land for nine in ten keys here, the others are to be fetched."""
    wanted = course_numbers(spark, sf_dir).select(F.concat(F.lit(f"{course_pages.SITE}/catalogue/course/"), "slug", F.lit("/"), F.lower("number")).alias("url")).distinct()
    landed = rt.texts(spark, sf_dir).where("pk % 10 > 0").select(F.expr(course_pages.url_sql("code")).alias("url"))
    return wanted.join(landed, "url", "left_anti")


def course_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = html.course_fields(course_pages.courses(spark, sf_dir))
    return fields.withColumn("warnings", F.array_join("warnings", "|"))


def built(pages: DataFrame, vocabulary: grammar.Vocabulary) -> DataFrame:
    """The 22 columns of a course from its page: fields, routed sentences, trees, exclusions, notes."""
    scratch = Scratch(pages.sparkSession, "build")
    fields = scratch.save(html.course_fields(pages), "fields")
    text = fields.join(shuffled(sentences.field_texts(fields.where("description is not null"), "url", "description").withColumnRenamed("prose", "prose_text")), "url", "left")
    text = scratch.save(text.withColumn("home", subject_of(F.col("code"))), "texts")
    read = lambda field: grammar.parse(text.select("url", field, "home"), "url", field, "home", vocabulary)
    prereq, coreq = read("prereq"), read("coreq").select("url", F.col("tree").alias("coreq_tree"), F.col("parse_status").alias("coreq_status"))
    rows = text.join(shuffled(prereq), "url").join(shuffled(coreq), "url")
    excluded = grammar.credit_exclusions(F.col("exclusion"), F.col("code"), F.col("home"), vocabulary)
    exclusions = F.array_remove(F.array_union(excluded, "candidates"), F.col("code"))
    informational = [F.when(n.isNotNull(), F.concat(n, F.lit(NOT_ENFORCED))) for n in sentences.notes_of(F.coalesce("description", F.lit("")))]
    notes = F.concat("notes", F.array_compact(F.array(*informational)))
    return rows.select(
        "code", "number", F.col("home").alias("subject"), level_of(F.col("code")).alias("level"), "title", F.col("units").alias("credits"), "credits_text", "faculty", "effective_term",
        F.col("prose_text").alias("description"), F.col("prereq").alias("prerequisites_text"), F.col("prereq").isNotNull().alias("prerequisites_field_present"),
        F.col("tree").alias("prerequisite_tree"), F.col("coreq").alias("corequisites_text"), F.col("coreq_tree").alias("corequisite_tree"), F.col("exclusion").alias("credit_exclusion_text"),
        exclusions.alias("credit_exclusions"), notes.alias("notes"), F.col("unrepresented").alias("unrepresented_requirements"), "parse_status", F.col("coreq_status").alias("coreq_parse_status"),
        F.col("url").alias("source_url"),
    )


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(course_pages.courses(spark, sf_dir), _vocabulary(spark, sf_dir))


def _flat(rows: DataFrame) -> DataFrame:
    """Arrays as text, so that results compare in any engine."""
    lists = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    return rows.withColumns({c: F.array_join(c, "|") for c in lists})


def build_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_built(spark, sf_dir))


def course_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card of text per course: status, code, title, raw text, tree, corequisite, exclusions, notes."""
    return _built(spark, sf_dir).select("code", render.card().alias("card"))


def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undergraduate courses to look at: prerequisites that vary by section, genuine gaps, partial readings, with a snippet of the text."""
    rows = _built(spark, sf_dir).where(F.col("level") < UNDERGRAD)
    varies = F.exists("notes", lambda n: n.contains("vary by section"))
    unread = F.col("parse_status") == "unparsed"
    kind = F.when(unread & varies, "varies").when(unread & F.col("prerequisites_text").isNotNull(), "gap").when(F.col("parse_status") == "partial", "partial")
    text = F.col("prerequisites_text")
    snippet = F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET), F.lit("..."))).otherwise(text)
    return rows.select(kind.alias("kind"), "code", snippet.alias("snippet"), F.array_join("notes", "; ").alias("notes")).where("kind is not null")


def subject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undergraduate status shares by subject, worst first, and how many courses have requirement text."""
    rows = rt.texts(spark, sf_dir).where(level_of(F.col("code")) < UNDERGRAD)
    share = lambda s: (100.0 * F.count_if(F.col("parse_status") == s) / F.count("*")).cast("double").alias(f"pct_{s}")
    groups = rows.groupBy("subject").agg(F.count("*").alias("n"), *[share(s) for s in ("parsed", "partial", "unparsed")], F.count("sentence").alias("with_text"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("pct_parsed", "subject")))  # a row a subject


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset's envelope: how many courses, subjects, trees, exclusions, corequisites and incomplete readings it has."""
    return _built(spark, sf_dir).agg(
        F.count("*").alias("courses"), F.count_distinct("subject").alias("subjects"), F.count("prerequisite_tree").alias("with_tree"), F.count_if(F.size("credit_exclusions") > 0).alias("with_exclusions"),
        F.count("corequisite_tree").alias("with_coreq"), F.count_if(F.size("unrepresented_requirements") > 0).alias("with_unrepresented"),
    )


def read_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "shapes")
    rows = scratch.save(shapes.rows(spark, sf_dir), "texts")  # read twice: the edges behind them are found once
    read = grammar.parse(rows, "pk", "says", "home", shapes.vocabulary(spark, sf_dir))
    return scratch.save(rows.select("pk", "code").join(read, "pk"), "read")


def parse_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shapes(spark, sf_dir).select("code", "tree", "parse_status", F.array_join("notes", "|").alias("notes"), F.array_join("unrepresented", "|").alias("unrepresented"))


def requirement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement in the trees as a student reads it, and the key by which two are the same."""
    leaves = trees.nodes_of(read_shapes(spark, sf_dir), "code", "tree").where("type in ('COURSE', 'LEVEL_MIN')").withColumnRenamed("code", "needed")
    known = cat.courses(spark, sf_dir).select(F.col("code").alias("needed"), F.lit(True).alias("known"))
    leaves = leaves.join(known, "needed", "left")
    kind, external = F.when(F.col("type") == "COURSE", "course").otherwise("level"), (F.col("type") == "COURSE") & F.col("known").isNull()
    args = (kind, F.col("needed"), F.col("subject"), F.col("min_level"))
    return leaves.select(F.col("course").alias("code"), "path", requirement_key(*args).alias("requirement"), describe_requirement(*args, external).alias("label"))


def tree_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students and courses whose whole tree, as read from the text, is met: levels and courses the catalogue lacks included."""
    scratch = Scratch(spark, "tree-eligibility")
    read = read_shapes(spark, sf_dir)
    nodes = scratch.save(trees.nodes_of(read, "code", "tree"), "nodes")
    taken = scratch.save(cat.transcript(spark, sf_dir).select("student", cat.code_of(F.col("pk")).alias("code")), "taken")
    needs, mixed = (scratch.save(rows, name) for rows, name in zip(trees.level_needs(nodes), ("levels", "mixed"), strict=True))
    verdict = evaluate.verdict(F.lit(True), F.lit(False), F.col("parse_status"), (F.size("unrepresented") > 0).cast("int"))
    own = read.select(F.col("code").alias("course"), verdict.alias("eligible"))
    best = scratch.save(trees.best_levels(taken), "best")
    by_level = trees.level_pairs(needs.join(own, "course"), best, scratch)
    met = trees.satisfied_otherwise(nodes, taken, needs, mixed, scratch, best).join(own, "course")
    columns = ("student", F.col("course").alias("code"), "eligible")
    return by_level.select(*columns).union(met.select(*columns))


_PARTS = "list_filter([intro, sentence, coreq, exclusion, note, reverse], lambda s: s IS NOT NULL)"
_SAID = f"""{_WITH},
page AS (
  SELECT *, length(description) >= {html.LEAST_CHARS} AS told, pk % 5 <> 4 AS has_units FROM (SELECT *, array_to_string({_PARTS}, ' ') AS description FROM tree)),
built AS (
  SELECT code, split_part(code, ' ', 2) AS number, subject, CASE WHEN number < 1000 THEN number ELSE number // 10 END AS level, CASE WHEN pk % 7 <> 3 THEN title END AS title,
         CASE WHEN has_units THEN CASE WHEN pk % 3 = 0 THEN 1.5 ELSE 3.0 END END :: DOUBLE AS credits, CASE WHEN has_units THEN {course_pages.UNITS} END AS credits_text,
         CASE WHEN pk % 4 < 3 THEN 'Faculty of Science' WHEN NOT told THEN 'Faculty of Arts' END AS faculty, CASE WHEN pk % 11 <> 5 THEN {course_pages.TERM} END AS effective_term,
         CASE WHEN told THEN intro END AS description, CASE WHEN told THEN sentence END AS prerequisites_text, told AND sentence IS NOT NULL AS prerequisites_field_present,
         CASE WHEN told THEN tree END AS prerequisite_tree, CASE WHEN told THEN coreq END AS corequisites_text, CASE WHEN told AND coreq IS NOT NULL THEN next_code END AS corequisite_tree,
         CASE WHEN told THEN exclusion END AS credit_exclusion_text, CASE WHEN told AND exclusion IS NOT NULL THEN ex_code ELSE '' END AS credit_exclusions,
         CASE WHEN NOT told THEN '' WHEN pk % 10 = 7 THEN '{grammar.VARIES_NOTE}' WHEN x IS NULL THEN '' WHEN pk % 20 = 5 THEN 'could not interpret: a reading list agreed in advance'
           WHEN pk % 10 IN (3, 5) THEN 'permission of the Department|permission of the Department{NOT_ENFORCED}' WHEN pk % 30 = 1 THEN concat('not required, mentioned only as an aside: ', code, ' recommended') ELSE '' END AS notes,
         CASE WHEN told AND x IS NOT NULL AND pk % 20 = 5 THEN 'a reading list agreed in advance' ELSE '' END AS unrepresented_requirements,
         CASE WHEN told THEN read_status ELSE 'parsed' END AS parse_status, 'parsed' AS coreq_parse_status, {course_pages.url_sql("code")} AS source_url, pk, told, has_units, description AS whole
  FROM page)"""
_SHAPES = f"{_WITH}, {shapes.SQL}"
_COLUMNS = (
    "code, number, subject, level, title, credits, credits_text, faculty, effective_term, description, prerequisites_text, prerequisites_field_present, prerequisite_tree, corequisites_text, "
    "corequisite_tree, credit_exclusion_text, credit_exclusions, notes, unrepresented_requirements, parse_status, coreq_parse_status, source_url"
)

QUERIES = {
    "subject_registry": subject_registry, "course_numbers": course_numbers, "course_numbers_limited": course_numbers_limited, "missing_pages": missing_pages, "course_fields": course_fields,
    "build_courses": build_courses, "course_cards": course_cards, "report_lists": report_lists, "subject_report": subject_report, "dataset_counts": dataset_counts, "parse_shapes": parse_shapes,
    "requirement_labels": requirement_labels, "tree_eligibility": tree_eligibility,
}

ORACLE_SQL = {
    "subject_registry": f"""WITH {cat.SQL} SELECT DISTINCT lower(subject) AS slug, subject AS code, concat('Study Area ', substr(subject, 4, 1)) AS name, pk % 25 % 3 = 0 AS science FROM course""",
    "course_numbers": f"""WITH {cat.SQL}, n AS (SELECT lower(subject) AS slug, CAST(floor((number - 100) / {course_pages.PER_INDEX}) AS INT) AS page, number FROM course)
        SELECT slug, page, CAST(row_number() OVER (PARTITION BY slug, page ORDER BY number DESC) - 1 AS INT) AS pos, CAST(number AS VARCHAR) AS number FROM n""",
    "course_numbers_limited": f"""WITH {cat.SQL}, n AS (SELECT lower(subject) AS slug, number, row_number() OVER (PARTITION BY subject ORDER BY floor((number - 100) / {course_pages.PER_INDEX}), number DESC) AS i FROM course)
        SELECT slug, CAST(number AS VARCHAR) AS number FROM n WHERE i <= {PER_SUBJECT}""",
    "missing_pages": f"WITH {cat.SQL} SELECT {course_pages.url_sql('code')} AS url FROM course WHERE pk % 10 = 0",
    "course_fields": f"""{_SAID} SELECT source_url AS url, code, number, title, effective_term, credits_text, credits AS units, faculty, CASE WHEN told THEN whole END AS description,
        concat_ws('|', CASE WHEN title IS NULL THEN concat('could not parse code/title out of h1 ''', (SELECT title FROM course c WHERE c.pk = b.pk), '''') END,
          CASE WHEN NOT has_units THEN 'no units string found' END, CASE WHEN NOT told THEN 'no description paragraph found (>={html.LEAST_CHARS} chars)' END) AS warnings FROM built b""",
    "build_courses": f"{_SAID} SELECT {_COLUMNS} FROM built",
    "report_lists": f"""{_SAID}, kinds AS (
          SELECT CASE WHEN parse_status = 'unparsed' AND contains(notes, 'vary by section') THEN 'varies' WHEN parse_status = 'unparsed' AND prerequisites_text IS NOT NULL THEN 'gap'
            WHEN parse_status = 'partial' THEN 'partial' END AS kind, code, prerequisites_text AS t, replace(notes, '|', '; ') AS notes FROM built WHERE level < {UNDERGRAD})
        SELECT kind, code, CASE WHEN length(t) > {SNIPPET} THEN left(t, {SNIPPET}) || '...' ELSE t END AS snippet, notes FROM kinds WHERE kind IS NOT NULL""",
    "subject_report": f"""{_WITH}, g AS (SELECT subject, count(*) AS n, """ + ", ".join(f"100.0 :: DOUBLE * count(*) FILTER (WHERE parse_status = '{s}') / count(*) AS pct_{s}" for s in ("parsed", "partial", "unparsed")) + f""", count(sentence) AS with_text
          FROM texts WHERE CASE WHEN number < 1000 THEN number ELSE number // 10 END < {UNDERGRAD} GROUP BY subject)
        SELECT *, CAST(row_number() OVER (ORDER BY pct_parsed, subject) AS INT) AS place FROM g""",
    "dataset_counts": f"""{_SAID} SELECT count(*) AS courses, count(DISTINCT subject) AS subjects, count(prerequisite_tree) AS with_tree, count(*) FILTER (WHERE credit_exclusions <> '') AS with_exclusions,
        count(corequisite_tree) AS with_coreq, count(*) FILTER (WHERE unrepresented_requirements <> '') AS with_unrepresented FROM built""",
    "parse_shapes": f"""{_SHAPES} SELECT code, tree, CASE WHEN k IN (5, 8) THEN 'partial' ELSE 'parsed' END AS parse_status,
        CASE k WHEN 5 THEN concat('any 300-level course (subject assumed to be ', subject, ')') WHEN 8 THEN 'could not interpret: {shapes.UNKNOWN}' ELSE '' END AS notes,
        CASE k WHEN 8 THEN '{shapes.UNKNOWN}' ELSE '' END AS unrepresented FROM shape""",
    "requirement_labels": f"""{_SHAPES} SELECT code, path, CASE WHEN leaf IS NULL THEN concat('level:', subj, ':', lvl) ELSE concat('course:', leaf) END AS requirement,
        CASE WHEN leaf IS NULL THEN concat('any ', lvl, '-level ', subj, ' course') WHEN leaf = '{shapes.OUTSIDE}' THEN concat(leaf, ' (not tracked here — verify yourself)') ELSE leaf END AS label FROM shape_leaf""",
    "tree_eligibility": f"{_SHAPES} SELECT student, code, CASE WHEN k = 8 THEN NULL ELSE true END AS eligible FROM shape_sat",
    "course_cards": f"""{_SAID} SELECT code, {render.CARD_SQL} AS card FROM built""",
}
