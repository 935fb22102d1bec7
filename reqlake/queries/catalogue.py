"""Queries over the catalogue itself: projections, search, counts, references, checks, renderings, pages, completed sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake.functions.codes import level_of, normalize_code, print_filename as filename, subject_of
from reqlake.operators import graph, quality, render
from reqlake.sources import catalogue as cat
from reqlake.sources import pages as html
from reqlake.sources.markup import BLOCKS
from reqlake.storage import Scratch, table
from reqlake.streaming import completed

SEARCH, SEARCH_LIMIT = "an", 40
HIGH_SCHOOL = ("MATH", "PURE MATH", "BIOLOGY", "CHEMISTRY", "PHYSICS")
UNDERGRAD = 500
SITE = "https://catalogue.example.org/"

#: Expressions that Spark and the oracle share: columns of courses and of tree nodes with defects by rule, in this order.
DAMAGE = {
    "url": f"CASE WHEN pk % 90 = 5 THEN NULL WHEN pk % 90 = 6 THEN 'http://elsewhere.example.org/' ELSE concat('{SITE}', code) END",
    "text": "CASE WHEN has_tree IS NOT NULL AND pk % 70 <> 9 THEN 'Prerequisites: as in the tree.' END",
    "parse_status": "CASE WHEN pk % 110 = 8 THEN 'guessed' ELSE parse_status END",
    "has_unrepresented": "CASE WHEN pk % 130 = 11 THEN 1 ELSE has_unrepresented END",
    "subject": "CASE WHEN pk % 140 = 12 THEN NULL ELSE subject END",
    "code": "CASE WHEN pk % 150 = 13 THEN lower(code) WHEN pk % 150 = 14 THEN 'SUBA 100' ELSE code END",
}
NODE_DAMAGE = {
    "code": "CASE WHEN type = 'COURSE' AND pk % 75 <> 21 THEN plain END",
    "external": "CASE WHEN type = 'COURSE' THEN CASE pk % 65 WHEN 22 THEN NULL WHEN 23 THEN true ELSE false END END",
    "subject": "CASE WHEN type = 'OR' AND pk % 85 = 24 THEN 'SUBA' END",
    "min_level": "CASE WHEN type = 'OR' AND pk % 85 = 25 THEN 300 END",
    "type": "CASE WHEN type = 'OR' AND pk % 85 IN (24, 25) THEN 'LEVEL_MIN' WHEN type = 'OR' AND pk % 85 = 26 THEN 'XOR' ELSE type END",
}


def catalogue_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    rows = cat.courses(spark, sf_dir)
    return rows.select("code", subject_of(code).alias("subject"), level_of(code).alias("level"), "title", F.when(level_of(code) < UNDERGRAD, "undergrad").otherwise("graduate").alias("band"), normalize_code(F.lower(code)).alias("normalized"))


def search(courses: DataFrame, query: str = "", subject: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first courses, in catalogue order, whose code or title holds the trimmed query in any case; of one subject if given.

    An empty query finds the first of all.  The limit is the feature: a list to choose from.
    """
    text = query.strip().lower()
    rows = courses if subject is None else courses.where(F.col("subject") == subject)
    if text:
        rows = rows.where(F.lower("code").contains(text) | F.lower(F.coalesce("title", F.lit(""))).contains(text))
    return rows.orderBy("pk").limit(limit).select("pk", "code", "title")


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(cat.courses(spark, sf_dir), SEARCH)


def search_in_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(cat.courses(spark, sf_dir), "  Ro ", "SUBC")


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(cat.courses(spark, sf_dir))


def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.courses(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))


def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts and percentages of all, undergraduate and graduate courses, by grouping sets in one pass."""
    rows = cat.courses(spark, sf_dir).withColumn("band", F.when(level_of(F.col("code")) < UNDERGRAD, "undergrad").otherwise("graduate"))
    counts = rows.rollup("parse_status", "band").agg(F.count("*").alias("n"), F.grouping("band").alias("all"), F.grouping("parse_status").alias("top")).where("top = 0")
    counts = counts.select(F.when(F.col("all") == 1, "all").otherwise(F.col("band")).alias("grp"), "parse_status", "n")
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    return counts.join(totals, "grp").select("grp", "parse_status", "n", (100.0 * F.col("n") / F.col("total")).cast("double").alias("pct"))


def status_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda s: (100.0 * F.count_if(F.col("parse_status") == s) / F.count("*")).cast("double")
    return cat.courses(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), *[share(s).alias(f"pct_{s}") for s in quality.STATUSES])


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.courses(spark, sf_dir).groupBy("subject").pivot("parse_status", list(quality.STATUSES)).count().fillna(0)


def _coreqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    return pk.select("p", F.explode(F.array(F.col("p") + 1, F.col("p") + 2)).alias("q"))


def external_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every referenced course, and whether the catalogue lacks it."""
    known = cat.courses(spark, sf_dir).select(F.col("pk").alias("q"), F.lit(True).alias("known"))
    refs = cat.edges(spark, sf_dir).select("p", "q").union(_coreqs(spark, sf_dir))
    return refs.distinct().join(known, "q", "left").select("p", cat.code_of(F.col("q")).alias("code"), F.col("known").isNull().alias("external"))


def external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_flags(spark, sf_dir).where("external").select("code").distinct()


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External references whose subject the catalogue does have."""
    subjects = cat.courses(spark, sf_dir).select("subject").distinct()
    return external_refs(spark, sf_dir).withColumn("subject", subject_of(F.col("code"))).join(subjects, "subject", "left_semi").select("code")


def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = cat.courses(spark, sf_dir).select(F.col("subject").alias("code"))
    nations = table(spark, sf_dir, "nation").select(F.upper(F.substring("n_name", 1, 4)).alias("code"))
    return codes.union(nations).union(spark.createDataFrame([(c,) for c in HIGH_SCHOOL], "code string")).distinct()


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelled names with their codes; where a name has several, that of the source that comes later wins."""
    regions = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("code"), F.lit(1).alias("priority"))
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.upper(F.substring("n_name", 1, 4)).alias("code"), F.lit(2).alias("priority"))
    return regions.union(nations).groupBy("name").agg(F.max_by("code", F.struct("priority", "code")).alias("code"))


def slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments looked up among the nations' slugs; an unknown slug is its own code in capitals."""
    slugs = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("slug")).agg(F.count("*").alias("n"))
    registry = name_lookup(spark, sf_dir).select(F.col("name").alias("slug"), "code")
    return slugs.join(registry, "slug", "left").select("slug", "n", F.coalesce("code", F.upper("slug")).alias("code"))


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.nodes(cat.edges(spark, sf_dir)).groupBy("course").agg(F.max("depth").cast("long").alias("depth"), F.count_if(F.col("type") == "COURSE").alias("leaves"))


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Courses, tree nodes and edges of the catalogue with defects planted by rule, so that every check has something to find."""
    edges = Scratch(spark, "verify").save(cat.edges(spark, sf_dir), "edges")
    courses = cat.courses(spark, sf_dir).join(edges.select(F.col("p").alias("pk")).distinct().withColumn("has_tree", F.lit(True)), "pk", "left")
    for name, sql in DAMAGE.items():
        courses = courses.withColumn(name, F.expr(sql))
    nodes = cat.nodes(edges).withColumnRenamed("code_pk", "of").withColumn("pk", F.col("course"))
    nodes = nodes.withColumn("plain", cat.code_of(F.col("of"))).withColumns({name: F.expr(sql) for name, sql in NODE_DAMAGE.items()})
    return courses.select("pk", "code", "subject", F.col("number").alias("level"), "url", "parse_status", "text", "has_unrepresented"), nodes.drop("pk", "of", "plain"), edges


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of the damaged catalogue: of its courses, its tree nodes, its references and its envelope."""
    scratch = Scratch(spark, "findings")
    courses, nodes, edges = _damaged(spark, sf_dir)
    courses, nodes = scratch.save(courses, "courses"), scratch.save(nodes, "nodes")
    pk = F.col("pk")
    planted = courses.where("pk % 50 = 0").select(pk.alias("p"), pk.alias("q")).union(courses.where("pk % 80 = 1").select(pk.alias("p"), (pk + 1).alias("q"))).union(courses.where("pk % 80 = 1").select((pk + 1).alias("p"), pk.alias("q")))
    links = scratch.save(edges.select("p", "q").union(planted).distinct(), "links")
    cycles = scratch.save(graph.cycle_members(links, scratch), "cycles")
    exclusions = cat.exclusions(spark, sf_dir).union(courses.where("pk % 60 = 2").select("pk", pk.alias("ex")))
    found = quality.course_findings(courses, nodes, SITE).union(quality.node_findings(courses, nodes)).union(quality.reference_findings(courses, links, _coreqs(spark, sf_dir), exclusions, cycles))
    envelope = courses.where("pk % 400 < 399").select(F.count("*").alias("course_count"))
    return found.union(quality.envelope_findings(envelope.groupBy().agg(F.sum("course_count").alias("course_count")), courses))


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by check."""
    return verify_findings(spark, sf_dir).groupBy("check", "severity").agg(F.count("*").alias("n"))


def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings and exit status: any error fails the catalogue."""
    return quality.exit_status(verify_findings(spark, sf_dir))


def outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.outline(cat.nodes(cat.edges(spark, sf_dir)), cat.code_of(F.col("code_pk")))


def coreq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corequisites of every course as one line."""
    trees = cat.nodes(_coreqs(spark, sf_dir).withColumn("rn", F.col("q") - F.col("p")).withColumn("grp", F.lit(0)))
    return render.one_line(trees, cat.code_of(F.col("code_pk")))


def print_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.courses(spark, sf_dir).select("code", filename(F.col("code")).alias("filename"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"))


def page_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.headings(table(spark, sf_dir, "pages"))


def page_first_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.first_paragraphs(table(spark, sf_dir, "pages"))


def completed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed.latest(completed.edits(table(spark, sf_dir, "events")))


_C = f"WITH {cat.SQL}"
_COREQ = "coreq AS (SELECT pk AS p, pk + 1 AS q FROM course UNION ALL SELECT pk, pk + 2 FROM course)"
_CODE = "concat('SUB', chr(CAST(65 + {0} % 25 AS INT)), ' ', CAST(100 + CAST(floor({0} / 25) AS INT) AS VARCHAR))"
_EXT = f"""{_C}, {_COREQ}, ref AS (SELECT p, q FROM edge UNION SELECT p, q FROM coreq),
flag AS (SELECT p, {_CODE.format("q")} AS code, concat('SUB', chr(CAST(65 + q % 25 AS INT))) AS subject, q NOT IN (SELECT pk FROM course) AS external FROM ref)"""
_NODES = f"{_C}, {cat.NODES_SQL}"
_LEVEL = "CASE WHEN number < 1000 THEN number ELSE number // 10 END"
_SHAPE = r"^[A-Z]{1,8}(?: [A-Z]{1,4})? \d{2,4}[A-Z]{0,2}$"
_FIND = f"""{_NODES}, {_COREQ},
c0 AS (SELECT course.* EXCLUDE (subject, parse_status, has_unrepresented, code), course.subject AS subject0, course.parse_status AS status0, course.has_unrepresented AS un0, course.code AS code0,
         CASE WHEN pk IN (SELECT p FROM edge) THEN true END AS has_tree FROM course),
bad AS (
  SELECT pk, number, has_tree, {DAMAGE["url"].replace("code", "code0")} AS url, {DAMAGE["text"]} AS text, {DAMAGE["parse_status"].replace("ELSE parse_status", "ELSE status0")} AS parse_status,
         {DAMAGE["has_unrepresented"].replace("ELSE has_unrepresented", "ELSE un0")} AS un, {DAMAGE["subject"].replace("ELSE subject", "ELSE subject0")} AS subject,
         {DAMAGE["code"].replace("(code)", "(code0)").replace("ELSE code", "ELSE code0")} AS code FROM c0),
n0 AS (SELECT node.* EXCLUDE (type), type AS type0, course AS pk, CASE WHEN code_pk IS NOT NULL THEN {_CODE.format("code_pk")} END AS plain FROM node),
badnode AS (
  SELECT course, path, parent, depth, {NODE_DAMAGE["code"].replace("type", "type0")} AS code, {NODE_DAMAGE["external"].replace("type", "type0")} AS external,
         {NODE_DAMAGE["subject"].replace("type", "type0")} AS subject, {NODE_DAMAGE["min_level"].replace("type", "type0")} AS min_level, {NODE_DAMAGE["type"].replace("type", "type0")} AS type FROM n0),
sized AS (SELECT n.*, (SELECT count(*) FROM badnode k WHERE k.course = n.course AND k.parent = n.path) AS children, c.code AS of FROM badnode n JOIN bad c ON c.pk = n.course),
link AS (SELECT p, q FROM edge UNION SELECT pk, pk FROM bad WHERE pk % 50 = 0 UNION SELECT pk, pk + 1 FROM bad WHERE pk % 80 = 1 UNION SELECT pk + 1, pk FROM bad WHERE pk % 80 = 1),
leaves AS (SELECT course, count(*) FILTER (WHERE type IN ('COURSE', 'LEVEL_MIN')) AS leaves FROM badnode GROUP BY course),
finding AS (
  SELECT 'required field' AS "check", 'error' AS severity, code, unnest(list_filter([CASE WHEN code IS NULL THEN 'code' END, CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN url IS NULL THEN 'url' END], lambda x: x IS NOT NULL)) AS message FROM bad
  UNION ALL SELECT 'code shape', 'error', code, '' FROM bad WHERE NOT regexp_matches(code, '{_SHAPE}')
  UNION ALL SELECT 'status', 'error', code, parse_status FROM bad WHERE parse_status NOT IN ('parsed', 'partial', 'unparsed')
  UNION ALL SELECT 'url', 'error', code, url FROM bad WHERE NOT starts_with(url, '{SITE}')
  UNION ALL SELECT 'unparsed with a tree', 'error', code, '' FROM bad WHERE parse_status = 'unparsed' AND has_tree
  UNION ALL SELECT 'parsed but incomplete', 'error', code, '' FROM bad WHERE parse_status = 'parsed' AND un = 1
  UNION ALL SELECT 'tree without text', 'error', code, '' FROM bad WHERE has_tree AND text IS NULL
  UNION ALL SELECT 'cannot judge and no page', 'error', code, '' FROM bad WHERE (parse_status = 'unparsed' OR (has_tree IS NULL AND un = 1)) AND url IS NULL
  UNION ALL SELECT 'needs nothing but not eligible', 'error', code, '' FROM bad WHERE parse_status = 'parsed' AND has_tree IS NULL AND un = 1
  UNION ALL SELECT 'not eligible but names nothing', 'error', code, '' FROM bad JOIN leaves ON course = pk WHERE parse_status <> 'unparsed' AND leaves = 0
  UNION ALL SELECT 'node type', 'error', of, path || ' XOR' FROM sized WHERE type = 'XOR'
  UNION ALL SELECT 'course node without a code', 'error', of, path FROM sized WHERE type = 'COURSE' AND (code IS NULL OR NOT regexp_matches(code, '{_SHAPE}'))
  UNION ALL SELECT 'course node without a flag', 'error', of, path FROM sized WHERE type = 'COURSE' AND external IS NULL
  UNION ALL SELECT 'level node without a level', 'error', of, path FROM sized WHERE type = 'LEVEL_MIN' AND min_level IS NULL
  UNION ALL SELECT 'level node without a subject', 'error', of, path FROM sized WHERE type = 'LEVEL_MIN' AND subject IS NULL
  UNION ALL SELECT 'node with one child', 'error', of, path FROM sized WHERE type IN ('AND', 'OR') AND children < 2
  UNION ALL SELECT 'external flag', 'error', of, code FROM sized WHERE type = 'COURSE' AND external <> (code NOT IN (SELECT code FROM bad WHERE code IS NOT NULL))
  UNION ALL SELECT 'own prerequisite', 'error', code, '' FROM link JOIN bad ON pk = p WHERE p = q
  UNION ALL SELECT 'own exclusion', 'error', code, '' FROM bad WHERE pk % 60 = 2
  UNION ALL SELECT 'prerequisite and corequisite', 'warn', a.code, b.code FROM (SELECT p, q FROM link INTERSECT SELECT p, q FROM coreq) JOIN bad a ON a.pk = p JOIN bad b ON b.pk = q
  UNION ALL SELECT 'dangling reference', 'warn', code, q :: VARCHAR FROM (SELECT p, q FROM coreq UNION ALL SELECT p, q FROM link) JOIN bad ON pk = p WHERE q NOT IN (SELECT pk FROM bad)
  UNION ALL SELECT 'cycle', 'warn', code, (pk - pk % 80 + 1) :: VARCHAR FROM bad WHERE pk % 80 IN (1, 2)
  UNION ALL SELECT 'duplicate', 'error', code, count(*) :: VARCHAR FROM bad WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1
  UNION ALL SELECT 'course count', 'error', NULL, n || ' ' || total FROM (SELECT count(*) FILTER (WHERE pk % 400 < 399) AS n, count(*) AS total FROM bad) WHERE n <> total)"""
_VISIBLE = "regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|noscript)\\b.*?</(?:script|style|noscript)>', '', 'g')"
_RESOLVED = "regexp_replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"  # the character references that the pages hold
_PLAIN = _RESOLVED.format("trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '[\\s]+', ' ', 'g'))")

QUERIES = {
    "catalogue_project": catalogue_project, "catalogue_search": catalogue_search, "subject_counts": subject_counts, "status_breakdown": status_breakdown, "status_by_subject": status_by_subject,
    "status_pivot": status_pivot, "external_flags": external_flags, "external_refs": external_refs, "dangling_refs": dangling_refs, "vocabulary_union": vocabulary_union, "name_lookup": name_lookup,
    "slug_lookup": slug_lookup, "tree_depth": tree_depth, "verify_findings": verify_findings, "verify_summary": verify_summary, "verify_status": verify_status, "search_in_subject": search_in_subject, "search_all": search_all, "outline_text": outline_text, "coreq_line": coreq_line,
    "print_filename": print_filename, "page_links": page_links, "page_heading": page_heading, "page_first_para": page_first_para, "completed_state": completed_state,
}

ORACLE_SQL = {
    "catalogue_project": f"{_C} SELECT code, subject, {_LEVEL} AS level, title, CASE WHEN {_LEVEL} < {UNDERGRAD} THEN 'undergrad' ELSE 'graduate' END AS band, code AS normalized FROM course",
    "catalogue_search": f"{_C} SELECT pk, code, title FROM course WHERE contains(lower(code), '{SEARCH}') OR contains(lower(coalesce(title, '')), '{SEARCH}') ORDER BY pk LIMIT {SEARCH_LIMIT}",
    "subject_counts": f"{_C} SELECT subject, count(*) AS n FROM course GROUP BY subject",
    "status_breakdown": f"""{_C}, g AS (SELECT 'all' AS grp, parse_status FROM course UNION ALL SELECT CASE WHEN {_LEVEL} < {UNDERGRAD} THEN 'undergrad' ELSE 'graduate' END, parse_status FROM course)
        SELECT grp, parse_status, count(*) AS n, 100.0 :: DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY grp) AS pct FROM g GROUP BY grp, parse_status""",
    "status_by_subject": f"{_C} SELECT subject, count(*) AS n, " + ", ".join(f"100.0 :: DOUBLE * count(*) FILTER (WHERE parse_status = '{s}') / count(*) AS pct_{s}" for s in quality.STATUSES) + " FROM course GROUP BY subject",
    "status_pivot": f"{_C} SELECT subject, " + ", ".join(f"count(*) FILTER (WHERE parse_status = '{s}') AS {s}" for s in quality.STATUSES) + " FROM course GROUP BY subject",
    "external_flags": f"{_EXT} SELECT p, code, external FROM flag",
    "external_refs": f"{_EXT} SELECT DISTINCT code FROM flag WHERE external",
    "dangling_refs": f"{_EXT} SELECT DISTINCT code FROM flag WHERE external AND subject IN (SELECT subject FROM course)",
    "vocabulary_union": f"{_C} SELECT subject AS code FROM course UNION SELECT upper(substr(n_name, 1, 4)) FROM nation UNION SELECT unnest({list(HIGH_SCHOOL)})",
    "name_lookup": "SELECT lower(n_name) AS name, max(upper(substr(n_name, 1, 4))) AS code FROM nation GROUP BY 1 UNION ALL SELECT lower(r_name), max(r_regionkey :: VARCHAR) FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation) GROUP BY 1",
    "slug_lookup": """WITH names AS (SELECT lower(n_name) AS slug, upper(substr(n_name, 1, 4)) AS code FROM nation UNION SELECT lower(r_name), r_regionkey :: VARCHAR FROM region),
        slugs AS (SELECT lower(c_mktsegment) AS slug, count(*) AS n FROM customer GROUP BY 1) SELECT slug, n, coalesce(code, upper(slug)) AS code FROM slugs LEFT JOIN names USING (slug)""",
    "tree_depth": f"{_NODES} SELECT course, max(depth) :: BIGINT AS depth, count(*) FILTER (WHERE type = 'COURSE') AS leaves FROM node GROUP BY course",
    "verify_findings": f'{_FIND} SELECT "check", severity, code, message FROM finding',
    "verify_summary": f'{_FIND} SELECT "check", severity, count(*) AS n FROM finding GROUP BY ALL',
    "verify_status": f"""{_FIND} SELECT errors, warnings, CASE WHEN errors > 0 THEN 1 ELSE 0 END :: INT AS status FROM (
        SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings FROM finding)""",
    "search_in_subject": f"{_C} SELECT pk, code, title FROM course WHERE subject = 'SUBC' AND (contains(lower(code), 'ro') OR contains(lower(coalesce(title, '')), 'ro')) ORDER BY pk LIMIT {SEARCH_LIMIT}",
    "search_all": f"{_C} SELECT pk, code, title FROM course ORDER BY pk LIMIT {SEARCH_LIMIT}",
    "outline_text": f"""{_NODES} SELECT course, string_agg(repeat('    ', depth :: INT) || CASE type WHEN 'AND' THEN 'ALL of these' WHEN 'OR' THEN 'ANY ONE of these' ELSE {_CODE.format("code_pk")} END, chr(10) ORDER BY path) AS outline
        FROM node GROUP BY course""",
    "coreq_line": f"{_C} SELECT pk AS course, {_CODE.format('(pk + 1)')} || ' or ' || {_CODE.format('(pk + 2)')} AS line FROM course",
    "print_filename": f"{_C} SELECT code, replace(code, ' ', '') || '_Graph' AS filename FROM course",
    "page_links": f"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all({_VISIBLE}, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1), lambda h: {_RESOLVED.format('h')}) AS l FROM pages), d AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l)
        SELECT page_id, unnest(range(0, len(l))) :: INT AS pos, unnest(l) AS link FROM d""",
    "page_heading": f"""WITH t AS (SELECT page_id, url, {_PLAIN.format(f"regexp_extract({_VISIBLE}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")} AS t FROM pages)
        SELECT page_id, coalesce(nullif(t, ''), list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/'))) AS title, t <> '' AS has_heading FROM t""",
    "page_first_para": f"""WITH a AS (SELECT page_id, string_split_regex(regexp_replace({_VISIBLE}, '(?is)^.*?</h1>', ''), '(?i)<p(?:\\s[^>]*)?>')[2:] AS ps FROM pages)
        SELECT page_id, list_filter(list_transform(ps, lambda p: {_PLAIN.format("regexp_replace(p, '(?is)(?:</p>|</?(?:" + "|".join(sorted(BLOCKS - {"p"})) + ")\\b).*$', '')")}), lambda t: length(t) >= {html.LEAST_CHARS})[1] AS description FROM a""",
    "completed_state": """WITH e AS (SELECT user_id, event_id % 50 AS item, ts, event_id, event_type FROM events),
        l AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn FROM e)
        SELECT user_id, item, event_type NOT IN ('purchase', 'logout') AS completed FROM l WHERE rn = 1""",
}
