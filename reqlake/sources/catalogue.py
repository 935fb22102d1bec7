"""A requirement catalogue derived from the sales tables: parts are courses, shared orders are prerequisites.

``courses``, ``edges``, ``exclusions``, ``transcript`` and ``nodes`` are plain DataFrames; ``SQL`` is the same derivation as
common table expressions.  A course's requirement is the conjunction, over its groups, of the disjunction of each
group's courses; nodes with one child collapse.  Bands strictly decrease along edges, so chains have at most 7 hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqlake.storage import shuffled, table

BANDS = 8
MOST_EDGES = 4
SUBJECTS = 25
LINES = 500_000  #: order lines to a partition
KEYS = 500_000  #: courses whose keys may be broadcast, some 20 MB

SQL = f"""
course AS (
  SELECT p_partkey AS pk, concat('SUB', chr(CAST(65 + p_partkey % {SUBJECTS} AS INT))) AS subject,
         100 + CAST(floor(p_partkey / {SUBJECTS}) AS INT) AS number,
         concat('SUB', chr(CAST(65 + p_partkey % {SUBJECTS} AS INT)), ' ', CAST(100 + CAST(floor(p_partkey / {SUBJECTS}) AS INT) AS VARCHAR(10))) AS code,
         p_name AS title, CAST(floor((p_partkey * {BANDS}) / (SELECT max(p_partkey) + 1 FROM part)) AS INT) AS band,
         CASE WHEN p_partkey % 10 = 7 THEN 'unparsed' WHEN p_partkey % 10 IN (3, 5) THEN 'partial' ELSE 'parsed' END AS parse_status,
         CASE WHEN p_partkey % 20 = 5 THEN 1 ELSE 0 END AS has_unrepresented
  FROM part),
pair AS (
  SELECT DISTINCT a.l_partkey AS p, b.l_partkey AS q
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  JOIN course ca ON ca.pk = a.l_partkey JOIN course cb ON cb.pk = b.l_partkey
  WHERE cb.band < ca.band),
edge AS (
  SELECT p, q, rn, CAST(floor((rn - 1) / 2) AS INT) AS grp
  FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY (q * 7919 + p * 31) % 10007, q) AS rn FROM pair) t
  WHERE rn <= {MOST_EDGES}),
excl AS (SELECT a.pk, b.pk AS ex FROM course a JOIN course b ON b.pk = a.pk + 1 WHERE a.pk % 40 = 0),
transcript AS (
  SELECT student, pk, row_number() OVER (PARTITION BY student ORDER BY ok, ln, pk) AS pos
  FROM (SELECT o_custkey AS student, l_partkey AS pk, l_orderkey AS ok, l_linenumber AS ln,
               row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey) t
  WHERE rn = 1)"""


def code_of(pk: Column) -> Column:
    return F.concat(F.lit("SUB"), F.char((65 + pk % SUBJECTS).cast("int")), F.lit(" "), (100 + F.floor(pk / SUBJECTS).cast("int")).cast("string"))


def _band(pk: Column, size: Column) -> Column:
    return F.floor(pk * BANDS / size).cast("int")


def _size(spark: SparkSession, sf_dir: str) -> Column:
    """One more than the largest key, as a scalar subquery."""
    return table(spark, sf_dir, "part").select(F.coalesce(F.max("p_partkey"), F.lit(0)) + 1).scalar()


def _known(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The courses' keys as the side of a join: left to Spark while they are few, and shuffled beyond KEYS."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(name))
    return shuffled(keys) if keys.count() > KEYS else keys


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pk, subject, number, code, title, band, parse_status, has_unrepresented; one row per part."""
    pk = F.col("p_partkey")
    status = F.when(pk % 10 == 7, "unparsed").when((pk % 10).isin(3, 5), "partial").otherwise("parsed")
    return table(spark, sf_dir, "part").select(
        pk.alias("pk"), F.concat(F.lit("SUB"), F.char((65 + pk % SUBJECTS).cast("int"))).alias("subject"), (100 + F.floor(pk / SUBJECTS).cast("int")).alias("number"), code_of(pk).alias("code"),
        F.col("p_name").alias("title"), _band(pk, _size(spark, sf_dir)).alias("band"), status.alias("parse_status"), F.when(pk % 20 == 5, 1).otherwise(0).alias("has_unrepresented"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p, q, rn, grp: course p needs q as one of its group grp; at most MOST_EDGES a course.

    An order's lines meet in one shuffle, whose partitions keep their size however many lines there are.
    """
    size = _size(spark, sf_dir)
    parts = _known(spark, sf_dir, "pk")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("pk")).where("o is not null")
    n = lines.count() // LINES + spark.sparkContext.defaultParallelism
    orders = lines.join(parts, "pk", "left_semi").repartition(n, "o").groupBy("o").agg(F.collect_set("pk").alias("pks"))
    pairs = orders.select(F.explode("pks").alias("p"), "pks").select("p", F.explode("pks").alias("q")).where(_band(F.col("q"), size) < _band(F.col("p"), size))
    pairs = pairs.repartition(n, "p", "q").distinct()
    order = Window.partitionBy("p").orderBy((F.col("q") * 7919 + F.col("p") * 31) % 10007, "q")
    ranked = pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MOST_EDGES)
    return ranked.withColumn("grp", F.floor((F.col("rn") - 1) / 2).cast("int"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pk, ex: credit in ex excludes pk."""
    pk = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"))
    return pk.where("pk % 40 = 0").withColumn("ex", F.col("pk") + 1).join(_known(spark, sf_dir, "ex"), "ex", "left_semi").select("pk", "ex")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student, pk, pos: the distinct courses each customer has ordered, in order of first purchase."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("ok"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_linenumber").alias("ln"))
    first = orders.join(items, "ok").groupBy("student", "pk").agg(F.min(F.struct("ok", "ln")).alias("at"))
    return first.select("student", "pk", F.row_number().over(Window.partitionBy("student").orderBy("at.ok", "at.ln", "pk")).alias("pos"))


def nodes(edge: DataFrame) -> DataFrame:
    """course, path, parent, ord, depth, type, code_pk: requirement trees as adjacency rows.

    The root's path is 'r'; a node of one child collapses into it.
    """
    g = edge.groupBy("p", "grp").agg(F.count("*").alias("n"))
    per = edge.groupBy("p").agg(F.count_distinct("grp").alias("groups"))
    leaf = edge.join(g, ["p", "grp"]).join(per, "p")
    within = F.row_number().over(Window.partitionBy("p", "grp").orderBy("rn")) - 1
    top = F.when(F.col("groups") > 1, F.concat(F.lit("r."), F.col("grp").cast("string"))).otherwise("r")
    leaf = leaf.withColumn("i", within).withColumn("top", top)
    single = F.col("n") == 1
    path = F.when(single, F.col("top")).otherwise(F.concat("top", F.lit("."), F.col("i").cast("string")))
    leaves = leaf.select(F.col("p").alias("course"), path.alias("path"), F.col("q").alias("code_pk"), F.lit("COURSE").alias("type"))
    ors = leaf.where(~single & (F.col("i") == 0)).select(F.col("p").alias("course"), F.col("top").alias("path"), F.lit(None).cast("long").alias("code_pk"), F.lit("OR").alias("type"))
    ands = per.where("groups > 1").select(F.col("p").alias("course"), F.lit("r").alias("path"), F.lit(None).cast("long").alias("code_pk"), F.lit("AND").alias("type"))
    every = leaves.union(ors).union(ands)
    parent = F.when(F.col("path") == "r", F.lit(None)).otherwise(F.regexp_replace("path", r"\.\d+$", ""))
    order = F.coalesce(F.nullif(F.regexp_extract("path", r"\.(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    depth = F.size(F.split("path", r"\.")) - 1
    return every.select("course", "path", parent.alias("parent"), order.alias("ord"), depth.alias("depth"), "type", "code_pk")


#: ``nodes`` as common table expressions after those of SQL.
NODES_SQL = """
per AS (SELECT p, count(DISTINCT grp) AS groups FROM edge GROUP BY p),
leaf AS (
  SELECT e.p, e.q, count(*) OVER (PARTITION BY e.p, e.grp) AS n, row_number() OVER (PARTITION BY e.p, e.grp ORDER BY rn) - 1 AS i,
         CASE WHEN groups > 1 THEN 'r.' || e.grp ELSE 'r' END AS top
  FROM edge e JOIN per USING (p)),
raw_node AS (
  SELECT p AS course, CASE WHEN n = 1 THEN top ELSE top || '.' || i END AS path, q AS code_pk, 'COURSE' AS type FROM leaf
  UNION ALL SELECT p, top, NULL, 'OR' FROM leaf WHERE n > 1 AND i = 0
  UNION ALL SELECT p, 'r', NULL, 'AND' FROM per WHERE groups > 1),
node AS (
  SELECT course, path, CASE WHEN path = 'r' THEN NULL ELSE regexp_replace(path, '\\.\\d+$', '') END AS parent,
         coalesce(TRY_CAST(nullif(regexp_extract(path, '\\.(\\d+)$', 1), '') AS INT), 0) AS ord, len(string_split(path, '.')) - 1 AS depth, type, code_pk
  FROM raw_node)"""
