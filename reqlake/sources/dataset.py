"""The catalogue as JSON: trees as nested objects, a line per course, an envelope, and all of it read back.

A tree is ``{"type": "AND" or "OR", "children": [...]}``, ``{"type": "COURSE", "code", "external"}`` or
``{"type": "LEVEL_MIN", "subject", "min_level"}``.  In a dataset it is a nested object of its course's line; read back it is
a VARIANT, and ``nodes_of_json`` gives its node rows.  A line that is no JSON, breaks the schema or has no code is kept
apart and never dropped unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
DAMAGED = "_damaged"
TREES = ("prerequisite_tree", "corequisite_tree")
COLUMNS = (
    "code string, number string, subject string, level int, title string, credits double, credits_text string, faculty string, effective_term string, description string, prerequisites_text string, "
    "prerequisites_field_present boolean, prerequisite_tree variant, corequisites_text string, corequisite_tree variant, credit_exclusion_text string, credit_exclusions array<string>, "
    "notes array<string>, unrepresented_requirements array<string>, parse_status string, coreq_parse_status string, source_url string"
)


def _written(nodes: DataFrame, name: str, opening: Column, leaf: Column, closing: str, between: str) -> DataFrame:
    """course and the text of its tree: nodes in walking order, each followed by the ends of what it is the last node of."""
    path = F.split("path", r"\.")
    place = F.transform(F.slice(path, 2, F.size(path)), lambda p: p.cast("int"))
    inner = F.coalesce(F.col("type").isin("AND", "OR"), F.lit(False))
    node = F.struct(place.alias("place"), inner.alias("inner"), F.when(inner, opening).otherwise(leaf).alias("said"))
    trees = nodes.groupBy("course").agg(F.array_sort(F.collect_list(node)).alias("walk"))  # a tree is one text's

    def step(n: Column, i: Column) -> Column:
        depth = F.size(n["place"])
        before, after = F.size(F.get("walk", i - 1)["place"]), F.coalesce(F.size(F.get("walk", i + 1)["place"]), F.lit(0))
        ends = F.when((i + 1 < F.size("walk")) & (after > depth), 0).otherwise(depth - after + n["inner"].cast("int"))
        return F.concat(F.when((i > 0) & (before >= depth), between).otherwise(""), n["said"], F.repeat(F.lit(closing), ends))

    return trees.select("course", F.array_join(F.transform("walk", step), "").alias(name))


def tree_json(nodes: DataFrame) -> DataFrame:
    """course, tree: node rows (course, path, type, code, external, subject, min_level) as nested JSON; one shuffle.

    A node of another type is written with its type alone; a course without nodes has no row.
    """
    kind = F.col("type")
    course, level = F.to_json(F.struct("type", "code", "external")), F.to_json(F.struct("type", "subject", "min_level"))
    leaf = F.when(kind == "COURSE", course).when(kind == "LEVEL_MIN", level).otherwise(F.to_json(F.struct("type")))
    return _written(nodes, "tree", F.concat(F.lit('{"type":"'), kind, F.lit('","children":[')), leaf, "]}", ",")


def tree_notation(nodes: DataFrame) -> DataFrame:
    """course, tree: node rows in the notation that ``trees.nodes_of`` reads."""
    level = F.concat(F.lit("L("), F.col("min_level").cast("string"), F.lit(" "), F.col("subject"), F.lit(")"))
    leaf = F.coalesce(F.when(F.col("type") == "LEVEL_MIN", level).otherwise(F.col("code")), F.lit("?"))
    return _written(nodes, "tree", F.when(F.col("type") == "AND", "A(").otherwise("O("), leaf, ")", ", ")


def nodes_of_json(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """Node rows of trees that are VARIANTs: course, path, parent, ord, depth, type, code, external, subject, min_level.

    Trees are opened level by level inside their row, as often as they have brackets at most.  Null trees have no nodes; what
    is not as it should be (a type, a code, children that are no list) is null there, for ``quality`` to find.
    """
    of = "array<struct<path:array<int>,node:variant>>"
    rows = rows.where(F.col(tree).isNotNull() & ~F.is_variant_null(F.coalesce(tree, F.parse_json(F.lit("null"))))).select(F.col(key).alias("course"), F.col(tree).alias("node"))
    text = F.to_json("node")
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("node"))).cast(of)

    def children(parent: Column) -> Column:
        return F.transform(F.try_variant_get(parent["node"], "$.children", "array<variant>"), lambda c, i: F.struct(F.concat(parent["path"], F.array(i)).alias("path"), c.alias("node")))

    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.filter(F.transform(state["open"], children), lambda c: c.isNotNull()))
        return F.struct(below.alias("open"), F.concat(state["out"], state["open"]).alias("out"))

    start = F.struct(root.alias("open"), F.array().cast(of).alias("out"))
    turns = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("["), F.lit(""))))
    found = rows.select("course", F.inline(F.aggregate(turns, start, step, lambda s: s["out"])))
    named = lambda p: F.array_join(F.concat(F.array(F.lit("r")), F.transform(p, lambda i: i.cast("string"))), ".")
    depth = F.size("path")
    field = lambda name, of: F.try_variant_get("node", f"$.{name}", of).alias(name)
    return found.select(
        "course", named(F.col("path")).alias("path"), F.when(depth > 0, named(F.slice("path", 1, F.greatest(depth - 1, F.lit(0))))).alias("parent"), F.when(depth > 0, F.try_element_at("path", F.lit(-1))).otherwise(0).alias("ord"),
        depth.alias("depth"), field("type", "string"), field("code", "string"), field("external", "boolean"), field("subject", "string"), field("min_level", "int"),
    )


def write_dataset(courses: DataFrame, path: str, source: str) -> None:
    """Courses (``COLUMNS``, trees as JSON text) as JSON lines below ``path``, and then the envelope with their number.

    The number is observed while the lines are written.  A dataset without an envelope was not finished.
    """
    seen = Observation()
    lines = courses.withColumns({c: F.parse_json(F.col(c).cast("string")) for c in TREES}).observe(seen, F.count(F.lit(1)).alias("n"))
    lines.write.mode("overwrite").json(f"{path}/courses")
    envelope = courses.sparkSession.createDataFrame([(SCHEMA_VERSION, source, seen.get["n"])], "schema_version int, source string, course_count long")
    envelope.coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("schema_version int, source string, course_count long").json(f"{path}/envelope")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, c (``COLUMNS``) and sound of every line; lines of white space alone are left out."""
    lines = spark.read.text(f"{path}/courses").where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    read = F.from_json("value", f"{COLUMNS}, {DAMAGED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED})
    return lines.withColumn("c", read).withColumn("sound", F.col(f"c.{DAMAGED}").isNull() & F.col("c.code").isNotNull())


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The courses (``COLUMNS``), and the damaged lines as (file, line).  Lines of white space alone are neither."""
    lines = _lines(spark, path)
    return lines.where("sound").select("c.*").drop(DAMAGED), lines.where("not sound").select("file", F.col("value").alias("line"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """read, damaged: how many lines ``read_dataset`` reads and how many it finds damaged, by one reading of them."""
    return _lines(spark, path).agg(F.count_if("sound").alias("read"), F.count_if(~F.col("sound")).alias("damaged"))
