"""Requirement trees as text: outlines, one-line lists, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE, OPEN = "[x] ", "[ ] "
LABELS = {"AND": "ALL of these", "OR": "ANY ONE of these"}


def label(kind: Column, code: Column) -> Column:
    return F.when(kind == "AND", LABELS["AND"]).when(kind == "OR", LABELS["OR"]).otherwise(code)


def outline(nodes: DataFrame, code: Column, mark: Column | None = None) -> DataFrame:
    """course, outline: one line a node, indented by depth, in tree order; leaves may carry a mark."""
    line = F.concat(F.repeat(F.lit("    "), F.col("depth")), F.when(F.col("type") == "COURSE", mark).otherwise("") if mark is not None else F.lit(""), label(F.col("type"), code))
    lines = nodes.select("course", "path", line.alias("line"))
    return lines.groupBy("course").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def one_line(nodes: DataFrame, code: Column) -> DataFrame:
    """course, line: flat trees as `A or B` / `A and B`; trees with a nested node are left out."""
    flat = nodes.withColumn("deepest", F.max("depth").over(Window.partitionBy("course"))).where("deepest <= 1")
    root = F.max(F.when(F.col("path") == "r", F.col("type")))
    leaves = F.array_sort(F.collect_list(F.when(F.col("type") == "COURSE", F.struct("ord", code.alias("code")))))
    rows = flat.groupBy("course").agg(root.alias("root"), leaves.alias("leaves"))
    word = F.when(F.col("root") == "AND", " and ").otherwise(" or ")
    joined = F.aggregate(F.transform("leaves", lambda x: x["code"]), F.lit(None).cast("string"), lambda s, c: F.when(s.isNull(), c).otherwise(F.concat(s, word, c)))
    return rows.select("course", joined.alias("line"))


MARKS = {"parsed": "[OK]", "partial": "[~~]", "unparsed": "[!!]"}
RAW_NONE, TREE_NONE, TREE_UNREAD = "(no prerequisite text)", "(no prerequisites)", "(could not be parsed -- see the raw text above)"


def card() -> Column:
    """A course's card: a line for its status, code and title, its raw text and tree, and one for what else it has.

    Without a tree the card tells whether nothing is required or the text could not be read.
    """
    mark = F.coalesce(*[F.when(F.col("parse_status") == s, m) for s, m in MARKS.items()], F.lit("[?]"))
    no_tree = F.when(F.col("parse_status") == "unparsed", TREE_UNREAD).otherwise(TREE_NONE)
    optional = lambda label, value: F.when(value != "", F.concat(F.lit(f"  {label}: "), value))
    return F.concat_ws(
        "\n",
        F.concat_ws(" ", mark, "code", F.lit("--"), "title"), F.concat(F.lit("  raw: "), F.coalesce("prerequisites_text", F.lit(RAW_NONE))),
        F.concat(F.lit("  tree: "), F.coalesce("prerequisite_tree", no_tree)), F.concat(F.lit("  corequisite (take alongside): "), "corequisite_tree"),
        optional("credit exclusions", F.array_join("credit_exclusions", ", ")), F.when(F.size("notes") > 0, F.array_join(F.transform("notes", lambda n: F.concat(F.lit("  note: "), n)), "\n")),
    )


#: ``card`` over text columns, lists joined by `|`.
CARD_SQL = f"""concat_ws(chr(10), concat_ws(' ', CASE parse_status WHEN 'parsed' THEN '[OK]' WHEN 'partial' THEN '[~~]' WHEN 'unparsed' THEN '[!!]' ELSE '[?]' END, code, '--', title),
  '  raw: ' || coalesce(prerequisites_text, '{RAW_NONE}'), '  tree: ' || coalesce(prerequisite_tree, CASE WHEN parse_status = 'unparsed' THEN '{TREE_UNREAD}' ELSE '{TREE_NONE}' END),
  '  corequisite (take alongside): ' || corequisite_tree, CASE WHEN credit_exclusions <> '' THEN '  credit exclusions: ' || replace(credit_exclusions, '|', ', ') END,
  CASE WHEN notes <> '' THEN '  note: ' || replace(notes, '|', chr(10) || '  note: ') END)"""
