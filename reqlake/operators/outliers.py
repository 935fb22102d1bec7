"""Profiles of what the grammar has no rule for, ranked by how many rows each finding touches."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlake.plans.grammar import NUMBER
from reqlake.storage import Scratch

# Words the grammar knows, in the order of their kinds (structure, nouns, qualifiers).
KNOWN_WORDS = (
    "and", "or", "one", "of", "any", "all", "both", "either", "at", "least", "a", "an", "the", "in", "for", "to", "with", "from", "on", "by", "as",
    "prerequisite", "prerequisites", "corequisite", "corequisites", "course", "courses", "class", "classes", "level", "credit", "units",
    "consent", "permission", "department", "instructor", "instructors", "equivalent", "equivalents", "knowledge", "standing", "year", "years",
    "minimum", "grade", "note", "notes", "see", "above", "below", "recommended", "required", "restricted", "students", "student", "program", "honors", "honours",
    "none", "no", "not", "is", "are", "be", "may", "must", "can", "will", "taken", "obtained", "same", "other", "additional", "determined", "defined", "differ",
    "section", "sections", "outline", "term", "first", "second", "third", "fourth",
)
WORD = r"[A-Za-z][A-Za-z'-]+"
UNKNOWN_CODE = rf"\b([A-Z][A-Za-z]{{1,7}}(?: [A-Z]{{1,4}})?)\s+({NUMBER})\b"
# From what length a text is long, and how much of each finding is shown.
LONG_CHARS, SNIPPET_CHARS, SHAPE_CHARS, LABEL_CHARS, EXAMPLES = 220, 110, 90, 80, 5
TRACKED = 65_536  #: findings the sketch of a task keeps
CANDIDATES = 60  #: findings recounted, a bit each of a long
SKETCH_LOAD, SKETCH_ERROR = 0.75, 3.5  #: of Spark's frequency sketch: its load factor, its error times slots over rows


def _sketched(findings: DataFrame, tracked: int) -> tuple[list[str], int]:
    """The findings of most rows by a mergeable frequency sketch, and the most rows that any other finding can have."""
    row = findings.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(finding, {CANDIDATES}, {tracked})").alias("top")).first()
    top = row["top"] or []
    slots = 1 << math.ceil(math.log2(tracked / SKETCH_LOAD))
    off = 0 if row["n"] <= tracked else math.ceil(SKETCH_ERROR * row["n"] / slots)  # what an estimate can be off
    return [r["item"] for r in top], max(2 * off, top[-1]["count"] + off if len(top) == CANDIDATES else 0)


def ranked(findings: DataFrame, limit: int, tracked: int = TRACKED) -> DataFrame:
    """finding, n, examples: the findings that touch most keys, with the first few of those.

    (key, finding) rows may repeat, and count once; rows without a key or a finding do not count; no rows give none.

    A sketch of fixed size names the candidates; their keys are recounted exactly, one row a key with a bit per candidate, so
    no (key, finding) pair is shuffled.  A finding touches no more keys than it has rows: if the last one listed has more keys
    than any finding outside the candidates can have rows, the list is exact.  If not (flat counts), all pairs are counted.
    """
    spark, findings = findings.sparkSession, findings.where("key is not null and finding is not null")
    candidates, others = _sketched(findings, tracked)
    if not candidates:
        return _counted(findings, limit)
    bits = F.create_map(*[F.lit(x) for i, c in enumerate(candidates) for x in (c, 1 << i)])
    masks = findings.where(F.col("finding").isin(*candidates)).groupBy("key").agg(F.bit_or(bits[F.col("finding")]).alias("mask"))
    masks = Scratch(spark, "ranked").save(masks, "masks")
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    n = masks.agg(*[F.count_if(has(i)) for i in range(len(candidates))]).first()
    best = sorted(((c, n[i], i) for i, c in enumerate(candidates)), key=lambda r: (-r[1], r[0]))[:limit]
    if others > 0 and not (len(best) == limit and best[-1][1] > others):
        return _counted(findings, limit)
    keys = masks.select("key", F.explode(F.array_compact(F.array(*[F.when(has(i), F.lit(i)) for _, _, i in best]))).alias("bit"))
    examples = _smallest(keys, "bit").groupBy("bit").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("examples"))
    return examples.join(F.broadcast(spark.createDataFrame(best, "finding string, n long, bit int")), "bit").select("finding", "n", "examples")


def _smallest(rows: DataFrame, group: str) -> DataFrame:
    """The rows of the smallest few keys of each group; Spark drops the others before the shuffle."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy("key"))).where(F.col("i") <= EXAMPLES)


def _counted(findings: DataFrame, limit: int) -> DataFrame:
    """``ranked`` by counting every pair."""
    distinct = findings.select("key", "finding").distinct()
    top = distinct.groupBy("finding").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "finding").limit(limit)
    some = _smallest(distinct.join(F.broadcast(top), "finding"), "finding")
    return some.groupBy("finding", "n").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("examples"))


def novel_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding): lower-cased words of three letters or more that the grammar does not know."""
    words = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))).alias("finding"))
    return words.where((F.length("finding") >= 3) & ~F.col("finding").isin(*KNOWN_WORDS))


def shape(fragment: Column) -> Column:
    """A fragment with its course codes blotted out, cut to a key."""
    blotted = F.regexp_replace(fragment, r"\b[A-Z]{2,8}(?: [A-Z]{1,4})? ?\d{2,3}\w*\b", "<COURSE>")
    return F.substring(F.trim(F.regexp_replace(blotted, r"\s+", " ")), 1, SHAPE_CHARS)


def label_leftovers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding): texts in which a field label stands after the leading one."""
    body = F.regexp_replace(text, r"(?i)^\s*(?:pre-?requisites?|co-?requisites?)[^:]*:\s*", "")
    rows = rows.select(F.col(key).alias("key"), body.alias("body")).where(F.col("body").rlike(r"(?i)\b(?:pre-?requisite|co-?requisite)s?\b"))
    return rows.select("key", F.substring(F.regexp_replace("body", r"\s+", " "), 1, LABEL_CHARS).alias("finding"))


def unknown_codes(rows: DataFrame, key: str, text: str, known: tuple[str, ...]) -> DataFrame:
    """(key, finding): subjects of course-shaped tokens outside known codes; known codes are taken out of the text first."""
    subjects = "|".join(re.escape(c) for c in sorted(known, key=lambda c: (-len(c), c)))
    rest = F.regexp_replace(text, rf"\b(?:{subjects})\s+{NUMBER}\b", "\u0001")
    found = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(UNKNOWN_CODE), F.lit(1)))).alias("finding"))
    return found.where(~F.col("finding").isin(*known) & ~F.lower("finding").isin(*KNOWN_WORDS))


def longest(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """n_chars, key, snippet: the longest texts above the threshold."""
    long = rows.select(F.length(text).alias("n_chars"), key, F.substring(text, 1, SNIPPET_CHARS).alias("snippet")).where(F.col("n_chars") > LONG_CHARS)
    return long.orderBy(F.desc("n_chars"), F.desc(key), F.desc("snippet")).limit(limit)
