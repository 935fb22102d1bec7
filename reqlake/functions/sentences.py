"""Sentences of catalogue descriptions, and the field each one belongs to, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlake.storage import shuffled

# The patterns that decide where sentences end and what they are.
MISSING_SPACE = r"(?<=[a-z])\.(?=[A-Z][a-z])"
SENTENCE_END = r"(?<!\be\.g)(?<!\bi\.e)(?<!\bBSc)(?<!\bMSc)(?<!\bDr)(?<!\bNo)(?<=[.;])\s+(?=[A-Z(])"
NUMBER_START = r"(?<=[.;])\s+(?=\d)"
INLINE_LABEL = r"(?i)(?<=[^.;\s])\s+(?=Pre-?requisites?\s*(?:or\s+co-?requisites?\s*)?:|(?<!or )Co-?requisites?\s*:)"
CREDIT_EXCLUSION = (
    r"(?i)\bcredit\b(?=[^.;]*\b(?:only one of|at most one of|cannot be obtained|will not be given|may not be obtained"
    r"|cannot be taken for credit|has been obtained|has already been obtained)\b)"
)
CREDIT_EXCLUSION_BY_COURSE = r"(?i)\bcannot be taken for credit\b|\bnot open to students (?:with|who have)\b"
NOTE_LABEL = r"(?i)^\(?\d?\)?\s*Notes?\s*:"
VAGUE_REQUIREMENT = r"(?i)^(?:additional|further)\s+(?:pre-?requisites?|co-?requisites?)"
REVERSE_DIRECTION = r"(?i)\bpre-?requisite\s+(?:for|to)\b"
EQUIVALENCE = r"(?i)\b(?:are|is)\s+considered\b|\bfor\s+pre-?requisite\s+purposes\b|\b(?:count|counts|serve|serves)\s+as\s+(?:a\s+)?pre-?requisite\b"
PREREQ_OR_COREQ_LABEL = r"(?i)\bPre-?requisites?\s+or\s+co-?requisites?\b\s*:?"
PREREQ_LABEL = r"(?i)\bPre-?requisites?\b\s*:?"
COREQ_LABEL = r"(?i)\bCo-?requisites?\b\s*:?"
EMBEDDED_COREQ = r"(?i);\s*(co-?requisites?\s*:.*)$"
MIN_GRADE = r"(?i)\bminimum grade of\s+([A-D][+-]?)\b"
CONSENT = r"(?i)\b(consent|permission)\s+of\s+(?:the\s+)?(instructor|department|program)"

FIELDS = ("exclusion", "note", "coreq", "prereq", "prose")


def _splitter(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.split(s, pattern, -1)


def split_sentences(text: Column) -> Column:
    """Array of the trimmed, non-empty sentences of a description."""
    pieces = F.split(F.regexp_replace(text, MISSING_SPACE, ". "), SENTENCE_END, -1)
    for pattern in (NUMBER_START, INLINE_LABEL):
        pieces = F.flatten(F.transform(pieces, _splitter(pattern)))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def route(sentence: Column) -> Column:
    """The field of a sentence; the first rule that holds wins, the safer ones first."""
    return (
        F.when(sentence.rlike(CREDIT_EXCLUSION) | sentence.rlike(CREDIT_EXCLUSION_BY_COURSE), "exclusion")
        .when(sentence.rlike(NOTE_LABEL) | sentence.rlike(VAGUE_REQUIREMENT), "note")
        .when(sentence.rlike(REVERSE_DIRECTION) | sentence.rlike(EQUIVALENCE), "note")
        .when(sentence.rlike(PREREQ_OR_COREQ_LABEL), "coreq")
        .when(sentence.rlike(PREREQ_LABEL), "prereq")
        .when(sentence.rlike(COREQ_LABEL), "coreq")
        .otherwise("prose")
    )


def routed_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, part, field, sentence; a prerequisite sentence with a corequisite clause at its end gives two rows."""
    rows = docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence")).withColumn("field", route(F.col("sentence")))
    tail = F.when(F.col("field") == "prereq", F.regexp_extract("sentence", EMBEDDED_COREQ, 1)).otherwise("")
    head = F.when(tail != "", F.trim(F.regexp_replace("sentence", EMBEDDED_COREQ, ""))).otherwise(F.col("sentence"))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("field").alias("field"), head.alias("sentence")), F.struct(F.lit(1).alias("part"), F.lit("coreq").alias("field"), F.trim(tail).alias("sentence")))
    return rows.select(key, "pos", F.inline(F.filter(parts, lambda p: (p["part"] == 0) | (p["sentence"] != ""))))


def field_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and one column per field: its sentences in order, joined by spaces; null where there is none."""
    rows = routed_sentences(docs, key, text).groupBy(key)
    one = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "part", "sentence"))))
    lists = rows.agg(*[one(f).alias(f) for f in FIELDS])
    return docs.select(key).join(shuffled(lists), key, "left").select(key, *[F.nullif(F.trim(F.array_join(F.col(f)["sentence"], " ")), F.lit("")).alias(f) for f in FIELDS])


def notes_of(description: Column) -> tuple[Column, Column]:
    """(min_grade_note, consent_note): first mention anywhere in the whole description, else null."""
    return F.nullif(F.regexp_extract(description, MIN_GRADE, 0), F.lit("")), F.nullif(F.regexp_extract(description, CONSENT, 0), F.lit(""))
