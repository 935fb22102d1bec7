"""Course codes in text found by joining a vocabulary table: no pattern grows with the number of subjects.

A text is cut into tokens (words, numbers, white space, single signs); a token's place is its index.  The one, two or three
words before a number are candidates, the vocabulary tells which of them name a subject, and the longest name wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The number of a course, and words as the audits count them.
NUMBER = r"\d{2,3}(?:[A-Z]{1,2}|-\d)?"
WORD = r"[A-Za-z][A-Za-z'-]+"
TOKEN = rf"{WORD}|[A-Za-z]|\d+(?:[A-Z]+\b|-\d\b)?|\s+|."
MOST_WORDS = 3  #: words of a subject's name


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s){TOKEN}"), F.lit(0))


def _candidates(row_tokens: str) -> Column:
    """Array of (name, first, last): names of one to three words before each number, each with the places it would cover."""
    at = lambda i: F.coalesce(F.get(row_tokens, i), F.lit(""))

    def before(i: Column, words: int) -> Column:
        name = F.concat_ws(" ", *[at(i - 2 * k) for k in range(words, 0, -1)])
        spaced = F.lit(True)
        for k in range(words):
            spaced = spaced & at(i - 2 * k - 1).rlike(r"^\s+$" if k == 0 else r"^ $") & at(i - 2 * k - 2).rlike("^[A-Za-z]")
        return F.when(spaced, F.struct(name.alias("name"), (i - 2 * words).alias("first"), i.alias("last")))

    numbers = F.filter(F.transform(row_tokens, lambda t, i: F.when(t.rlike(f"^{NUMBER}$"), i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(numbers, lambda i: F.array_compact(F.array(*[before(i, n) for n in range(1, MOST_WORDS + 1)]))))


def code_spans(rows: DataFrame, key: str, text: str, subjects: DataFrame) -> DataFrame:
    """key, first, last: the token places of course codes whose subject is a row of ``subjects`` (name), in exact case.

    Null texts have none; a code's longest name wins.  Keys must be unique.
    """
    cut = rows.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    each = cut.select("key", F.inline(_candidates("t")))
    known = each.join(subjects.select("name").where("name is not null").distinct(), "name")
    return known.groupBy("key", "last").agg(F.min("first").alias("first")).select("key", "first", "last")


def words_outside(rows: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """key, word: lower-cased words that stand in no span, each place a row.

    Words and spans are swept in order of their first place: a word is inside if a span before it reaches its place.  A
    sweep goes over one text.
    """
    cut = rows.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(text))).alias("first", "word")).where(F.col("word").rlike(f"^{WORD}$"))
    both = cut.select("key", "first", F.lit(-1).alias("last"), "word").union(spans.select("key", "first", "last", F.lit(None).cast("string")))
    reach = F.max("last").over(Window.partitionBy("key").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("reach", reach).where("word is not null and reach < first").select("key", F.lower("word").alias("word"))
