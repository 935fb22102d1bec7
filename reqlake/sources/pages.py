"""Catalogue pages: links, headings and paragraphs out of the elements that ``markup`` reads, in order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlake.sources.markup import with_elements

HIDDEN = r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>"
HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1>"
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = r"(?is)</p>.*$"
LEAST_CHARS = 60


def visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags become spaces, white space runs collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, r"(?s)<[^>]*>", " "), r"[\s]+", " "))


def _of(tag: str) -> Column:
    return F.filter("elements", lambda e: e["tag"] == tag)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, link: the distinct link targets of every page in order of first occurrence."""
    found = F.array_distinct(F.filter(F.transform(_of("a"), lambda e: e["href"]), lambda h: h.isNotNull()))
    return with_elements(pages, "page_id").select("page_id", F.posexplode(found).alias("pos", "link"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, title, has_heading: the text of the first first-level heading; the URL's last part where there is none."""
    title = F.coalesce(F.get(_of("h1"), F.lit(0))["text"], F.lit(""))
    fallback = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)
    return with_elements(pages, "page_id", "url").select("page_id", F.coalesce(F.nullif(title, F.lit("")), fallback).alias("title"), (title != "").alias("has_heading"))


def first_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, description: the first paragraph of LEAST_CHARS characters or more after the heading, else null."""
    over = F.coalesce(F.get(_of("h1"), F.lit(0))["end"], F.lit(0))
    long = F.filter(_of("p"), lambda e: (e["start"] >= over) & (F.length(e["text"]) >= LEAST_CHARS))
    return with_elements(pages, "page_id").select("page_id", F.get(long, F.lit(0))["text"].alias("description"))


# What course pages and the subject list look like.
COURSE_LINK = r"^/catalogue/course/([a-z0-9_-]+)/([A-Za-z0-9]+)$"
SUBJECT_LINK = r"^/catalogue/course/([a-z0-9_-]+)$"
SUBJECT_LABEL = r"^\s*([A-Z][A-Z0-9]*(?: [A-Z][A-Z0-9]*)*)\s+-\s+(.+?)\s*$"
CODE_AND_TITLE = r"^\s*([A-Z]{1,8}(?:\s[A-Z]{1,4})?\s+\d{2,}[A-Z]{0,2})\s*[-–]\s*(.+?)\s*$"
UNITS = r"(?i)\d+(?:\.\d+)?\s*units?\s*\(fi\s*\d+\)(?:\([^)]*\))*"
TERM = r"(?i)^(?:Fall|Winter|Spring|Summer)\s+Term\s+\d{4}$"
BOLD = r"(?is)<b(?:\s[^>]*)?>(.*?)</b>"
BOLDS = 6  #: bold texts after the heading in which the term and the units are looked for


def _first(texts: Column, pattern: str) -> Column:
    return F.get(F.filter(texts, lambda t: t.rlike(pattern)), F.lit(0))


def course_numbers(indexes: DataFrame) -> DataFrame:
    """slug, page, pos, number: the distinct course numbers an index page links for its own subject, in capitals, in order."""
    targets = F.transform(_of("a"), lambda e: F.trim(F.coalesce(e["href"], F.lit(""))))
    own = F.filter(targets, lambda t: F.regexp_extract(t, COURSE_LINK, 1) == F.lower("slug"))
    numbers = F.array_distinct(F.transform(own, lambda t: F.upper(F.regexp_extract(t, COURSE_LINK, 2))))
    return with_elements(indexes, "slug", "page").select("slug", "page", F.posexplode(numbers).alias("pos", "number"))


def first_per_subject(numbers: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` course numbers of each subject, by page and place."""
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("page", "pos"))
    return numbers.withColumn("n", rank).where(F.col("n") <= limit).drop("n")


def subjects(registry: DataFrame) -> DataFrame:
    """page, slug, code, name: of each slug the first link whose label has a code and a name."""
    rows = with_elements(registry, "page").select("page", F.posexplode(F.filter(_of("a"), lambda e: e["href"].isNotNull())).alias("pos", "a"))
    rows = rows.withColumn("slug", F.regexp_extract(F.trim("a.href"), SUBJECT_LINK, 1)).withColumn("label", F.col("a.text"))
    rows = rows.where((F.col("slug") != "") & F.col("label").rlike(SUBJECT_LABEL))
    first = rows.groupBy("page", "slug").agg(F.min_by("label", "pos").alias("label"))
    return first.select("page", "slug", F.regexp_extract("label", SUBJECT_LABEL, 1).alias("code"), F.regexp_extract("label", SUBJECT_LABEL, 2).alias("name"))


def course_fields(pages: DataFrame) -> DataFrame:
    """url, code, number, title, effective_term, credits_text, units, faculty, description, warnings of course pages.

    Only what comes after the first heading counts, but for the units, which are looked for in the whole text if no bold
    text has them.  The faculty is taken before the description only.  The code of a page whose heading has none is that
    of its URL.  Null and empty pages give nulls and three warnings.
    """
    html = visible(F.col("html"))
    pages = pages.select("url", html.alias("_html"), plain(F.regexp_extract(html, HEADING, 1)).alias("_heading"))
    after = F.when(F.col("_html").rlike(HEADING), F.regexp_replace("_html", r"(?is)^.*?</h1>", "")).otherwise(F.col("_html"))
    pages = pages.withColumn("_after", after)
    bold = F.slice(F.transform(F.regexp_extract_all("_after", F.lit(BOLD), F.lit(1)), plain), 1, BOLDS)
    pieces = F.split("_after", PARAGRAPH, -1)
    paragraphs = F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: plain(F.regexp_replace(p, PARAGRAPH_END, ""))), lambda t: t != "")
    pages = pages.withColumn("_bold", bold).withColumn("_p", paragraphs)
    is_faculty = lambda t: F.lower(t).startswith("faculty of")
    # the first faculty is passed over, whatever its length; a later one of enough characters is a description
    faculty_at = F.array_position(F.transform("_p", is_faculty), True)
    long_at = F.array_position(F.transform("_p", lambda t: F.length(t) >= LEAST_CHARS), True)
    rest = F.when((faculty_at > 0) & (faculty_at <= long_at), F.filter("_p", lambda t, i: i + 1 != faculty_at)).otherwise(F.col("_p"))
    description = F.get(F.filter(rest, lambda t: F.length(t) >= LEAST_CHARS), F.lit(0))
    faculty = F.when((faculty_at > 0) & ((long_at == 0) | (faculty_at <= long_at)), F.get("_p", (faculty_at - 1).cast("int")))
    credits = F.coalesce(F.nullif(F.regexp_extract(_first(F.col("_bold"), UNITS), UNITS, 0), F.lit("")), F.nullif(F.regexp_extract(plain(F.col("_html")), UNITS, 0), F.lit("")))
    pages = pages.select("url", "_heading", _first(F.col("_bold"), TERM).alias("effective_term"), credits.alias("credits_text"), faculty.alias("faculty"), description.alias("description"))
    known, path = F.col("_heading").rlike(CODE_AND_TITLE), F.split("url", "/")
    part = lambda n: F.upper(F.element_at(path, n))
    warnings = F.array_compact(
        F.array(
            F.when(~known, F.concat(F.lit("could not parse code/title out of h1 '"), "_heading", F.lit("'"))), F.when(F.col("credits_text").isNull(), "no units string found"),
            F.when(F.col("description").isNull(), f"no description paragraph found (>={LEAST_CHARS} chars)"),
        )
    )
    return pages.select(
        "url", F.when(known, F.regexp_extract("_heading", CODE_AND_TITLE, 1)).otherwise(F.concat_ws(" ", part(-2), part(-1))).alias("code"), part(-1).alias("number"),
        F.when(known, F.regexp_extract("_heading", CODE_AND_TITLE, 2)).alias("title"), "effective_term", "credits_text", F.regexp_extract("credits_text", r"^(\d+(?:\.\d+)?)", 1).try_cast("double").alias("units"),
        "faculty", "description", warnings.alias("warnings"),
    )
