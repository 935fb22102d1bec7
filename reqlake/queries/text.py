"""Queries that read catalogue descriptions: sentences, fields, requirement trees, audits of them, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake.functions import sentences
from reqlake.operators import outliers
from reqlake.plans import grammar
from reqlake.sources import catalogue as cat
from reqlake.sources import requirement_text as rt
from reqlake.storage import Scratch, table

_WITH = f"WITH {cat.SQL}, {rt.SQL}"
_PARTS = "list_filter([intro, sentence, coreq, exclusion, note, reverse], lambda s: s IS NOT NULL)"
_KINDS = "list_filter([struct_pack(f := 'prose', s := intro), struct_pack(f := 'prereq', s := sentence), struct_pack(f := 'coreq', s := coreq), struct_pack(f := 'exclusion', s := exclusion), struct_pack(f := 'note', s := note), struct_pack(f := 'note', s := reverse)], lambda r: r.s IS NOT NULL)"


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.texts(spark, sf_dir).select("pk", F.posexplode(sentences.split_sentences(F.col("description"))).alias("pos", "sentence"))


def sentence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.routed_sentences(rt.texts(spark, sf_dir), "pk", "description").select("pk", "pos", "field", "sentence")


def field_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.field_texts(rt.texts(spark, sf_dir), "pk", "description")


def scrape_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = sentences.field_texts(rt.texts(spark, sf_dir), "pk", "description")
    return fields.agg(F.count("*").alias("courses"), *[F.count(f).alias(f"with_{f}") for f in sentences.FIELDS])


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of each field the documents have, by source."""
    docs = table(spark, sf_dir, "documents").select("source", F.explode(sentences.split_sentences(F.col("text"))).alias("s"))
    return docs.groupBy("source", sentences.route(F.col("s")).alias("field")).agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> grammar.Vocabulary:
    return grammar.Vocabulary(rt.subject_codes(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.texts(spark, sf_dir).select("pk", "code", "sentence", F.col("subject").alias("home"))
    rows = Scratch(spark, "parsed").save(rows, "texts")  # read twice: the edges behind them are found once
    return rows.join(grammar.parse(rows, "pk", "sentence", "home", _vocabulary(spark, sf_dir)), "pk")


def parse_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("code", "tree", "parse_status", F.size("notes").cast("long").alias("n_notes"), F.array_join("unrepresented", "|").alias("unrepresented"))


def implied_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.texts(spark, sf_dir).where("y is not null")
    text = grammar.expand_bare_numbers(F.concat("x", F.lit(" or "), "ys", F.lit(", 300-level")), F.col("subject"), _vocabulary(spark, sf_dir))
    return rows.select("code", text.alias("expanded"))


def credit_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.texts(spark, sf_dir).where("exclusion is not null")
    found = grammar.credit_exclusions(F.col("exclusion"), F.col("code"), F.col("subject"), _vocabulary(spark, sf_dir))
    return rows.select("code", F.array_join(found, ",").alias("excludes"))


def negation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion sentences inside a requirement give candidates and never a tree."""
    rows = rt.texts(spark, sf_dir).where("exclusion is not null and sentence is not null")
    rows = rows.select("pk", "code", F.concat_ws(" ", "sentence", "exclusion").alias("t"), F.col("subject").alias("home"))
    rows = Scratch(spark, "negation").save(rows, "texts")
    out = grammar.parse(rows, "pk", "t", "home", _vocabulary(spark, sf_dir)).join(rows.select("pk", "code"), "pk")
    return out.select("code", "tree", F.array_join("candidates", ",").alias("candidates"))


def asides(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parsed(spark, sf_dir).select("code", F.explode("notes").alias("note")).where(F.col("note").startswith("not required"))
    return found


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the text that the tree lacks, and codes of the tree that the text lacks; courses with either."""
    vocabulary = _vocabulary(spark, sf_dir)
    rows = _parsed(spark, sf_dir).where("sentence is not null")
    in_text = grammar.codes_in(F.col("sentence"), F.col("home"), vocabulary)
    in_tree = F.coalesce(F.array_distinct(F.regexp_extract_all("tree", F.lit(vocabulary.course), F.lit(0))), F.array().cast("array<string>"))
    rows = rows.where(F.array_sort(in_text) != F.array_sort(in_tree))  # each is read once a course; both are distinct
    rows = rows.withColumn("dropped", F.array_except(in_text, in_tree)).withColumn("invented", F.array_except(in_tree, in_text))
    severity = F.when(F.size("invented") > 0, "error").when((F.size("dropped") > 0) & (F.col("parse_status") == "parsed"), "error").when((F.size("dropped") > 0) & (F.size("unrepresented") == 0), "warn").otherwise("ok")
    return rows.select("code", "parse_status", F.array_join("dropped", ",").alias("dropped"), F.array_join("invented", ",").alias("invented"), severity.alias("severity"))


def outlier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    return outliers.ranked(outliers.novel_words(docs, "key", "text"), 12)


def outlier_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return outliers.longest(docs, "doc_id", "text", 12)


def outlier_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = _parsed(spark, sf_dir).select(F.col("code").alias("key"), F.explode("unrepresented").alias("fragment"))
    return outliers.ranked(fragments.select("key", outliers.shape(F.col("fragment")).alias("finding")), 12)


def outlier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement texts with a second label inside: sentence and corequisite joined as one field."""
    rows = rt.texts(spark, sf_dir).select(F.col("code").alias("key"), F.concat_ws(" ", "sentence", "coreq").alias("t"))
    rows = Scratch(spark, "labels").save(rows, "texts")  # read twice, as below
    return outliers.ranked(outliers.label_leftovers(rows, "key", "t"), 12)


def outlier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course-shaped tokens of unknown subjects, with the first half of the subjects as the vocabulary."""
    rows = rt.texts(spark, sf_dir).where("sentence is not null").select(F.col("code").alias("key"), "sentence")
    rows = Scratch(spark, "codes").save(rows, "texts")  # findings are sketched and recounted: the edges behind them are found once
    codes = rt.subject_codes(spark, sf_dir)
    return outliers.ranked(outliers.unknown_codes(rows, "key", "sentence", codes[: (len(codes) + 1) // 2]), 12)


_KNOWN_WORDS = ", ".join(f"'{w}'" for w in outliers.KNOWN_WORDS)
_RANKED = "SELECT finding, count(DISTINCT key) AS n, array_to_string(list_sort(list_distinct(list(key)))[1:5], ', ') AS examples FROM found GROUP BY finding ORDER BY n DESC, finding LIMIT 12"
_HALF = "(SELECT list_sort(list(DISTINCT subject))[1:(count(DISTINCT subject) + 1) // 2] FROM course)"

QUERIES = {
    "sentence_split": sentence_split, "sentence_route": sentence_route, "field_text": field_text, "scrape_counters": scrape_counters, "document_sentences": document_sentences,
    "parse_generated": parse_generated, "implied_subject": implied_subject, "credit_exclusions": credit_exclusions, "negation_strip": negation_strip, "asides": asides,
    "coverage_audit": coverage_audit, "outlier_words": outlier_words, "outlier_long": outlier_long, "outlier_shapes": outlier_shapes, "outlier_labels": outlier_labels, "outlier_codes": outlier_codes,
}

ORACLE_SQL = {
    "sentence_split": f"{_WITH} SELECT pk, unnest(range(0, len(p))) :: INT AS pos, unnest(p) AS sentence FROM (SELECT pk, {_PARTS} AS p FROM texts)",
    "sentence_route": f"{_WITH} SELECT pk, i :: INT AS pos, p[i + 1].f AS field, p[i + 1].s AS sentence FROM (SELECT pk, p, unnest(range(0, len(p))) AS i FROM (SELECT pk, {_KINDS} AS p FROM texts))",
    "field_text": f"{_WITH} SELECT pk, exclusion, nullif(concat_ws(' ', note, reverse), '') AS note, coreq, sentence AS prereq, intro AS prose FROM texts",
    "scrape_counters": f"""{_WITH} SELECT count(*) AS courses, count(exclusion) AS with_exclusion, count(nullif(concat_ws(' ', note, reverse), '')) AS with_note, count(coreq) AS with_coreq,
        count(sentence) AS with_prereq, count(intro) AS with_prose FROM texts""",
    "parse_generated": f"""{_WITH} SELECT code, tree, read_status AS parse_status, CASE WHEN read_status = 'parsed' THEN 0 ELSE 1 END :: BIGINT AS n_notes,
        CASE WHEN x IS NOT NULL AND pk % 20 = 5 THEN 'a reading list agreed in advance' ELSE '' END AS unrepresented FROM tree""",
    "implied_subject": f"{_WITH} SELECT code, concat(x, ' or ', y, ', 300-level') AS expanded FROM texts WHERE y IS NOT NULL",
    "credit_exclusions": f"{_WITH} SELECT code, ex_code AS excludes FROM texts WHERE exclusion IS NOT NULL",
    "negation_strip": f"{_WITH} SELECT code, tree, concat(code, ',', ex_code) AS candidates FROM tree WHERE exclusion IS NOT NULL AND sentence IS NOT NULL",
    "asides": f"{_WITH} SELECT code, concat('not required, mentioned only as an aside: ', code, ' recommended') AS note FROM texts WHERE pk % 30 = 1 AND x IS NOT NULL",
    "coverage_audit": f"{_WITH} SELECT code, read_status AS parse_status, code AS dropped, '' AS invented, 'warn' AS severity FROM tree WHERE pk % 30 = 1 AND x IS NOT NULL",
    "outlier_words": f"""WITH found AS (
          SELECT doc_id :: VARCHAR AS key, lower(unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+')))) AS finding FROM documents)
        SELECT finding, count(DISTINCT key) AS n, array_to_string(list_sort(list_distinct(list(key)))[1:5], ', ') AS examples FROM found
        WHERE length(finding) >= 3 AND finding NOT IN ({_KNOWN_WORDS}) GROUP BY finding ORDER BY n DESC, finding LIMIT 12""",
    "outlier_long": """SELECT length(text) :: INT AS n_chars, doc_id, left(text, 110) AS snippet FROM documents WHERE length(text) > 220
        ORDER BY n_chars DESC, doc_id DESC, snippet DESC LIMIT 12""",
    "outlier_shapes": f"{_WITH}, found AS (SELECT code AS key, 'a reading list agreed in advance' AS finding FROM tree WHERE x IS NOT NULL AND pk % 20 = 5) {_RANKED}",
    "outlier_labels": f"""{_WITH}, t AS (SELECT code AS key, regexp_replace(concat_ws(' ', sentence, coreq), '^\\s*(?:pre-?requisites?|co-?requisites?)[^:]*:\\s*', '', 'i') AS body FROM texts),
        found AS (SELECT key, left(regexp_replace(body, '\\s+', ' ', 'g'), 80) AS finding FROM t WHERE regexp_matches(body, '\\b(?:pre-?requisite|co-?requisite)s?\\b', 'i')) {_RANKED}""",
    "outlier_codes": f"""{_WITH}, found AS (
          SELECT code AS key, split_part(o, ' ', 1) AS finding FROM (SELECT code, unnest([x, y, z, w]) AS o FROM texts WHERE pk % 10 <> 7
            UNION ALL SELECT code, CASE WHEN pk % 30 = 1 AND x IS NOT NULL THEN code END FROM texts)
          WHERE o IS NOT NULL AND NOT list_contains({_HALF}, split_part(o, ' ', 1))) {_RANKED}""",
}
