"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of ``BLOCK`` words every ``STRIDE`` words, so any ``BLOCK - STRIDE + 1`` consecutive words lie in one.
A block meets a template T when it holds at least ``THRESHOLD`` of T's distinct words, and agrees with T on the telling words
of its family: it holds those that T has and none of the others (one word tells a Lesser or Affero license from the
general one, which no share of common words can outvote).  A telling word counts only inside a license's name, that is
directly after a word that it follows in a template: "gnu lesser", but not "a copy of the lesser license".  Template words are ordered by how many documents of the corpus
hold them, rarest first.  A block that meets T

* holds one of T's first |T| - need + 1 words (prefix filter), need = ceil(THRESHOLD * |T|);
* has at least need words (length filter);
* and has its first word of T at a place r with |T| - r >= need (positional filter).

Documents without any prefix word are passed over whole; the words of the others are joined with the template words (a
table as large as the templates) and each block's distinct words are counted as bits.  DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import fold_case

BLOCK, STRIDE = 64, 32  #: words
THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Operative sentences of public license notices, with the label a block that meets them gets.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
            "either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
             "either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
              "to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose"),
    ("public-domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives International License"),
)
#: Words that tell the licenses of a family apart, by a word of all its templates.
TELLING = {"gnu": ("lesser", "affero"), "creative": ("noncommercial", "noderivatives", "sharealike")}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words() -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of every template."""
    return [(i, label, sorted(set(re.sub(SEPARATORS, " ", text.lower()).split()))) for i, (label, text) in enumerate(TEMPLATES)]


def telling_words(words: list[str]) -> tuple[list[str], list[str]]:
    """Of a template's family, the telling words it has and those it lacks."""
    family = [t for mark, told in TELLING.items() if mark in words for t in told]
    return [t for t in family if t in words], [t for t in family if t not in words]


def names_before() -> dict[str, tuple[str, ...]]:
    """Of each telling word, the words that stand directly before it in the templates."""
    told = sorted({t for family in TELLING.values() for t in family})
    texts = [re.sub(SEPARATORS, " ", text.lower()).split() for _, text in TEMPLATES]
    return {t: tuple(sorted({ws[i - 1] for ws in texts for i in range(1, len(ws)) if ws[i] == t})) for t in told}


def named(words: Column) -> Column:
    """The words with every telling word outside a license's name blotted out, each at its place."""
    before = names_before()

    def kept(word: Column, at: Column) -> Column:
        previous = F.when(at > 0, F.get(words, at - 1))
        out = word
        for told, names in before.items():
            out = F.when((word == told) & ~F.coalesce(previous.isin(*names), F.lit(False)), F.lit("")).otherwise(out)
        return out

    return F.when(F.arrays_overlap(words, _literal(list(before))), F.transform(words, kept)).otherwise(words)


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold_case(text), SEPARATORS), lambda w: w != "")


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def ranked_templates(words: DataFrame) -> list[tuple[int, str, list[str], int]]:
    """(number, label, words rarest first, need); the frequencies are counted over all rows of ``words``."""
    vocabulary = sorted({w for _, _, ws in template_words() for w in ws})
    held = words.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a template word
    return [(i, label, sorted(ws, key=lambda w: (counts.get(w, 0), w)), math.ceil(THRESHOLD * len(ws))) for i, label, ws in template_words()]


def matching_blocks(words: DataFrame, ranked: list[tuple[int, str, list[str], int]], key: str) -> DataFrame:
    """(key, block, label, containment): every block that meets a template; block b starts at word STRIDE * b.

    A template's words are bits 0, 1, ... of a long, rarest first, and the telling words it lacks are those after them.
    """
    spark = words.sparkSession
    lexicon, templates = [], []
    for i, label, ws, need in ranked:
        must, mustnt = telling_words(ws)
        lexicon += [(w, i, r, r <= len(ws) - need) for r, w in enumerate(ws)] + [(w, i, len(ws) + r, False) for r, w in enumerate(mustnt)]
        templates.append((i, label, len(ws), need, (1 << len(ws)) - 1, sum(1 << ws.index(w) for w in must), sum(1 << len(ws) + r for r in range(len(mustnt)))))
    sizes = spark.createDataFrame(templates, "template int, label string, size int, need int, own long, must long, mustnt long")
    prefixes = sorted({w for w, _, _, prefix in lexicon if prefix})
    hits = words.where(F.arrays_overlap("words", _literal(prefixes))).select(key, F.size("words").alias("n"), F.posexplode(named(F.col("words"))).alias("at", "word"))
    hits = hits.join(F.broadcast(spark.createDataFrame(lexicon, "word string, template int, place int, prefix boolean")), "word").withColumn("first_block", F.floor(F.col("at") / STRIDE).cast("int"))
    per_word = BLOCK // STRIDE
    hits = hits.select(key, "n", "template", "place", "prefix", F.explode(F.filter(F.sequence(F.col("first_block") - per_word + 1, F.col("first_block")), lambda b: b >= 0)).alias("block"))
    blocks = hits.groupBy(key, "block", "template").agg(
        F.max("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"),
        F.min("place").alias("first"), F.max("prefix").alias("prefix"),
    )
    length = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * STRIDE)
    found = blocks.join(F.broadcast(sizes), "template").where(F.col("prefix") & (length >= F.col("need")) & (F.col("size") - F.col("first") >= F.col("need")))
    both = lambda mask: F.col("bits").bitwiseAND(F.col(mask))
    found = found.where((both("must") == F.col("must")) & (both("mustnt") == 0)).withColumn("held", F.bit_count(both("own")))
    return found.where(F.col("held") >= F.col("need")).select(key, "block", "label", (F.col("held") / F.col("size")).alias("containment"))


def _places(phrase: str) -> Column:
    words = phrase.split()
    at = F.sequence(F.lit(0), F.size("words") - len(words))

    def stands(i: Column) -> Column:
        ok = F.get(F.col("words"), i) == words[0]
        for j, w in enumerate(words[1:], 1):
            ok = ok & (F.get(F.col("words"), i + j) == w)
        return ok

    possible = (F.size("words") >= len(words)) & F.array_contains("words", words[0]) & F.array_contains("words", words[-1])
    return F.when(possible, F.filter(at, stands)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    Base places are where a phrase's words stand consecutively, counted for all phrases; first_word and last_word are
    their smallest and largest start (null without any).  labels adds those of the templates that some block meets (a
    block that holds two look-alike notices with different telling words meets neither; other blocks may); both label lists are distinct, sorted and comma-joined, '' if empty.  score is 1 with a base place, else the largest
    containment of a block that meets a template, else 0.  Null and empty texts have 0 words; repeated rows get equal
    results; an empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), words_of(text).alias("words")).withColumn("_key", F.struct("_id", "_hash"))
    blocks = matching_blocks(words.select("_key", "words"), ranked_templates(words), "_key")
    more = blocks.groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    more = more.select(F.col("_key._id").alias("_mid"), F.col("_key._hash").alias("_mhash"), "_more", "_best")

    # the phrases' places only where their words occur; the words themselves stay out of the join
    base = words.select("_id", "_hash", F.size("words").cast("long").alias("n_words"), *[_places(p).alias(f"_p{i}") for i, p in enumerate(PHRASES)])
    all_places = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    labels = F.array_distinct(F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))))
    base = base.select(
        "_id", "_hash", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"), labels.alias("_base"),
    )
    out = base.join(more, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_hash") == F.col("_mhash")), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and template labels of every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    names = " OR ".join(f"(w[i + 1] = '{told}' AND w[i] IN ({', '.join(repr(b) for b in before)}))" for told, before in names_before().items())
    stray = f"w[i + 1] IN ({', '.join(repr(t) for t in names_before())}) AND NOT coalesce({names}, false)"
    phrases = ", ".join(f"({i}, '{p}', '{label}', {len(p.split())})" for i, (p, label) in enumerate(PHRASES.items()))
    tokens = ", ".join(f"({i}, '{label}', '{w}', {len(ws)})" for i, label, ws in template_words() for w in ws)
    telling = ", ".join(f"({i}, '{w}', {w in ws})" for i, _, ws in template_words() for side in telling_words(ws) for w in side)
    places = " OR ".join("(" + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) + f" AND p = {i})" for i, p in enumerate(PHRASES))
    return f"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w
  FROM documents),
phrase(p, words, label, n) AS (VALUES {phrases}),
template(t, label, word, size) AS (VALUES {tokens}),
telling(t, word, wanted) AS (VALUES {telling}),
place AS (
  SELECT doc_id, i, label FROM (SELECT doc_id, w, p, label, unnest(range(0, len(w))) AS i FROM docs, phrase) WHERE {places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
word AS (SELECT doc_id, CASE WHEN {stray} THEN '' ELSE w[i + 1] END AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM docs)),
told AS (
  SELECT DISTINCT doc_id, b.b AS b, word.word AS word FROM word JOIN (SELECT DISTINCT word FROM telling) USING (word), LATERAL (SELECT unnest([i // {STRIDE}, i // {STRIDE} - 1]) AS b) b),
hit AS (
  SELECT doc_id, t, label, size, word.word AS word, b.b AS b FROM word JOIN template USING (word), LATERAL (SELECT unnest([i // {STRIDE}, i // {STRIDE} - 1]) AS b) b WHERE b.b >= 0),
met AS (SELECT doc_id, b, t, label, count(DISTINCT word) / max(size) AS c FROM hit GROUP BY ALL HAVING count(DISTINCT word) >= ceil({THRESHOLD} * max(size))),
unlike AS (
  SELECT m.doc_id, m.b, m.t FROM met m JOIN telling g ON g.t = m.t LEFT JOIN told o ON o.doc_id = m.doc_id AND o.b = m.b AND o.word = g.word WHERE (o.word IS NOT NULL) <> g.wanted),
block AS (SELECT * FROM met ANTI JOIN unlike USING (doc_id, b, t)),
more AS (SELECT doc_id, max(c) AS best FROM block GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM block) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END :: DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN every USING (doc_id)
"""


ORACLE_SQL = _oracle()
