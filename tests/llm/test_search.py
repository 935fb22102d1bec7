"""Nearest neighbours, lexical search and spelling variants on small hand-made tables, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqlake.llm import lexical, partitions, spelling
from reqlake.llm.common import Scratch
from reqlake.llm.heaps import Heaps
from tests.llm.test_operators import SCHEMA, documents, frame

VECTORS = "vec_id long, embedding array<float>, label int, part int, q long, id long, v string"


@pytest.mark.parametrize("pending", [1, 7, 10**6])
def test_heaps_keep_the_best(monkeypatch, pending):
    monkeypatch.setattr(Heaps, "PENDING", pending)
    rng = random.Random(pending)
    rows = [(rng.randrange(4), rng.randrange(6), rng.randrange(50), rng.random() < 0.1) for _ in range(400)]
    heaps = Heaps(5, 3, 1)
    for at in range(0, 400, 13):
        heaps.offer(*(np.array(x) for x in zip(*rows[at : at + 13])))
    got = list(zip(*(x.tolist() for x in heaps.merge())))
    want = [r for q in range(5) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[1], r[3], r[2]))[:3]]
    assert got == want and heaps.bar[4] == 1


def cosines(rows, k=5, every=50):
    """The k nearest of every row whose id is divisible by ``every``, by brute force."""
    sound = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)})
    wide = np.zeros((len(sound), max((len(v) for _, v in sound), default=0)))
    for row, (_, v) in zip(wide, sound):
        row[: len(v)] = v
    out = []
    for at, (i, _) in enumerate(sound):
        if i % every == 0:
            score = partitions.cosine(np.repeat(wide[at : at + 1], len(wide), axis=0), wide)
            best = sorted((-s, j) for s, (j, _) in zip(score.tolist(), sound) if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, "v") for i, v in rows], VECTORS).repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_nearest_of_a_small_table_are_exact(spark):
    rng = random.Random(3)
    half = lambda: [rng.randrange(-8, 9) / 8 for _ in range(6)]
    rows = [(i, half()) for i in range(120)]
    rows += [(None, half()), (500, None), (550, [0.0] * 6), (600, [1.0, None, 1.0]), (650, [float("nan")] * 6), (700, [float("inf"), 1.0]), (750, [1.0, 0.5]), (800, [])]
    rows += [rows[0], rows[7], (50, half()), *((i, [1.0] * 6) for i in range(900, 940)), (950, [2.0] * 6)]  # repeats, an id of two vectors, copies, ties
    got = found(partitions.nearest(vectors(spark, rows)))
    assert got == cosines(rows)
    assert [r for r in got if r[0] == 900][0][2] == 901
    assert found(partitions.nearest(vectors(spark, rows[:4]))) == cosines(rows[:4])  # fewer than k others
    assert found(partitions.nearest(vectors(spark, rows[:1]))) == [] and partitions.nearest(vectors(spark, [])).count() == 0


def test_nearest_by_learned_partitions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:1200] = x[700]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(partitions, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(partitions, "QUERY_BLOCK", 4)
    monkeypatch.setattr(partitions, "FILE_BLOCK", 50)
    want, got = cosines(rows), found(partitions.nearest(vectors(spark, rows)))
    assert len(got) == len(want) == 150
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert [r for r in got if r[0] == 700] == [r for r in want if r[0] == 700]


def test_queries_short_of_rows_read_every_part(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)).astype(np.float32))]
    monkeypatch.setattr(partitions, "ROWS_PER_PART", 4)
    monkeypatch.setattr(partitions, "RECALL", 0.0)  # one part is probed, of four rows or so
    got = found(partitions.nearest(vectors(spark, rows), k=30))
    assert Counter(r[0] for r in got) == Counter({i: 30 for i in range(0, 300, 50)})
    assert got == cosines(rows, k=30)


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(640, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = partitions.balanced_parts(x, partitions._nearest(x, x, 10, True), 8)
    size = np.bincount(part, minlength=8)
    assert size.min() >= 72 and size.max() <= 88


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranking(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        scored = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_terms if n_terms else 0
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda r: r[:2] + (r[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "cells"), [(16_000_000, 4_000_000), (300, 60)])
def test_lexical_ranking(spark, monkeypatch, group, cells):
    monkeypatch.setattr(lexical, "GROUP_BYTES", group)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", cells)
    monkeypatch.setattr(Heaps, "PENDING", 5)
    docs = documents()
    docs += [(None, docs[7][1][:200]), (None, docs[7][1][:200]), docs[9], docs[9], (900, "x2 X2 É é naïve…naïve \U0001f600"), (901, "..."), (902, "x2")]
    pick = lambda i: docs[i][1] or ""
    items = [(1, pick(8)[:80]), (1, pick(8)[:80]), (2, pick(30)), (2, "x2 é"), (3, None), (4, ""), (None, "one"), (5, "One ONE two"), (6, "nowhere"), (7, pick(7)[:3000]), (8, "x naïve…naïve")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long").repartition(2)
    got = sorted((tuple(r) for r in lexical.ranked(frame(spark, docs), table).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranking(docs, items)


def test_lexical_ranking_of_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), frame(spark, [(1, "one"), (2, None)])
    item = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.ranked(none, item).count() == 0 and lexical.ranked(some, item.where("false")).count() == 0
    assert lexical.ranked(frame(spark, [(1, " . "), (2, None)]), item).count() == 0
    assert [tuple(r) for r in lexical.ranked(some, item).collect()] == ranking([(1, "one"), (2, None)], [(1, "one")])


def spelled(docs, least=7):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def edits(n):
    """The words of ``n`` one edit from each, by a table of gaps."""
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            gaps[w[:p], w[p + 1 :]].add(w)
            shorter = w[:p] + w[p + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    return near


def spellings(n):
    near, form = edits(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def misspelt(seed, count, letters, lengths):
    """Words one or two edits apart, with counts of many sizes, and chains of forms."""
    rng = random.Random(seed)
    out = Counter()
    for _ in range(count):
        w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        times = rng.choice((2, 30, 400))
        out[w] += times
        for _ in range(rng.randrange(6)):
            p, c = rng.randrange(len(w) + 1), rng.choice(letters)
            near = rng.choice((w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]))
            out[near] += max(2, times // rng.choice((3, 10, 12)))
            w = near if rng.random() < 0.3 else w
    return out


def test_spelling_variants_of_texts(spark):
    rng = random.Random(8)
    counts = misspelt(1, 60, "abcdeéÿ×", (7, 8, 9, 12))
    words = [w.upper() if rng.random() < 0.1 else w for w, c in counts.items() for _ in range(min(c, 60))]
    rng.shuffle(words)
    docs = [(i, " ".join(words[at : at + 90])) for i, at in enumerate(range(0, len(words), 90))]
    docs += [(None, docs[0][1]), docs[1], docs[1], (5000, None), (5001, ""), (5002, "ab" * 3000 + " " + "ab" * 3000), (5003, "ab" * 2999 + "b " + "ab" * 2999 + "b"), (5004, "naïveté_naïveté1naïveté")]
    docs.append((5005, "variants " * 400 + "variands " * 30 + "wariands " * 2))  # a chain of forms
    want = spellings(spelled(docs))
    got = sorted(tuple(r) for r in spelling.variants(frame(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == want and any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


def test_spelling_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short words only")])).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
@pytest.mark.parametrize(("letters", "lengths"), [("ab", (7, 8, 9)), ("abcdefgé", (7, 8, 11, 30))])
def test_near_words_of_blocks_of_any_size(spark, block, letters, lengths):
    """Few letters make blocks of many near words; a limit of three cuts nearly all of them finer."""
    counts = {w: c for w, c in misspelt(block, 150, letters, lengths).items() if len(w) >= 7}
    table = spark.createDataFrame([(w.encode("latin-1"), c) for w, c in counts.items()], "word binary, n long")
    near = spelling.near_words(table, Scratch(spark, "test"), block).collect()
    got = sorted((r.word.decode("latin-1"), r.near.decode("latin-1"), r.near_n) for r in near)
    assert got == sorted((w, x, counts[x]) for w, xs in edits(counts).items() for x in xs)


def test_checksums_of_pieces():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.array([0, 10, 10, 500, 4000, 17])
    sizes = np.array([7, 0, 64, 65, 1000, 1])
    before = rng.integers(0, 1 << 32, 6).astype(np.uint32)
    want = [zlib.crc32(data[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, sizes, before)]
    assert spelling.checksums(data, starts, sizes, before).tolist() == want
    assert spelling.checksums(data, starts[:0], sizes[:0], before[:0]).tolist() == []


def test_lexical_terms_are_cut_as_stated():
    found, at = lexical.terms(pa.array(["Ab1-É\x7f2", None, "", "x"]))
    assert found.to_pylist() == [b"ab1", "É".encode(), b"2", b"x"] and at.tolist() == [0, 3, 3, 3, 4]


def test_lexical_query_equals_its_sql(spark):
    import duckdb

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE_SQL})").fetchall())
    got = lexical.op12_lexical_search(spark, base)
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want and want
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
