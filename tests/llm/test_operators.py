"""The training-data operators on small hand-made tables, against brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reqlake.llm import chat_rotation, exact_dedup, langid, license_scan, mixing, ngram_join, sentencepiece_dropout, suffix_dedup, textkit, topk, warc
from reqlake.llm.common import Scratch
from reqlake.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words string, _key string, label string"


def words(text):
    return (text or "").encode().translate(LOWER).split()


def documents(seed=5):
    """Nulls, empties, a very long text, ties, copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "  \t ", "one", "One", "two words", "three word text", prose(9000)]
    base, passage = prose(120), prose(70)
    for i in range(12):  # near copies, edited in up to eight places
        w = base.split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [base.upper()] * 5 + [f"{prose(60)}\n{passage} {prose(60)}" for _ in range(4)] + [prose(rng.randint(1, 200)) for _ in range(30)]
    texts.append("x " * 300)
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """The documents' columns, and extra ones whose names clash with the operators' own."""
    full = [(i, t, "en", f"s{i % 3}" if i is not None and i % 7 else None, 0, "x", "y", "z", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# textkit


def test_words_and_shingles_name_what_they_should():
    import pyarrow as pa

    from reqlake.llm.common import text_bytes

    rng = random.Random(1)
    texts = [None, "", "a", "A b\tc\x0bd e", "b a a b", "a b b a"] + ["".join(rng.choice(" ab\tB\né") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    hashes, at = textkit.word_hashes(*text_bytes(pa.array(texts)))
    shingles, out = textkit.shingle_hashes(hashes, at, 4)
    names: dict = {}
    for i, t in enumerate(texts):
        w = words(t)
        expected = [tuple(w[j : j + 4]) for j in range(len(w) - 3)] if len(w) >= 4 else [tuple(w)] if w else []
        assert out[i + 1] - out[i] == len(expected)
        for s, h in zip(expected, shingles[out[i] : out[i + 1]]):
            assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)


def test_repetitive_words_have_names_of_their_own():
    import pyarrow as pa

    from reqlake.llm.common import text_bytes

    thue, other = "a", "b"
    for _ in range(10):  # the words of 1,024 letters that cancel out in sums of powers modulo 2**64
        thue, other = thue + other, other + thue
    hashes, _ = textkit.word_hashes(*text_bytes(pa.array([thue, other, thue * 5, other * 5, thue])))
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (3, 2)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in out} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert len(out) == 61


# op1


def test_pieces_equal_the_library_without_dropout(rows):
    import sentencepiece

    model = sentencepiece_dropout.pieces(sentencepiece_dropout.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    texts = [t or "" for _, t in rows] + [" a  b ", "x\n\ty", "tokenization" * 20, "你好 😀\0"]
    found, offsets = sentencepiece_dropout.encode_texts(model, texts, np.arange(len(texts)), 0.0, 1)
    for t, lo, hi in zip(texts, offsets, offsets[1:]):
        assert found[lo:hi].tolist() == library.encode(t)


def test_dropout_equals_one_agenda_over_the_whole_text(rows):
    model = sentencepiece_dropout.pieces(sentencepiece_dropout.MODEL)
    texts = [t or "" for _, t in rows[:24]] + ["▁literal ▁ mark", "y" * 90]
    below = sentencepiece_dropout.threshold(0.3)
    found, offsets = sentencepiece_dropout.encode_texts(model, texts, np.arange(len(texts)), 0.3, 9)
    for k, (t, lo, hi) in enumerate(zip(texts, offsets, offsets[1:])):
        full, expected = f" {t}" if t else "", []
        symbols = [int(model.chars[ord(c)]) for c in full]
        key = int(sentencepiece_dropout.document_key(9, np.array([k]))[0])
        for place, piece in sentencepiece_dropout.agenda(model, symbols, list(range(len(symbols))), key, below):
            expected += [piece] if piece >= 0 else model.byte_ids[list(full[place].encode())].tolist()
        assert found[lo:hi].tolist() == expected
        assert model.decode(found[lo:hi]).decode() == t


def test_encoding_is_lossless_repeatable_and_varied(docs, empty):
    one, two, other = (sentencepiece_dropout.encode(docs, seed=s) for s in (1, 1, 2))
    a, b, c = ({r.doc_id: r for r in x.collect()} for x in (one, two, other))
    assert all(r.lossless for r in a.values()) and all(a[i].pieces == b[i].pieces for i in a)
    assert any(a[i].pieces != c[i].pieces for i in a)
    assert {r.doc_id: r.text for r in sentencepiece_dropout.decode(one).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert sentencepiece_dropout.encode(empty).count() == 0


# op2


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_ngram_components(docs, rows, k, num, den):
    out = ngram_join.ngram_components(docs, k=k, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, k, num, den)
    assert len(out) == len(rows)


def test_ngram_blocks_of_a_large_bucket(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    out = ngram_join.ngram_components(frame(spark, rows), k=4, num=85, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 85, 100)


def test_ngram_family_below_and_above_the_threshold(spark, monkeypatch):
    """Hot shingles of a template family: some pairs link, most fall just short, and sizes spread over several classes."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(90):
        w = list(base) + [f"tail{i}x{j}" for j in range(rng.choice([0, 3, 9, 30, 80]))]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    expected = brute_components(rows, 4, 85, 100)
    assert 10 < len({c for _, c in expected.values()}) < 80
    for block in (2048, 8):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        out = ngram_join.ngram_components(frame(spark, rows), k=4, num=85, den=100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected


@pytest.mark.parametrize(("num", "den"), [(4, 5), (1, 4)])
def test_ngram_links_across_widths_in_both_id_orders(spark, num, den):
    rng = random.Random(13)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in (1032, 2060):  # shingles on both sides of 1024 and of 2048
        for _ in range(2):
            w = prose(n)
            pair = [" ".join(w), " ".join(w[:-30])]
            rows += [(len(rows) + i, t) for i, t in enumerate(pair if len(rows) % 4 else pair[::-1])]
    w = prose(3000)
    rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:900]))]  # two widths apart: linked at 1 / 4 only
    expected = brute_components(rows, 5, num, den)
    assert sum(i != c for i, (_, c) in expected.items()) == (5 if num == 1 else 4)
    out = ngram_join.ngram_components(frame(spark, rows), k=5, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected


def test_ngram_empty_and_repeated_rows(spark, empty):
    assert ngram_join.ngram_components(empty).count() == 0
    out = ngram_join.ngram_components(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (None, "a"), (1, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (4, 4), (4, 4), (9, 4)]


# op3


def brute_targets(sizes):
    """Targets by source (None last): what is left is shared by weight, again and again, until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def check_mix(rows, out):
    """``rows`` are (id, text, source), ``out`` what was taken of them; compared as multisets."""
    sizes = [(i, s, len((t or "").encode().split())) for i, t, s in rows]
    totals: dict = {}
    for _, s, n in sizes:
        totals[s] = totals.get(s, 0) + n
    targets = brute_targets(totals)
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in out) == sorted((str(i), n, totals[s], round(targets[s], 6)) for i, s, n in sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    by_target: dict = {}
    for s in totals:
        by_target.setdefault((totals[s], round(targets[s], 6)), []).append(s)
    for (size, target), own in by_target.items():
        taken = sum(r.taken for r in out if (r.source_size, round(r.target, 6)) == (size, target))
        assert abs(taken - target * len(own)) < len(own) * max([n for _, s, n in sizes if s in own] + [1])


def test_mix_meets_its_targets(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    check_mix([(i, t, f"s{i % 3}" if i % 7 else None) for i, t in rows], out)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_of_many_sources_and_repeated_rows(spark):
    rng = random.Random(6)
    names = [None, "", "a", "A", "é", "zz", "z", "\U0001f600", "\uffee", "hot"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), "hot" if i % 3 == 0 else rng.choice(names)) for i in range(600)]
    rows += [(7, "same row " * 3, "rep")] * 150 + [(None, None, None), (None, "x", None), (8, "one id", "rep"), (8, "two texts here", "rep")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(table).collect()
    check_mix(rows, out)
    again = mixing.mix_sources(table.repartition(5)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))

    clash = table.withColumn("_id", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("total", F.lit("c")).withColumn("row", F.lit("c")).withColumn("digest", F.lit("c"))
    mix = mixing.mixed(clash)
    assert mix.columns == clash.columns
    assert sum(len((r.text or "").split()) for r in mix.collect()) == sum(r.taken for r in out)


def test_mix_writes_uneven_repeats_of_equal_and_unequal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 4)
    rows = [(1, "three words here", "c", n) for n in [0] * 37 + [1] * 5 + [2]] + [(i, "w " * 10, "ab"[i % 2], i) for i in range(2, 82)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    wanted = sum(r.copies for r in mixing.mix_sources(table).where("doc_id = 1").collect())
    assert wanted % 43
    got = [tuple(r) for r in mixing.mixed(table).collect()]
    ones = [r for r in got if r[0] == 1]
    assert len(ones) == wanted
    whole = wanted // 43
    for n, m in ((0, 37), (1, 5), (2, 1)):
        assert whole * m <= ones.count((1, "three words here", "c", n)) <= (whole + 1) * m
    assert sorted(got) == sorted(tuple(r) for r in mixing.mixed(table.repartition(6)).collect())


def test_pivotal_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 41).astype(float)
    hits = np.zeros(41)
    for _ in range(3000):
        p = mixing.pivotal(size, np.full(41, 0.3), rng.random(41))
        assert abs((p * size).sum() - 0.3 * size.sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        hits += p
    assert np.abs(hits / 3000 - 0.3).max() < 0.05


@pytest.mark.parametrize("n", [2, 5, 50])
def test_last_blocks_keep_expectations(n):
    """Mean copies over many seeds, the last document's included, are the probabilities."""
    rng = np.random.default_rng(n)
    size = np.array([100, 90, 10, 7, 3] * (n // 5) or [40, 3], float)
    pdf = pd.DataFrame({"id": np.arange(n), "digest": rng.integers(1 << 60, size=n), "turn": 0, "size": size.astype(int), "p": 0.375})
    seeds = 3000 if n < 50 else 800
    hits = np.zeros(n)
    for seed in range(seeds):
        out = mixing._round_block(seed, 1, True)(pdf)
        assert set(out.p) <= {0.0, 1.0} and abs((out.p - 0.375) @ out["size"]) <= 100
        hits[out.id] += out.p
    assert np.abs(hits / seeds - 0.375).max() < 4.5 * np.sqrt(0.375 * 0.625 / seeds)


def test_mix_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 9)) for i in range(400)]
    out = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(out) == 400
    taken = {}
    for r in out:
        taken.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - target) <= 9 for target, v in taken.items())


# op4


def test_license_places_and_blocks(spark, empty):
    mit = license_scan.TEMPLATES[0][1]
    rows = [(0, "Released under the MIT License. MIT-license, mit LICENSE"), (1, None), (2, ""), (3, f"{'word ' * 70}{mit.replace(' is ', ' was ')}"), (4, "the gnu general public license; cc by cc by"),
            (5, "permission to speak freely"), (6, "Apache  License" + " é" * 20000), (6, "Apache  License" + " é" * 20000)]
    out = license_scan.scan(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in out}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (3, 3, 7, "mit", 1.0)
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (3, 1, 7, "cc-by,gpl")
    assert (got[3].n_base, got[3].labels, got[3].first_word) == (0, "mit", None) and license_scan.THRESHOLD <= got[3].score < 1
    assert (got[5].labels, got[5].score, got[1].n_words, got[2].n_words) == ("", 0.0, 0, 0)
    assert got[6].n_words == 20002 and len(out) == len(rows)
    assert license_scan.scan(empty).count() == 0


def test_look_alike_licenses_get_one_label(spark):
    notice = dict(license_scan.TEMPLATES)
    rng = random.Random(4)
    rows = [(i, f"{some_prose(rng, 5 + 13 * i)} {notice[k]}. {some_prose(rng, 70)}") for i, k in enumerate(notice)]
    rows.append((100, f"{notice['lgpl'].replace('Lesser', 'Lesser (not Affero)')} {some_prose(rng, 99)}"))
    out = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, rows)).collect()}
    assert out == {i: k for i, k in enumerate(notice)} | {100: "lgpl"}
    assert all(len(words) <= 58 for _, _, words in license_scan.template_words())


# op5


def brute_passages(rows):
    """(id, word) of every word in a run of 50 that another document has too."""
    texts = [(i, words(t)) for i, t in rows if i is not None]
    seen: dict = {}
    for i, w in texts:
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(i)
    return {(i, p) for i, w in texts for j in range(len(w) - 49) if len(seen[tuple(w[j : j + 50])]) > 1 for p in range(j, j + 50)}


def found_words(out):
    return {(r.doc_id, p) for r in out for p in range(r.first_word, r.last_word + 1)}


def some_prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_repeated_passages(docs, rows, empty):
    out = suffix_dedup.repeated_passages(docs).collect()
    assert found_words(out) == brute_passages(rows)
    assert all(r.n_words >= 50 and r.partner_id != r.doc_id for r in out)
    assert suffix_dedup.repeated_passages(empty).count() == 0


def one_kept_suffix(rng, sentences, words_each, lowest, highest):
    """Sentences whose only kept suffix starts in the given range of words and is kept beside other words too."""
    import pyarrow as pa

    from reqlake.llm.common import text_bytes

    while True:
        s = [some_prose(rng, words_each) for _ in range(sentences)]
        hashes, at = textkit.word_hashes(*text_bytes(pa.array([" ".join(s)])))
        kept, grams = suffix_dedup.minimisers(hashes, at, 50)
        if len(kept) == 1 and lowest <= kept[0] <= highest and grams[0] < 2**63 // 100:
            return s


def test_passages_of_recombined_sentences(spark):
    rng = random.Random(21)
    s = one_kept_suffix(rng, 5, 12, 24, 28)
    whole, head, tail = " ".join(s), " ".join(s[:3]), " ".join(s[2:])
    rows = [(i, f"{some_prose(rng, 1)} {whole} {some_prose(rng, 1)}") for i in (0, 200)]
    rows += [(i, f"{some_prose(rng, 60)} {tail} {some_prose(rng, 1)}" if i % 2 else f"{some_prose(rng, 1)} {head} {some_prose(rng, 60)}") for i in range(1, 160)]
    expected = brute_passages(rows)
    assert {i for i, _ in expected} == {0, 200}
    out = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    assert found_words(out) == expected
    assert {(r.doc_id, r.partner_id) for r in out} == {(0, 200), (200, 0)}


@pytest.mark.parametrize("at", [0, 10, 21, 30, 42])
def test_a_passage_among_decoys_in_both_orders(spark, at):
    """50 words shared by two documents, whose gram is followed (and preceded) by nearly the same words in twelve decoys on either side."""
    rng = random.Random(100 + at)
    while True:
        (s,) = one_kept_suffix(rng, 1, 50, at, at)
        break
    w = s.split()
    after, before = w[at + 8 :], w[:at]
    rows = [(0, f"{some_prose(rng, 5)} {s} {some_prose(rng, 5)}"), (500, f"{some_prose(rng, 5)} {s} {some_prose(rng, 5)}")]
    for i in range(24):  # half of the words that follow, then others; half of those that precede, then others
        some = [*before[len(before) // 2 :], *w[at : at + 8], *after] if i % 2 else [*before, *w[at : at + 8], *after[: len(after) // 2]]
        rows.append((i * 20 + 7, f"{some_prose(rng, 45)} {' '.join(some)} {some_prose(rng, 45)}"))
    out = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    assert found_words(out) == brute_passages(rows)


@pytest.mark.parametrize("parts", [1, 2, 50])
def test_passages_do_not_depend_on_partition_cuts(spark, parts):
    rng = random.Random(33)
    passages = [some_prose(rng, 55) for _ in range(6)]
    rows = [(1, " ".join(f"{p} {some_prose(rng, 30)}" for p in passages for _ in range(4)))]
    rows += [(i, f"{some_prose(rng, 9)} {p} {some_prose(rng, 9)}") for i, p in enumerate(passages, 2)]
    rows += [(1, "a second text of document one"), (1, f"{passages[0]} {some_prose(rng, 5)}"), (None, passages[1])]
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert found_words(out) == brute_passages(rows)
    assert len(out) == 24 + 6 + 1 and {r.partner_id for r in out if r.doc_id > 1} == {1}


# op6


def test_every_participant_gets_a_rendering(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob b", None), (1, 3, "ann", "bye"), (2, 0, None, "x"), (3, 0, "system", "alone"), (1, 3, "ann", "bye")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash")).withColumn("position", F.lit(1))
    out = {(r.conv_id, r.speaker): r for r in chat_rotation.render(table).collect()}
    assert set(out) == {(1, "ann"), (1, "bob b"), (2, None)}
    ann = out[1, "ann"]
    assert ann.text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob%20b|>\n<|end|>\n<|assistant|>\nbye<|end|>\n<|assistant|>\nbye<|end|>\n"
    spans = [ann.text[slice(*map(int, s.split("-")))] for s in ann.trained_spans.split(",")]
    assert spans == ["hi < |end|><|end|>\n", "bye<|end|>\n", "bye<|end|>\n"]
    assert (ann.n_turns, ann.n_trained_turns, ann.trained_chars) == (5, 3, sum(map(len, spans)))
    assert chat_rotation.render(table.limit(0)).count() == 0


def test_participants_stay_apart(spark):
    names = ["bob b", "bob_b", "bob+b", "bob*b", "bob~b", "你好", "再见", None, "unknown", "", "system "]
    turns = [(1, i, name, f"t{i}") for i, name in enumerate(names)] + [(1, 99, "system", "s")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.speaker: r for r in chat_rotation.render(table).collect()}
    assert set(out) == set(names)
    for name, r in out.items():
        assert r.n_trained_turns == 1 and r.text.count("<|assistant|>") == 1 and f"<|assistant|>\nt{names.index(name)}<|end|>" in r.text
    heads = [line for line in out[None].text.split("\n") if line.startswith("<|user")]
    assert len(set(heads)) == len(names) - 1 and "<|user|>" not in heads and "<|user|>" in out["unknown"].text

    import duckdb

    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    oracle = db.sql(chat_rotation.ORACLE_SQL)
    assert {r[1]: r for r in oracle.select("conv_id", "speaker", "text", "trained_spans", "n_turns", "n_trained_turns", "trained_chars").fetchall()} == {k: tuple(r) for k, r in out.items()}


# op7


def test_archives_round_trip(spark):
    same, short = "é" * 60, "short"
    pages = [(5, "http://a/ b", same), (3, None, same), (4, "http://c/?q=1\r\nX: y", same), (7, "u", short), (8, "u", short), (9, "u", None), (10, "u", "z" * 300000), (3, None, same)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(3)
    out = warc.archive_round_trip(table).collect()
    assert len(out) == len(pages)
    for r in out:
        payload = (next(h for i, _, h in pages if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id < 7) == [(3, "response", None), (3, "response", None), (4, "revisit", 3), (5, "revisit", 3)]
    assert all(r.record_type == "response" for r in out if r.page_id >= 7)
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_index_selects_records(spark):
    scratch = Scratch(spark, "warc-test")
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    index = scratch.save(warc.write_archives(pages, f"{scratch.root}/archives"), "index")
    out = warc.read_records(index.where("page_id between 10 and 12 or url = 'http://h/40'"), f"{scratch.root}/archives").collect()
    assert {r.page_id: bytes(r.payload) for r in out} == {i: str(i).encode() * 200 for i in (10, 11, 12, 40)}


def test_archive_folders_are_where_spark_puts_them(spark):
    from reqlake import storage

    assert storage.qualified(spark, "/tmp/x") == "file:/tmp/x" and warc.open_folder("file:/tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="no file system"):
        warc.open_folder("/tmp/x")


def test_ranges_are_coalesced():
    reads = list(warc.coalesced([("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("a", 10**6, 5), ("b", 0, 3)]))
    assert [(f, s, e, len(i)) for f, s, e, i in reads] == [("a", 0, 105, 3), ("a", 10**6, 10**6 + 5, 1), ("b", 0, 3, 1)]


# op8


def languages():
    rng = random.Random(8)
    stems = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["schen", "ung", "der", "keit", "ich"], "cc": ["eaux", "que", "ment", "les", "oir"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60) if i % 50 else 4000)), lang))
    return rows + [(1000, None, "aa"), (1001, "", None), (1002, "123 ²½ !!", "bb"), (None, "the and ing er the tion", "aa")]


def test_language_is_told_on_held_out_texts(spark):
    import zlib

    rows = languages()
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_lang", F.lit("clash")).withColumn("rank", F.lit("clash"))
    out = {r.doc_id: r for r in langid.identify(table).collect()}
    truth = {i: lang for i, _, lang in rows if i is not None and i < 1000}
    assert {i: r.held_out for i, r in out.items()} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in out}
    held = [i for i in truth if out[i].held_out]
    assert len(held) > 30 and sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].rejected and out[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(rows)
    kept = langid.identified(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}
    assert langid.identify(table.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}

    # every prediction against the sizes of the whole text, counted here
    content = langid.train(table)
    assert list(content) == sorted(content, key=lambda k: -sum(lang == k for _, _, lang in rows[:300])) and set(content) == {"aa", "bb", "cc"}
    made = dict(langid.compressors(content))
    for i, t, _ in rows[:300]:
        raw = t.lower().encode()
        size = {k: sum(len(c.compress(raw[j : j + 4096] * 4)) for j in range(0, len(raw), 4096)) for k, c in made.items()}
        best, second = sorted(size.values())[:2]
        assert size[out[i].lang_pred] == best and out[i].score == pytest.approx(1 - best / second) and out[i].rejected == (1 - best / second < langid.NARROW)


def test_language_training_reads_rows_not_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(langid, "PASSAGE_CHARS", 50)
    rows = languages()
    rows += [(5000, f"repeated words number {i}", "bb" if i % 2 else "aa") for i in range(300)] + [(5000, "a row without label", None)] * 3 + [(5001, "same text again", "cc")] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    content = langid.train(table)
    for lang, data in content.items():
        passages = set(data.decode().split("\n"))
        own = {t.lower() for i, t, k in rows if k == lang and t and i is not None and zlib.crc32(str(i).encode()) % 5}
        cut = {t: {t[j : j + 50] for j in range(0, len(t), 50)} for t in own}
        used = [t for t in own if cut[t] <= passages]
        assert 5 < len(used) < 60 and set().union(*[cut[t] for t in used]) == passages  # whole texts: no passage of a chosen one is left out


# op9


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(400, 8)), 2).astype(np.float32)
    v[50:200] = v[100]  # one vector, many times over
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (300, [float(x) for x in v[300]]), (900, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    ints = {i: [int(np.floor(1024 * float(x))) for x in v[i]] for i in range(400)} | {900: [0] * 8}
    expected = set()
    for q in [i for i in ints if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:10]
        expected |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(table).collect()} == expected
    assert topk.exact_top_k(table.where("vec_id in (100, 101)")).count() == 1
    assert topk.exact_top_k(table.limit(0)).count() == 0


def test_top_k_of_many_groups_and_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 8 * 6 * 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "FILE_BLOCK", 16)
    rng = random.Random(12)
    vectors = [(i, [rng.choice([0.5, 1.25, 2.0, 3.5]) for _ in range(rng.choice([3, 6]))]) for i in range(900)] + [(7, [9.0] * 6), (7, [8.0] * 6), (100, [4.0] * 6)]
    ints = [(i, [int(1024 * x) for x in v] + [0] * (6 - len(v))) for i, v in vectors]
    expected = []
    for q, vq in [x for x in ints if x[0] % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(vq, vc)), c) for c, vc in ints if c != q)[:10]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    out = topk.exact_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == sorted(expected)


# op10


def brute_groups(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().translate(LOWER), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g)


@pytest.mark.parametrize("block_hash", [None, lambda b: F.octet_length(b).cast("long")], ids=["hash", "clashing hash"])
def test_exact_groups(spark, rows, block_hash, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 16)
    if block_hash:  # blocks of one length clash: names must come from the blocks themselves
        whole = exact_dedup.identities
        monkeypatch.setattr(exact_dedup, "identities", lambda *a: whole(*a, block_hash=block_hash))
    rows = rows + [(900, "É" + "a" * 40), (901, "é" + "A" * 40), (902, "É" + "A" * 40), (902, "É" + "A" * 40)]
    out = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in out) == brute_groups(rows)


def test_exact_dedup_keeps_one_row_of_repeats(spark, empty):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, "b"), (3, "c")]
    out = exact_dedup.exact_duplicates_dropped(frame(spark, rows))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "A"), (3, "b"), (3, "c")] and out.columns == empty.columns
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_dedup_survivor_does_not_depend_on_partitions(spark):
    rows = [(7, "Hello World"), (7, "hello world"), (7, "HELLO WORLD"), (7, "HELLO WORLD"), (3, "hello world"), (8, "other"), (None, "Text"), (None, "tEXT")]
    for turn, parts in enumerate((1, 2, 3, 7)):
        docs = frame(spark, rows[turn:] + rows[:turn]).repartition(parts)
        out = sorted(((r.doc_id or 0, r.text) for r in exact_dedup.exact_duplicates_dropped(docs).collect()))
        assert out == [(0, "Text"), (7, "HELLO WORLD"), (8, "other")]


# the SQL of the registered queries


@pytest.mark.parametrize("name", ["op4_license_scan", "op6_chat_rotation", "op7_warc", "op9_exact_topk", "op10_exact_dedup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from reqlake.llm import registry

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = registry.QUERIES[name](spark, folder)
    columns = sorted(out.columns)
    oracle = db.sql(registry.ORACLE_SQL[name])
    assert sorted(oracle.columns) == columns
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    assert sorted(tuple(map(text, r)) for r in out.select(*columns).collect()) == sorted(tuple(map(text, r)) for r in oracle.select(*columns).fetchall())


def test_telling_words_count_inside_a_name_only(spark):
    notice = dict(license_scan.TEMPLATES)
    rng = random.Random(9)
    stray = {"gpl": "a copy of the lesser license and an affero one", "cc-by": "no noncommercial clause, sharealike or noderivatives", "cc-by-nc": "sharealike is not asked for"}
    rows = [(n, f"{some_prose(rng, at)} {before} {notice[k]}. {after} {some_prose(rng, 9)}", k) for n, (k, at, before, after) in enumerate(
        (k, at, *words) for k, s in stray.items() for at in (0, 7, 31, 60) for words in ((s, ""), ("", s), (s, s))
    )]
    rows += [(900, "lesser " + notice["gpl"], "gpl")]
    out = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, [r[:2] for r in rows])).collect()}
    assert out == {n: k for n, _, k in rows}


def test_license_sql_of_notices(spark):
    import duckdb

    notice = dict(license_scan.TEMPLATES)
    rng = random.Random(5)
    rows = [(i, f"{some_prose(rng, 17 * i)} {notice[k]}. {some_prose(rng, 20)} {notice[rng.choice(list(notice))]}") for i, k in enumerate(list(notice) * 2)]
    rows += [(100 + i, f"lesser {notice[k]}. A copy of the lesser license, noncommercial, affero {some_prose(rng, i)}") for i, k in enumerate(notice)]
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    oracle = db.sql(license_scan.ORACLE_SQL)
    out = license_scan.scan(frame(spark, rows)).select(*oracle.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    assert sorted(tuple(map(text, r)) for r in out.collect()) == sorted(tuple(map(text, r)) for r in oracle.fetchall())
