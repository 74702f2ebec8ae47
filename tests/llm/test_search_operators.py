"""Language ID, hard negatives and lexical search against brute force, on given tables and on awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textledger.llm import hard_negatives, language_id, lexical_search, tiles

SMALL = "/root/testdata/sf0.001"


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def known(row):
    return tuple((value is not None, value) for value in row)


# language ID


def slow_bundle(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    if not words:
        return np.zeros(language_id.DIMENSIONS)
    line = " " + " ".join(words) + " "
    total = np.zeros(language_id.DIMENSIONS)
    for gram in zip(line, line[1:], line[2:]):
        total += language_id.gram_vector(tuple(map(ord, gram)))
    return total


def test_bundles():
    texts = ["Abc  d!", "", " .. ", "é", "x" * 50, "9a9b", "Straße 漢字 ﬁ İ", "end. "]
    found = language_id.bundles(texts)
    assert np.array_equal(found, np.stack([slow_bundle(text) for text in texts]))
    assert np.array_equal(language_id.bundles(["\0", "a"])[1], slow_bundle("a")) and language_id.bundles([]).shape[0] == 0


def test_bundles_of_many_grams(monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS", 7)
    monkeypatch.setattr(language_id, "KEPT_GRAMS", 20)
    texts = ["".join(chr(0x4E00 + at * at % 977) for at in range(300)), "one two three", "four"]
    assert np.array_equal(language_id.bundles(texts), np.stack([slow_bundle(text) for text in texts]))


def test_letter_vectors_are_bound_by_place():
    assert not np.array_equal(language_id.gram_vector((97, 98, 99)), language_id.gram_vector((99, 98, 97)))
    assert abs(language_id.gram_vector((97, 98, 99)).astype(int) @ language_id.gram_vector((97, 98, 100)).astype(int)) < 200


def test_languages_by_brute_force(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    sample = [(row.doc_id, row.text, row.lang) for row in given.collect()]
    held = lambda doc_id: zlib.crc32(str(doc_id).encode()) % 4 == 2
    sums = {}
    for doc_id, text, lang in sample:
        if not held(doc_id) and lang is not None:
            sums[lang] = sums.get(lang, 0) + slow_bundle(text or "")
    expected = {}
    for doc_id, text, _ in sample:
        own = slow_bundle(text or "")
        cosines = {lang: own @ total / np.linalg.norm(own) / np.linalg.norm(total) for lang, total in sums.items()}
        expected[doc_id] = max(sorted(cosines), key=cosines.get), max(cosines.values())
    found = rows(language_id.predicted_languages(given))
    assert len(found) == len(sample)
    for doc_id, is_held, lang, score in found:
        assert is_held == held(doc_id) and lang == expected[doc_id][0] and score == pytest.approx(expected[doc_id][1], abs=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predicted_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_awkward_languages(docs, spark):
    found = rows(language_id.predicted_languages(docs))
    assert len(found) == docs.count() and {row[2] for row in found} == {"en", "und"}
    assert all((row[2] == "und") == (row[3] == 0.0) and 0 <= row[3] <= 1 for row in found)
    texts = {row[0]: row[2] for row in found}
    assert [texts[at] for at in (0, 1, 2, 3)] == ["und", "und", "und", "en"]
    assert rows(language_id.predicted_languages(docs.limit(0))) == []
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {row[2:] for row in rows(language_id.predicted_languages(nothing))} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language_id.identify(docs, language_id.prototypes(docs))


def test_languages_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(rows(language_id.predicted_languages(docs)))
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 1)
    parts = sorted(rows(language_id.predicted_languages(docs)))
    assert [row[:3] for row in whole] == [row[:3] for row in parts]


# hard negatives


def slow_negatives(table):
    kept = []
    for vec_id, vector, label in table:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    bound = lambda score: min((1 << 63) - 1, max(-(1 << 63), score))
    out = []
    for at, (anchor, vector, label) in enumerate(kept):
        if anchor % 100:
            continue
        others = [(bound(sum(a * b for a, b in zip(vector, other[1]))), other) for i, other in enumerate(kept) if i != at and len(other[1]) == len(vector)]
        others.sort(key=lambda pair: (-pair[0], pair[1][0]))
        for score, (positive, _, _) in [pair for pair in others if pair[1][2] == label][:5]:
            fits = [(s, o) for s, o in others if o[2] != label and 80 * score <= 100 * s <= 100 * score]
            out += [(anchor, positive, place, other[0], score, s) for place, (s, other) in enumerate(fits[:5], 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor_id int, score double"


def test_hard_negatives(spark):
    random = np.random.default_rng(5)
    table = [(at, random.normal(size=8).astype(np.float32).tolist(), at % 10) for at in range(300)]
    copy = random.normal(size=8).astype(np.float32).tolist()
    table += [(at, copy, at % 3) for at in range(300, 420)]  # a group of copies, over three labels
    table += [(100, copy, 1), (100, copy, 1), (7, copy, 4), (200, [0.0] * 8, 2), (800, [0.0] * 8, 2), (801, [-x for x in copy], 3)]
    table += [(900, [1.0, 2.0], 1), (901, [2.0, 1.0], 1), (902, [1.5, 1.5], 2), (903, [1.5, 1.25], 2), (904, [], 1), (1000, [], 2)]
    awkward = [(None, copy, 1), (1100, None, 1), (1200, copy, None), (1300, [1.0, None], 1), (1400, [float("nan")] * 8, 1), (1500, [float("inf")] * 8, 1)]
    frame = spark.createDataFrame([(*row, "x", 1, None) for row in table + awkward], SCHEMA)
    found = rows(hard_negatives.hard_negatives(frame))
    assert sorted(found) == sorted(slow_negatives(table + awkward)) and len(found) > 20
    assert rows(hard_negatives.hard_negatives(frame.limit(0))) == []


def test_hard_negatives_of_large_components(spark):
    random = np.random.default_rng(6)
    table = [(at, (random.normal(size=4) * 10.0 ** (at % 9)).astype(np.float32).tolist(), at % 4) for at in range(250)]
    table += [(1000 + at, [1e30, 1.0, 3e5 + at, 0.0], at % 2) for at in range(12)]
    frame = spark.createDataFrame([(*row, None, None, None) for row in table], SCHEMA)
    assert sorted(rows(hard_negatives.hard_negatives(frame))) == sorted(slow_negatives(table))


@pytest.mark.parametrize("share", [0.9, 0.5, 0.2, 0.0, -1.0])
@pytest.mark.parametrize("dims", [1, 5, 16, 50, 64])
def test_threshold_join_candidates(share, dims):
    random = np.random.default_rng(dims)
    vectors = np.floor(random.normal(size=(400, dims)) * 100 * np.linspace(0.1, 3, dims) * random.uniform(0.2, 2, (400, 1)))
    queries = vectors[:30]
    scores = queries @ vectors.T
    least = np.floor(share * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()).astype(np.int64)
    row, query, score, safe = hard_negatives.candidates(vectors, queries, least)
    reached = {(q, r) for q, r in zip(*np.nonzero(scores >= least[:, None]))}
    assert reached <= set(zip(query.tolist(), row.tolist())) and safe.all()
    assert np.array_equal(score, scores[query, row])
    if share >= 0.5 and dims >= 16:
        assert len(row) < 0.2 * scores.size


def test_index_leaves_out_covered_dimensions():
    prefix = np.array([[0.0, 1.0, 2.0, 3.0], [0.0, 5.0, 6.0, 7.0], [0.0, 0.1, 0.1, 0.2]])
    assert hard_negatives.index_starts(prefix, 2.5).tolist() == [2, 0, 3]
    assert hard_negatives.index_starts(prefix, -np.inf).tolist() == [0, 0, 0]


def test_tiles_are_bounded(spark):
    frame = spark.range(5000).select(
        F.col("id").alias("row"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(2).alias("dims"), F.lit(2.3).alias("norm")
    )
    found = rows(tiles.packed(frame.coalesce(1), ["row"]).select("size", "longest"))
    assert sum(size for size, _ in found) == 5000 and max(size for size, _ in found) <= tiles.TILE
    assert tiles.places(1) == 1 and tiles.places(26) == 26 and tiles.places(640_000) == 10_000


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, k=10):
    counts = [(doc_id, Counter(slow_terms(text))) for doc_id, text in docs]
    counts = [(doc_id, found) for doc_id, found in counts if found]
    number, total = len(counts), sum(found.total() for _, found in counts)
    out = []
    for item_id, text in items:
        asked, scores = Counter(slow_terms(text)), []
        df = {term: sum(term in found for _, found in counts) for term in asked}
        for doc_id, found in counts:
            m = 25 + 75 * found.total() * number // total
            parts = [
                times * math.floor(1000 * math.log((2 * number + 2) / (2 * df[term] + 1))) * (10**9 * found[term] // (1000 * found[term] + 8 * m))
                for term, times in asked.items()
                if found[term]
            ]
            scores.append((-sum(parts), doc_id is None, doc_id))
        best = sorted(score for score in scores if score[0] < 0)[:k]
        out += [(item_id, place, doc_id, -score) for place, (score, _, doc_id) in enumerate(best, 1)]
    return out


ITEMS = [
    (1, "The quick brown fox"),
    (2, "the QUICK brown dog, the the naïve; 漢字 😀"),
    (2, "word5 word6 word7 nothing"),
    (3, None),
    (4, " .,! "),
    (None, "one other end"),
    (5, "no such term at all zzzz"),
    (6, " ".join(f"word{at}" for at in range(2995))),
    (7, "a b c x y"),
    (7, "a b c x y"),
]


def test_terms():
    texts = ["It's A_b-C é٣x\x7fy \x00z", "ÀÉ É", "", "a b c", "\x1cQ\x85R"]
    assert [[term.decode() for term in lexical_search.terms(text.encode())] for text in texts] == [slow_terms(text) for text in texts]


def test_lexical_search(spark, docs):
    items = spark.createDataFrame([(item, text, 1, "z") for item, text in ITEMS], "item_id long, text string, rank int, doc_id string")
    plain = [(row.doc_id, row.text) for row in docs.collect()]
    expected = sorted(slow_search(plain, ITEMS), key=known)
    assert sorted(rows(lexical_search.search(docs, items)), key=known) == expected
    assert rows(lexical_search.search(docs.limit(0), items)) == [] == rows(lexical_search.search(docs, items.limit(0)))
    given, benchmark = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    expected = slow_search([(row.doc_id, row.text) for row in given.collect()], [tuple(row) for row in benchmark.select("item_id", "text").collect()])
    assert sorted(rows(lexical_search.search(given, benchmark))) == sorted(expected)


def test_lexical_search_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(rows(lexical_search.search(docs, items)), key=known)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    assert sorted(rows(lexical_search.search(docs, items)), key=known) == whole


def test_sharing_plan():
    names = ["the of in and", "the of in or", "the of x", "y z", "the of in and", "q"]
    frame = pd.DataFrame([(item, term.encode(), 1) for item, text in enumerate(names) for term in text.split()], columns=["item", "term", "times"])
    leaves, rounds, of = lexical_search.sharing_dag(frame)

    def expand(node):
        flat = [pair for pairs in rounds for pair in pairs]
        return [leaves[node][0]] if node < len(leaves) else [term for child in flat[node - len(leaves)] for term in expand(child)]

    for item, text in enumerate(names):
        assert sorted(term for node in of[item] for term in expand(node)) == sorted(text.encode().split())
    assert rounds and any(set(expand(node)) == {b"the", b"of", b"in", b"and"} for node in of[0]) and of[0] == of[4]
    plan = lexical_search.Plan(frame)
    gains = np.arange(len(plan.terms) * 3).reshape(len(plan.terms), 3)
    expected = {item: gains[[plan.terms.index(term.encode()) for term in text.split()]].sum(axis=0).tolist() for item, text in enumerate(names)}
    assert dict(zip(plan.items.tolist(), plan.scores(gains).tolist())) == expected
    alone = sum(len(text.split()) for text in names)
    assert sum(map(len, rounds)) + sum(map(len, of.values())) < alone


def test_best_keeps_all_ties():
    best = lexical_search._Best(1, 3)
    for begin in (9, 6, 3, 0):
        ids = np.arange(begin, begin + 3)
        best.add(np.full((1, 3), 5), np.array([0, 0, 0]), ids)
        best.close()
    assert best.columns[3].tolist() == [0, 1, 2]
