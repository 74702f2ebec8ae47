"""Each operator against brute force or the library that it has to agree with, on given tables and on awkward rows."""

import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textledger.llm import (
    components,
    jaccard_join,
    language_model,
    mixing,
    quality_classifier,
    quality_rules,
    quotation_links,
    sentencepiece_lattice,
    token_counts,
    token_files,
    topk_search,
)

WORD, BYTE, PIECE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def both(docs, given):
    return [docs, given, docs.limit(0)]


def in_order(frame):
    return sorted(frame.select("doc_id", "text").collect(), key=lambda row: (row.doc_id is not None, row.doc_id or 0))


def test_token_files(docs, given):
    library = Tokenizer.from_file(WORD)
    for frame in both(docs, given):
        found, start, expected = token_files.token_file_digest(frame, WORD), 0, []
        for row in in_order(frame):
            ids = np.array(library.encode(row.text or "", add_special_tokens=False).ids + [1], "<u4")
            expected.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        key = lambda row: (row[1], row[2])
        assert sorted(rows(found), key=key) == sorted(expected, key=key)


def test_token_file_format(spark, given, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(given, WORD, folder)
    file = pq.ParquetFile(sorted((tmp_path / "tokens").glob("part-*"))[0])
    columns = {file.metadata.row_group(0).column(at).path_in_schema: file.metadata.row_group(0).column(at) for at in range(5)}
    ids = next(column for name, column in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in encoding for encoding in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert ids.has_offset_index and columns["doc_id"].has_column_index
    part = token_files.read_tokens(spark, folder, 10, 12).select("doc_id", "n_tokens")
    assert sorted(row[0] for row in rows(part)) == [10, 11, 12]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_words_one_by_one():
    encoder, library = token_files.Encoder(WORD), Tokenizer.from_file(WORD)
    texts = ["It's <|endoftext|> A<|ENDOFTEXT|>x 'tis DON'T É É a≠b x\x1cy \xa0z ΣΑΣ, 12a.3b ''a' a'.b' «x». ÷a", "", " ", "--"]
    lengths, ids = encoder.encode(pa.array([*texts, None]))
    assert [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode(text, add_special_tokens=False).ids for text in [*texts, ""]]


def test_language_model(docs, given):
    for frame in both(docs, given):
        held = lambda doc_id: zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 7 == 2
        plain, counts = [(row.doc_id, (row.text or "").encode()) for row in in_order(frame)], Counter()
        for doc_id, text in plain:
            counts.update([] if held(doc_id) else language_model.tokens(text))
        total, distinct = sum(counts.values()), len(counts)
        found = sorted(rows(language_model.score_texts(frame)), key=lambda row: (row[0] is not None, row[0] or 0, row[2]))
        assert len(found) == len(plain)
        for (doc_id, text), row in zip(plain, found):
            own = language_model.tokens(text)
            base = sum(math.log10((counts[word] + 1) / (total + distinct + 1)) for word in own)
            assert row[:5] == (doc_id, held(doc_id), len(own), sum(counts[word] > 0 for word in own), total)
            assert row[5] == pytest.approx(base) and row[6] <= 1e-9
    assert sum(row[6] for row in found) >= sum(row[5] for row in found)


def test_language_model_beats_single_words(spark, given):
    """Held-out rows of a non-empty table beat single words; rare words score by what stands before them."""
    scored = language_model.score_texts(given).where("held_out").agg(F.count("*"), F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > 0 and scored[1] > scored[2]
    name = lambda kind, at: f"{kind}{zlib.crc32(f'{kind}{at}'.encode())}"
    text = lambda at, other: " ".join(name("xy"[(at + (i % 2) * other) % 2], (at * 37 + i * 101) % 1500) for i in range(60))
    held = [at for at in range(900) if zlib.crc32(str(at).encode()) % 7 == 2]
    frame = spark.createDataFrame([(at, text(at, at in held[::2])) for at in range(900)], "doc_id long, text string")
    gain = {row.doc_id: row.score - row.base_score for row in language_model.score_texts(frame).collect()}
    assert np.mean([gain[at] for at in held[1::2]]) > np.mean([gain[at] for at in held[::2]]) + 3


def small_language_model():
    """A model trained on a few texts, with words of all three kinds."""
    texts = [" ".join(f"w{(at * at + i * 7) % (20 + at * 5)}x{(at + i) % 3}" for i in range(80)).encode() for at in range(60)]
    counts = Counter(word for text in texts for word in language_model.tokens(text))
    words = sorted(counts, key=lambda word: (-counts[word], word))
    n = np.array([counts[word] for word in words])
    shape = language_model.Shape(int(n.sum()), len(words))
    cuts = shape.cuts(words, n)
    totals = np.zeros((shape.leaves, 2))
    for word in words[language_model.SINGLE + shape.middle :]:
        totals[np.searchsorted(cuts, language_model.ending_keys([word])[0])] += counts[word], 1
    vocabulary = language_model.Vocabulary(words, n, shape, cuts, totals)
    model = language_model.Model(vocabulary)
    data = vocabulary.encode(texts)
    for rate in (0.4, 0.2):
        sums = model.zeros()
        model.gather(data, sums)
        model.step(sums, rate)
    return vocabulary, model, words, texts, data, sums


def test_language_model_shares_sum_to_one():
    vocabulary, model, words, texts, data, sums = small_language_model()
    for view, choice, key in zip(model.by_choice(sums), model.choices, ("first", "second", "third")):
        taking = int((data[key] >= 0).sum())
        features = {"first": 5, "second": 3, "third": 2}[key]
        assert taking and view[0].sum() == features * taking and view[1].sum() == pytest.approx(features * taking, rel=1e-3)
    leaves = np.flatnonzero(vocabulary.totals[:, 1])
    for history in (b"", texts[3][:40], texts[5] + b" never seen"):
        each = vocabulary.encode([(history + b" " + word) if word != language_model.END else history for word in words])
        last = np.cumsum(each["sizes"]) - 2
        last[words.index(language_model.END)] += 1
        shares = 10 ** language_model.token_scores(model, vocabulary, each)
        within = vocabulary.totals.sum(axis=1) + 1
        known = shares[last].sum()
        # what is left to unknown words: one part of each leaf
        unknown = 0.0
        one = {key: value for key, value in vocabulary.encode([history + b" unknown"]).items()}
        at = len(one["first"]) - 2
        width = vocabulary.shape.width
        for leaf in range(vocabulary.shape.leaves):
            for key, value in (("first", 48 + leaf // width**2), ("second", leaf // width % width), ("third", leaf % width)):
                one[key][at] = value
            unknown += 10 ** model.log10(one)[at] / within[leaf]
        assert len(leaves) and known + unknown == pytest.approx(1, abs=1e-4)


def test_language_model_scores_by_hand():
    """Logits summed feature by feature, weight by weight, in plain Python."""
    vocabulary, model, words, texts, data, _ = small_language_model()
    fast = model.log10(data)
    for at in range(0, len(fast), 97):
        total = 0.0
        for choice, inner, node, taken, features in model.parts(data, slice(at, at + 1)):
            for i in range(len(inner)):
                logits = [float(choice.bias[node[i], c]) + sum(float(choice.rows[f[i], c]) for f in features) for c in range(choice.bias.shape[1])]
                top = max(logits)
                total += math.log10(math.exp(logits[taken[i]] - top) / sum(math.exp(each - top) for each in logits))
        assert fast[at] == pytest.approx(total, abs=1e-4)


def test_language_model_sums_rows_in_runs_and_multiplies_factors():
    """Sums of rows by brute force, rows that all tokens share too; logits too far apart for products; odd white space."""
    rng = np.random.default_rng(4)
    for rows in (rng.integers(0, 9, 3000), np.zeros(700, np.int64), rng.integers(0, 100_000, 500), np.zeros(0, np.int64)):
        sums, each = np.zeros((100_000, 24), np.float32), rng.random((len(rows), 24)).astype(np.float32)
        expected = sums.astype(np.float64)
        np.add.at(expected, rows, each)
        language_model._scatter(sums, rows, each)
        assert np.allclose(sums, expected, rtol=1e-4)
    for scale in (0.5, 40.0):
        choice = language_model.Choice(rng.random((3, 24)), 50)
        choice.move(rng.normal(0, scale, choice.rows.shape))
        node, features = rng.integers(0, 3, 4000), [rng.integers(0, 50, 4000) for _ in range(5)]
        odds, sums = choice.odds(node, features)
        logits = choice.bias[node] + sum(choice.rows[feature].astype(np.float64) for feature in features)
        plain = np.exp(logits - logits.max(axis=1, keepdims=True))
        assert np.allclose(odds / sums[:, None], plain / plain.sum(axis=1, keepdims=True), rtol=1e-2, atol=1e-4)
    vocabulary = small_language_model()[0]
    texts = [b"", b" \t\n", b" W1x0\x0b\x0cw2X1\r\n unseen ", "é\u00a0w1x0\u2028 w1x0 \x1c w2x1".encode()]
    found = vocabulary.encode(texts)
    every = [word for text in texts for word in language_model.tokens(text)]
    assert found["sizes"].tolist() == [len(language_model.tokens(text)) for text in texts]
    assert found["count"].tolist() == [vocabulary.counts[vocabulary.rank[word]] if word in vocabulary.rank else -1 for word in every]
    assert found["rare"] == [word for word in every if word not in vocabulary.rank]


def test_language_model_grows_and_packs():
    small, large = language_model.Shape(10**6, 10**5), language_model.Shape(10**9, 10**7)
    assert large.width > 2 * small.width and large.contexts > 2 * small.contexts
    sums = np.array([0.0, 0.01, 1, 1e6, 1e9])
    assert np.allclose(language_model.unpacked(language_model.packed(sums)), sums, rtol=1e-3, atol=3e-4)
    assert language_model.unpacked(language_model.packed(sums))[0] == 0


def test_mixing(docs, given):
    for frame in both(docs, given):
        found = rows(mixing.mix_counts(frame).join(frame.select("doc_id", "source").distinct(), "doc_id"))
        if not found:
            continue
        again = rows(mixing.mix_counts(frame).join(frame.select("doc_id", "source").distinct(), "doc_id"))
        assert sorted(found, key=str) == sorted(again, key=str)
        sources = {row[5]: (row[2], row[3]) for row in found}
        assert all(row[4] in (0, row[1], 2 * row[1], 3 * row[1]) for row in found)
        weights = dict(zip(sorted((s for s in sources if s is not None)), [1, 2, 3] * 20)) | ({None: [1, 2, 3][(len(sources) - 1) % 3]} if None in sources else {})
        target, open_, left = {}, dict(sources), sum(size for size, _ in sources.values())
        while open_:
            share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
            full = [s for s in open_ if share[s] > 3 * open_[s][0]]
            if not full:
                target |= share
                break
            for s in full:
                target[s] = 3 * open_.pop(s)[0]
                left -= target[s]
        if frame is given:  # the awkward rows repeat ids, so the join above loses none of these only
            assert all(sources[s][1] == pytest.approx(target[s]) for s in sources)
            for source in sources:
                own = [row for row in found if row[5] == source]
                assert abs(sum(row[4] for row in own) - sources[source][1]) <= max(row[1] for row in own)
            mixed = mixing.mix(frame)
            assert mixed.columns == frame.columns
            copies = Counter(row.doc_id for row in mixed.collect())
            assert all(copies[row[0]] * row[1] == row[4] for row in found)


def brute_components(plain):
    sets, parent = {}, {}
    for at, text in enumerate(plain):
        words = (text or "").encode().lower().split()
        sets[at] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        parent[at] = at

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(len(sets[at]), root(at)) for at in sets]


def test_near_duplicates(spark, docs, given, texts):
    for frame in (given, docs.where("doc_id IS NOT NULL").distinct()):
        plain = in_order(frame)
        expected = [(row.doc_id, size, plain[least].doc_id) for row, (size, least) in zip(plain, brute_components([row.text for row in plain]))]
        assert sorted(rows(jaccard_join.near_duplicates(frame))) == expected
        kept = sorted(row.doc_id for row in jaccard_join.keep_one(frame).collect())
        assert kept == [doc_id for doc_id, _, least in expected if doc_id == least]
    found = jaccard_join.near_duplicates(docs).collect()
    assert {row.component_id for row in found if row.doc_id in (4, 5, None)} == {4} and len(found) == docs.count()
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_that_share_an_id_apart(spark):
    a, b, c, d = (" ".join(f"{name}{at}" for at in range(40)) for name in "abcd")
    table = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, c), (4, c), (4, c + " end"), (5, ""), (5, ""), (5, " "), (5, a)]
    table += [(None, a), (None, d), (None, d + " end"), (None, None), (None, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(table, "doc_id long, text string")).collect()
    kept = Counter((row.doc_id, (row.text or "").removesuffix(" end")) for row in kept)
    assert kept == {(1, a): 1, (2, b): 1, (4, c): 1, (5, ""): 1, (5, " "): 1, (None, d): 1, (None, ""): 2}


def test_near_duplicates_with_a_large_group(spark):
    base = [f"w{at}" for at in range(60)]
    variants = [" ".join(word if (at * 7 + other) % 97 else "z" for other, word in enumerate(base)) for at in range(90)]
    others = [" ".join([*base[:20], *(f"d{at}x{i}" for i in range(30))]) for at in range(30)]
    frame = spark.createDataFrame(list(enumerate(variants + others)), "doc_id long, text string")
    expected = [(at, size, least) for at, (size, least) in enumerate(brute_components(variants + others))]
    assert sorted(rows(jaccard_join.near_duplicates(frame))) == expected


def test_components(spark):
    path = [(at, at + 1) for at in range(200)]
    found = components.components(spark.createDataFrame([*path, (900, 901), (901, 905), (7, 7)], "a long, b long"))
    assert dict(rows(found)) == {**{at: 0 for at in range(201)}, 900: 900, 901: 900, 905: 900}


def brute_rules(text):
    words = (text or "").split() if (text or "").isascii() else [w.decode() for w in (text or "").encode().split()]
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {at + i for at in range(len(words) - 2) for i in range(3) if windows[tuple(words[at : at + 3])] > 1}
    symbols = sum(letter in "#*$%&|<>" for letter in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, given, labels):
    for frame in both(docs, given):
        found = quality_rules.quality_verdicts(frame, quality_rules.trusted_ids(labels))
        assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
        expected = []
        for row in in_order(frame):
            counts = brute_rules(row.text)
            expected.append((row.doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
        assert sorted((row[:7] for row in rows(found)), key=str) == sorted(expected, key=str)
        for row in found.collect():
            assert row.kept == (not row.base_failed and row.ratio >= quality_rules.THRESHOLD)
        kept = quality_rules.keep_good(frame, quality_rules.trusted_ids(labels))
        assert kept.columns == frame.columns and kept.count() == found.where("kept").count()


def test_rules_ratio_is_that_of_counts(spark, given, labels):
    grams = lambda text: text.encode().split()
    ratios = quality_rules.bucket_ratios(given, labels.select("doc_id"), 64).first()[0]
    hashed = lambda frame: Counter(row.b for row in frame.select(F.explode(quality_rules.buckets(quality_rules.words(F.col("text")), 64)).alias("b")).collect())
    raw, target = hashed(given), hashed(given.where("doc_id IN (4, 5, 8, 10)"))
    raws, targets = sum(raw.values()), sum(target.values())
    assert raws == sum(max(0, 2 * len(grams(row.text)) - 1) for row in given.collect())
    for bucket in range(64):
        share = (raw[bucket] + 1) / (raws + 64)
        assert ratios[bucket] == pytest.approx(math.log((target[bucket] + quality_rules.SMOOTHING * share) / (targets + quality_rules.SMOOTHING) / share))


def test_each_ratio_is_the_mean_over_its_grams(spark, given, labels):
    trusted = quality_rules.trusted_ids(labels)
    ratios = quality_rules.bucket_ratios(given, trusted).first()[0]
    own = {row[0]: row[1] for row in given.select("doc_id", quality_rules.buckets(quality_rules.words(F.col("text")))).collect()}
    for row in quality_rules.quality_verdicts(given, trusted).collect():
        expected = sum(ratios[bucket] for bucket in own[row.doc_id]) / len(own[row.doc_id])
        assert row.ratio == pytest.approx(expected) and len(own[row.doc_id]) == 2 * row.n_words - 1
        assert row.kept == (not row.base_failed and row.ratio >= quality_rules.THRESHOLD)


def slow_threads(messages):
    """Quadratic search for each quoted passage, then threads by following parents."""
    parsed = {at: (sent, *quotation_links.parse(text)) for at, sent, text in messages}
    parent, counts = {}, {}
    for at, (sent, _, passages) in parsed.items():
        found = []
        quoted = {(level, words) for level, words in passages if level > 0}
        for level, words in quoted:
            sources = [(other_sent, other) for other, (other_sent, _, own) in parsed.items() if other_sent < sent and (0, words) in own]
            if sources:
                found.append((level, -len(words), max(sources)[1]))
        counts[at] = len(quoted), len(found)
        parent[at] = min(found)[2] if found else None
    root = {}
    for at in sorted(parsed, key=lambda at: parsed[at][0]):
        root[at] = root[parent[at]] if parent[at] is not None else at
    members = {}
    for at, top in root.items():
        members.setdefault(top, []).append(at)
    out = {}
    for group in members.values():
        for place, at in enumerate(sorted(group, key=lambda at: (parsed[at][0], at)), 1):
            out[at] = min(group), place, parent[at], *counts[at], parsed[at][1]
    return out


def test_quotes_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [f"passage {at} with words" + " more" * (at % 5) for at in range(25)]
    messages = []
    for at in range(220):
        lines = []
        for level in rng.integers(0, 4, rng.integers(1, 5)):
            lines += ["> " * int(level) + pool[rng.integers(0, 25)].upper(), "> " * int(level)]
        messages.append((int(at * 7 % 223), at, "\n".join(lines)))
    frame = spark.createDataFrame(messages, "msg_id long, sent long, text string")
    found = {row.msg_id: (row.thread_id, row.position, row.parent_id, row.n_quotes, row.n_linked, row.text) for row in quotation_links.reply_ordered(frame).collect()}
    assert found == slow_threads(messages) and sum(row[2] is not None for row in found.values()) > 50


def test_quotes(spark):
    parsed = quotation_links.parse("Hi\n\nOn Monday, A wrote:\n> Second  line\n> > First\n>\n> more\nMy answer")
    assert parsed == ("Hi\n\nMy answer", [(0, "hi"), (1, "second line"), (2, "first"), (1, "more"), (0, "my answer")])
    messages = [
        (1, 1, "First thing\nof all"),
        (2, 2, "> first thing\n> of all\nSecond"),
        (3, 3, ">> First thing of all\n> Second\nThird"),
        (4, 4, "> nobody said this\nFourth"),
        (5, 5, "First thing of all"),
        (6, 6, "> First  thing of all\nSixth"),
        (7, 7, None),
        (None, 8, "> Second\nx"),
        (9, None, "> Second\ny"),
        (10, 10, ""),
    ]
    frame = spark.createDataFrame(messages, "msg_id long, sent long, text string")
    found = {row.msg_id: (row.thread_id, row.position, row.parent_id, row.n_quotes, row.n_linked, row.text) for row in quotation_links.reply_ordered(frame).collect()}
    assert found[3] == (1, 3, 2, 2, 2, "Third") and found[2] == (1, 2, 1, 1, 1, "Second") and found[4] == (4, 1, None, 1, 0, "Fourth")
    assert found[6] == (5, 2, 5, 1, 1, "Sixth") and found[7] == (7, 1, None, 0, 0, "") and found[None][1:3] == (1, None) and len(found) == 10
    assert quotation_links.reply_ordered(frame.limit(0)).count() == 0


def test_token_counts(docs, given):
    library = Tokenizer.from_file(BYTE)
    for frame in both(docs, given):
        found = token_counts.count_tokens(frame, BYTE, public_tokenizers.PATTERN)
        expected = []
        for row in in_order(frame):
            n = len(library.encode(row.text or "", add_special_tokens=False).ids)
            expected.append((row.doc_id, len((row.text or "").encode()), n, n > 1024))
        assert sorted(rows(found), key=str) == sorted(expected, key=str)


def slow_top_k(table, k=20):
    whole = [(at, [math.floor(64 * x) for x in vector]) for at, vector in table if at is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)]
    out = []
    for own, (query, vector) in enumerate(whole):
        if query % 20:
            continue
        bound = lambda score: min((1 << 63) - 1, max(-(1 << 63), score))
        scores = [(-bound(sum(a * b for a, b in zip(vector, other))), at) for i, (at, other) in enumerate(whole) if i != own and len(other) == len(vector)]
        out += [(query, rank, at, -score) for rank, (score, at) in enumerate(sorted(scores)[:k], 1)]
    return out


def whole_vectors(spark, table):
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    return frame.select("vec_id", topk_search.whole_numbers(F.col("embedding")).alias("vector"))


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (90, 8)).tolist()
    vectors[10] = vectors[11] = vectors[12] = vectors[20]
    table = list(enumerate(vectors)) + [(1000 + at, vectors[20]) for at in range(60)]
    table += [(100, None), (120, [float("nan")] * 8), (140, [None] * 8), (None, vectors[0]), (160, [1e30] * 8), (161, [3e5] * 8), (180, [-3e5, 1.0] * 4)]
    table += [(200, [0.5, 0.25]), (201, [1.0, 1.0]), (220, []), (221, []), (40, vectors[3]), (40, vectors[40]), (60, [0.0] * 8)]
    frame = whole_vectors(spark, table)
    assert sorted(rows(topk_search.top_k(frame, F.col("vec_id") % 20 == 0))) == sorted(slow_top_k(table))
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    for scale in (1, 50, 1e6, 1e30):
        vectors, queries = (np.floor(rng.normal(size=(n, 16)) * scale) for n in (300, 20))
        vectors[:, 3] = 7.0
        cells, low, width = topk_search.quantised(vectors)
        middles, far = topk_search.bounds(cells, low, width, queries)
        assert cells.dtype == np.uint8 and cells.nbytes * 8 == vectors.nbytes
        assert (np.abs(queries @ vectors.T - middles) <= far[:, None]).all()


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(9)
    table = [(at, vector) for at, vector in enumerate((rng.normal(0, 0.125, (3000, 32))).tolist())]
    read = []
    exact = topk_search._exact

    def counting(found, vectors, queries):
        read.append(found.count())
        return exact(found, vectors, queries)

    topk_search._exact = counting
    try:
        found = rows(topk_search.top_k(whole_vectors(spark, table), F.col("vec_id") % 20 == 0))
    finally:
        topk_search._exact = exact
    assert sorted(found) == sorted(slow_top_k(table))
    assert 150 * 20 <= sum(read) < 0.03 * 150 * 3000


def test_pieces(docs, given):
    library = SentencePieceProcessor(model_file=PIECE)
    for frame in both(docs, given):
        expected = [(row.doc_id, library.encode(row.text or "")) for row in in_order(frame)]
        for held in (sentencepiece_lattice.HELD_SEGMENTS, 20):
            found = [(row.doc_id, row.ids) for row in sentencepiece_lattice.encode(frame, PIECE, held).collect()]
            assert sorted(found, key=str) == sorted(expected, key=str)
    assert all(row.round_trip for row in sentencepiece_lattice.encode_digest(docs, PIECE).collect())


def test_classifier(spark, docs, given, labels):
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality_classifier.quality_scores(given, known).join(known, "doc_id").collect()
    right = [(row.predicted == 1) == (row.quality == 1) for row in found if row.held_out]
    assert sum(right) / len(right) >= 0.85
    for frame, these in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        scored = quality_classifier.quality_scores(frame, these).collect()
        assert len(scored) == frame.count() and all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in scored)
        assert quality_classifier.keep_good(frame, these).columns == frame.columns
    # nothing to learn from: nothing is known to be bad
    assert quality_classifier.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_stages_keep_columns_of_any_name(clashing, labels):
    whole = {tuple(row) for row in clashing.collect()}
    trusted = quality_rules.trusted_ids(labels)
    kept_by_rules = {row.doc_id for row in quality_rules.quality_verdicts(clashing, trusted).where("kept").collect()}
    plain = clashing.select("doc_id", "text", "source")
    copies = Counter(row.doc_id for row in mixing.mix(plain).collect())
    expected = {
        "rules": (quality_rules.keep_good(clashing, trusted), kept_by_rules),
        "classifier": (quality_classifier.keep_good(clashing, labels), {row.doc_id for row in quality_classifier.quality_scores(clashing, labels).where("predicted = 1").collect()}),
        "one": (jaccard_join.keep_one(clashing), {row.doc_id for row in jaccard_join.keep_one(plain).collect()}),
        "mix": (mixing.mix(clashing), set(copies)),
    }
    for frame, ids in expected.values():
        found = frame.collect()
        assert frame.columns == clashing.columns and {tuple(row) for row in found} <= whole and {row.doc_id for row in found} == ids
    assert Counter(row.doc_id for row in mixing.mix(clashing).collect()) == copies


def test_mixing_by_brute_force(spark):
    """Whole epochs, then documents in the order of their keys until the rest is used up; low weights keep their order."""
    table = [(at, ("a " * (1 + at % 9)) + "#" * (at % 3) * 20, f"s{at % 4}") for at in range(600)]
    frame = spark.createDataFrame(table, "doc_id long, text string, source string")
    key = mixing.sampling_key(F.col("doc_id"), F.col("text"), mixing.document_weight(F.col("text")), 7)
    keys = {row[0]: row[1] for row in frame.select("doc_id", key).collect()}
    assert len(set(keys.values())) == len(keys) and min(keys.values()) > 0
    found = {row.doc_id: row for row in mixing.mix_counts(frame).collect()}
    for source in range(4):
        own = sorted((at for at in found if at % 4 == source), key=keys.get)
        size, target = found[own[0]].source_size, found[own[0]].target
        epochs, rest, used, taken = int(target // size), target % size, 0, set()
        for at in own:
            if used + found[at].size / 2 > rest:
                break
            used += found[at].size
            taken.add(at)
        assert {at: found[at].taken for at in own} == {at: found[at].size * (epochs + (at in taken)) for at in own}


def test_sampling_keys_of_low_weight_differ(spark):
    rows = spark.range(50_000).select(mixing.sampling_key(F.col("id"), F.lit("x"), F.lit(0.2), 7).alias("key"))
    assert rows.distinct().count() == 50_000
    most = rows.groupBy(F.floor(F.log2("key") * mixing.SLICES)).count().agg(F.max("count")).first()[0]
    assert most < 100


def test_the_first_split_is_the_best_of_all(monkeypatch):
    monkeypatch.setattr(quality_classifier, "TREES", 1)
    rng = np.random.default_rng(12)
    for _ in range(5):
        x, y = rng.integers(0, 9, size=(120, 3)).astype(float), rng.integers(0, 2, 120).astype(float)
        y[x[:, 1] > 4] = 1
        trees = quality_classifier.boost(x, y)
        p = 1 / (1 + np.exp(-trees.base))
        slope, curve = p - y, np.full(len(y), p * (1 - p))
        best = []
        for feature in range(3):
            for limit in np.unique(x[:, feature])[:-1]:
                sides = [slope[mask].sum() ** 2 / (curve[mask].sum() + quality_classifier.RIDGE) for mask in (x[:, feature] <= limit, x[:, feature] > limit)]
                if min(curve[x[:, feature] <= limit].sum(), curve[x[:, feature] > limit].sum()) >= 1:
                    best.append((sum(sides), feature, limit))
        gain, feature, limit = max(best)
        assert trees.feature[0, 0] == feature
        mine = x[:, feature] <= trees.limit[0, 0]
        assert (mine == (x[:, feature] <= limit)).all()


def test_flat_trees_walk_like_nodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    trees = quality_classifier.boost(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float))
    total = np.full(len(x), trees.base)
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        for row in range(len(x)):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[row, feature[node]] > limit[node])
            total[row] += leaf[node - len(feature)]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-total)))


def test_pipeline_stages(spark, given):
    import corpus_pipeline

    docs, counts = given, [given.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == given.columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    final = corpus_pipeline.run(spark, SMALL)
    assert final.count() == counts[4] and final.where("NOT round_trip").isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_fold_where_merges_come_out_of_order(spark, seed):
    """Scores that no training gives: pieces come up after merges of lower or equal scores."""
    rng = random.Random(seed)
    every = ["".join(letters) for n in (2, 3, 4) for letters in itertools.product("abc", repeat=n)]
    scores = {piece: float(-rng.randrange(12)) for piece in rng.sample(every, 30)} | dict.fromkeys("abc", 0.0)
    ids = {piece: 300 + at for at, piece in enumerate(scores)}

    def by_hand(segment):
        symbols = list(segment)
        while ready := [(scores[a + b], -at) for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]:
            at = -max(ready)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return [each for symbol in symbols for each in ([ids[symbol]] if symbol in ids else symbol.encode())]

    assert any(sentencepiece_lattice.is_loose(piece, scores) for piece in scores if len(piece) > 1)
    segments = ["é", "a"] + ["".join(rng.choices("abcé", (9, 9, 9, 1), k=rng.randrange(1, 12))) for _ in range(300)]
    rows = [(piece, scores[piece], at, sentencepiece_lattice.is_loose(piece, scores)) for piece, at in ids.items() if len(piece) > 1]
    table = spark.createDataFrame(rows, "piece string, score double, id int, loose boolean")
    counts = spark.createDataFrame([(each, 1) for each in sorted(set(segments))], "segment string, n long").repartition("segment")
    edges = sentencepiece_lattice.lattice(counts, table, 4)
    assert edges.where(F.exists("edges", lambda edge: edge["end"] - edge["start"] < 2)).isEmpty()
    folded = sentencepiece_lattice.fold(F.col("segment"), F.col("edges"), 0, {letter: ids[letter] for letter in "abc"})
    assert {row.segment: row.ids for row in edges.select("segment", folded.alias("ids")).collect()} == {each: by_hand(each) for each in segments}


def test_signatures_beyond_a_bound_are_joined_not_sent(spark, monkeypatch):
    from textledger.llm import jaccard_join
    from textledger.sources.shared import stored_for_join

    rows = [(at, " ".join(f"w{at % 20 * 50 + n}" for n in range(40)) + (" more" if at % 3 else "")) for at in range(60)] + [(60, None), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = sorted(jaccard_join.near_duplicates(docs).collect(), key=repr)
    monkeypatch.setattr(jaccard_join, "SENT_BYTES", 1)
    assert sorted(jaccard_join.near_duplicates(docs).collect(), key=repr) == sent
    plan = lambda most: stored_for_join(docs, "bound", most)[0]._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in plan(1 << 20) and "Hint broadcast" not in plan(1)


def test_pieces_keep_nothing_of_a_batch_and_decode_chunks_not_texts(spark, texts, given, monkeypatch):
    """What a worker holds does not grow with the texts that it has encoded, and each different chunk is decoded once."""
    import pyarrow as pa

    library, table = SentencePieceProcessor(model_file=PIECE), sentencepiece_lattice.pieces(PIECE)
    every = [text or "" for text in texts] + ["  two ", " a", "b ", "▁", "▁▁c d", "x  y", "\x00 z", "z"] + [row.text or "" for row in in_order(given)]
    found, codes, sizes = sentencepiece_lattice.numbered_chunks(pa.array([None, *every]))
    own = np.array(found.to_pylist(), object)[codes].tolist()
    cut = np.cumsum(sizes).tolist()
    assert [own[a:b] for a, b in zip([0, *cut], cut)] == [sentencepiece_lattice.chunks(text) for text in ["", *every]]
    segments = sorted(set(table.split(found)[0].to_pylist()))
    keys = np.array([sentencepiece_lattice.xxhash.xxh3_64_intdigest(each.encode()) for each in segments], np.uint64)
    order = np.argsort(keys)
    ids = [table.fold(segments[at]) for at in order]
    held = sentencepiece_lattice.Held((keys[order], np.append(0, np.cumsum([len(each) for each in ids])), np.array(sum(ids, []), np.int32)), PIECE)
    size = lambda: sum(len(value) for value in vars(held).values() if hasattr(value, "__len__"))
    before = size()
    flat, counts, missing, whole = held.encode(pa.array(every), {})
    ends = np.cumsum(counts).tolist()
    assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == [library.encode(text) for text in every]
    assert size() == before and whole and not any(missing)
    held.letters = held.letters.copy()
    held.letters[:] = 0
    assert not held.encode(pa.array(every), {})[3]


def test_pieces_need_no_other_workers_and_give_memory_back(spark):
    """The table of pieces comes without Python workers of its own; ids fit 16 bits where they can; a task's free memory
    goes back."""
    from textledger.llm.common import giving_back

    table = sentencepiece_lattice.pieces(PIECE)
    frame = sentencepiece_lattice.piece_table(spark, table)
    assert "PythonRDD" not in frame.rdd._jrdd.rdd().toDebugString() and "ExistingRDD" not in frame._jdf.queryExecution().toString()
    found = {row.piece: (row.score, row.id, row.loose) for row in frame.collect()}
    assert found == {
        piece: (table.scores[piece], at, sentencepiece_lattice.is_loose(piece, table.scores)) for piece, at in table.ids.items() if len(piece) > 1
    }
    segments = spark.createDataFrame([("ab", [1, 40_000]), ("c", [65_535])], "segment string, ids array<int>")
    for pieces, kind in ((1 << 16, np.uint16), ((1 << 16) + 1, np.int32)):
        keys, ends, ids = sentencepiece_lattice._pack(segments, pieces)
        assert ids.dtype == kind and ends.dtype == np.int32 and sorted(ids.tolist()) == [1, 40_000, 65_535] and len(keys) == len(ends) - 1 == 2

    def work(batches):
        for batch in batches:
            yield pa.array(np.arange(batch))

    assert [len(each) for each in giving_back(work)(iter([3, 5]))] == [3, 5]


def test_ids_are_packed_in_little_of_the_drivers_memory(spark, docs, monkeypatch):
    """Ids come to the driver in 16 bits, are put in order in steps, and what was free after that goes back."""
    rng = np.random.default_rng(3)
    lengths, keys = rng.integers(0, 9, 200_000), rng.permutation(200_000) * 91 - 9_000_000
    rows = [rng.integers(0, 1 << 16, n).astype(np.uint16) for n in lengths]
    column = pa.array([each.tobytes() for each in rows], pa.binary())
    whole = pa.table({"key": pa.array(keys), "ids": column})
    table = pa.concat_tables([whole.slice(0, 70_001), whole.slice(5, 0), whole.slice(70_001)])
    tracemalloc.start()
    try:
        found, ends, ids = sentencepiece_lattice.by_key(table, np.dtype(np.uint16))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    order = np.argsort(keys.view(np.uint64))
    assert found.tolist() == keys.view(np.uint64)[order].tolist() and ids.dtype == np.uint16
    assert ends.tolist() == np.append(0, np.cumsum(lengths[order])).tolist() and ids.tolist() == np.concatenate([rows[at] for at in order]).tolist()
    assert peak < 2.5 * (found.nbytes + ends.nbytes + ids.nbytes)
    empty = sentencepiece_lattice.by_key(whole.schema.empty_table(), np.dtype(np.int32))
    assert [each.tolist() for each in empty] == [[], [0], []]

    sent, given = [], []
    monkeypatch.setattr(sentencepiece_lattice, "by_key", lambda table, small, by_key=sentencepiece_lattice.by_key: sent.append(table) or by_key(table, small))
    monkeypatch.setattr(sentencepiece_lattice, "give_back", lambda: given.append(len(sent)))
    segments = spark.createDataFrame([("ab", [1, 40_000]), ("c", [65_535])], "segment string, ids array<int>")
    sentencepiece_lattice._pack(segments, 1 << 16)
    assert sorted(map(len, sent[0]["ids"].to_pylist())) == [2, 4]
    sentencepiece_lattice.encode_digest(docs, PIECE)
    assert given == [2]


def test_language_model_adds_what_follows_a_word_in_one_piece():
    """Sums and odds of the first choice by windows are those by features, between texts and at the ends of parts too."""
    vocabulary, model, words, texts, data, _ = small_language_model()
    whole = model.zeros()
    model.gather(data, whole)
    assert whole.nbytes == 8 * whole.shape[1]  # no more than one float for each weight and sum
    plain = np.zeros(whole.shape)
    for at in (slice(0, 1), slice(1, len(data["first"]))):
        for (choice, _, node, taken, features), seen, view in zip(model.parts(data, at), model.by_choice(plain[0]), model.by_choice(plain[1])):
            odds, sums = choice.odds(node, features)
            for feature in features:
                np.add.at(seen, (feature, taken), 1)
                np.add.at(view, feature, odds / sums[:, None])
    assert np.array_equal(whole[0], plain[0]) and np.allclose(whole[1], plain[1], rtol=1e-3, atol=1e-4)
    language_model.GATHERED, kept = 7, language_model.GATHERED
    try:
        parts = model.zeros()
        model.gather(data, parts)
    finally:
        language_model.GATHERED = kept
    assert np.array_equal(parts[0], whole[0]) and np.allclose(parts[1], whole[1], rtol=1e-3, atol=1e-4)
    first = model.choices[0]
    first.move(np.random.default_rng(5).normal(0, 40, first.rows.shape))  # too far apart for products
    odds, sums = model.first_odds(*model.window(data, slice(None)))
    _, _, node, _, features = next(model.parts(data, slice(None)))
    logits = first.bias[node] + sum(first.rows[feature].astype(np.float64) for feature in features)
    shares = np.exp(logits - logits.max(axis=1, keepdims=True))
    place = data["places"] - data["places"][0]
    assert np.allclose((odds / sums[:, None])[place], shares / shares.sum(axis=1, keepdims=True), rtol=1e-2, atol=1e-4)


def test_language_model_passes_sums_on_before_they_grow_too_large(given, monkeypatch):
    """Floats of 32 bits take no more ones at 2**24, so a task gives out its sums before."""
    frame = given.limit(150)
    whole = language_model.score_texts(frame).agg(F.sum("score")).first()[0]
    assert language_model.SUMMED * 2 <= 1 << 24
    monkeypatch.setattr(language_model, "SUMMED", 1000)
    assert language_model.score_texts(frame).agg(F.sum("score")).first()[0] == pytest.approx(whole, rel=1e-3)
