"""Hashed maximum-entropy language model with a class-factored softmax over all words, trained by distributed gradient
updates.

A word is found on a way of at most three choices: the most frequent words are choices of their own, others lie in classes
by their endings (reversed spelling, cut into parts of equal count), within them in nodes, and within these in leaves. Each
choice is a softmax whose logits are sums of hashed rows of weights of n-gram and skip features. How many classes, leaves
and rows there are follows from the counted words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger.llm.common import HEAD_WORDS, counted, fold, giving_back, head_count, slices, utf8
from textledger.sources.shared import stored

SINGLE, MIDDLE, TAIL = 32, 16, 16  # first choices: frequent words, classes of words of middle counts, classes of all others
FIRST = SINGLE + MIDDLE + TAIL
CONTEXTS = 1024  # feature rows for words before, times the growth; a quarter is shared by words that have none of their own
MOST_WEIGHTS = 16_000_000  # rows stop growing here (64 MB); words, classes and leaves do not
ROUNDS, RATE, PRIOR = 3, 0.5, 2.0
BEFORE, SLOTS = 4, 3  # words before a token that its first choice looks at, and a word's rows for it: the last two share one
CHUNK = 4096  # tokens scored at a time
BLOCK = 1024  # tokens whose logits are summed at a time, so that they stay in a core's cache
SUMMED = 1 << 23  # tokens whose gradients a task adds up before it passes them on
GATHERED = 150_000  # tokens whose gradients are added up at a time
PIECES = 64  # into which a task's gradient is cut
STEPS = 2048.0  # of the logarithm of a sum that is passed on

END = b"\n"  # no word can hold it


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then one end."""
    found = text.lower().split()
    found.append(END)
    return found


def ending_keys(words: list[bytes]) -> np.ndarray:
    """The last eight bytes of each word, last byte first, as numbers."""
    return np.frombuffer(b"".join([word[:-9:-1].ljust(8, b"\0") for word in words]), ">u8").astype(np.uint64)


class Shape:
    """Sizes of the model by the training tokens and their different words, and where endings are cut into leaves."""

    def __init__(self, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.width = 8 * max(1, round(distinct ** (1 / 3) / 16))
        growth = max(1.0, (tokens / 2**18) ** (1 / 3) / 1.5)
        each = (5 * FIRST + 6 * self.width + 2 * self.width) * CONTEXTS
        self.contexts = int(CONTEXTS * min(growth, max(1.0, MOST_WEIGHTS / each)))
        self.plain = self.contexts * 3 // 4
        self.middle = MIDDLE * self.width
        self.leaves = TAIL * self.width**2

    def cuts(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Ends of all leaves but the last, so that words (by falling count) beyond those of middle counts are even."""
        keys, n = ending_keys(words[SINGLE + self.middle :]), counts[SINGLE + self.middle :]
        if not len(keys):
            return np.full(self.leaves - 1, np.iinfo(np.uint64).max, np.uint64)
        order = np.argsort(keys, kind="stable")
        sums = np.cumsum(n[order])
        at = np.searchsorted(sums, sums[-1] * np.arange(1, self.leaves) / self.leaves)
        return keys[order][at]


class Vocabulary:
    """Frequent words (by falling count) and their ways; `totals`: (tokens, words) of each leaf."""

    def __init__(self, words: list[bytes], counts: np.ndarray, shape: Shape, cuts: np.ndarray, totals: np.ndarray):
        self.rank = {word: at for at, word in enumerate(words)}
        self.counts, self.shape, self.cuts, self.totals = counts, shape, cuts, totals
        keys = ending_keys(words)
        self.leaf = self.leaves(keys)
        self.leaf[: SINGLE + shape.middle] = -1
        self.first, self.second = SINGLE + MIDDLE + self.leaf // shape.width**2, self.leaf // shape.width % shape.width
        self.third = self.leaf % shape.width
        self.third[self.leaf < 0] = -1
        self.first[:SINGLE] = np.arange(len(words))[:SINGLE]
        self.second[:SINGLE] = -1
        middle = SINGLE + np.argsort(keys[SINGLE : SINGLE + shape.middle], kind="stable")
        at = np.arange(len(middle))
        self.first[middle], self.second[middle] = SINGLE + at // shape.width, at % shape.width
        rank = np.arange(len(words))
        self.context = np.where(rank < shape.plain, rank, self.shared_context(self.leaf))

    def leaves(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, keys).astype(np.int64)

    def shared_context(self, leaf: np.ndarray) -> np.ndarray:
        """The row of words of a node that have none of their own; the last one stands for what is before a text."""
        return self.shape.plain + leaf // self.shape.width * 2654435761 % (self.shape.contexts - 1 - self.shape.plain)

    def encode(self, texts: list[bytes]) -> dict[str, np.ndarray | list]:
        """Tokens of all texts in a row: way, leaf (-1: none), count (-1: not among the frequent), places among the contexts of
        all texts, where `BEFORE` more stand before each text (`padded`)."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
        coded = pa.concat_arrays([lists.flatten().cast(pa.binary()), pa.array([END, b""], pa.binary())]).dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        lengths = pc.list_value_length(lists).to_numpy()
        codes, end, blank = codes[:-2], codes[-2], codes[-1]
        of = np.repeat(np.arange(len(texts)), lengths)[codes != blank]  # white space around a text gives empty words
        sizes = np.bincount(of, minlength=len(texts)) + 1
        starts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        token = np.full(total, end, codes.dtype)
        token[np.arange(len(of)) + of] = codes[codes != blank]
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))
        rank = ranks[token]
        rare_at = np.flatnonzero(rank < 0)
        of = np.searchsorted(starts, rare_at, side="right") - 1
        rare = words[token[rare_at]].tolist()
        leaf = self.leaves(ending_keys(rare))
        width = self.shape.width

        def each(known: np.ndarray, others: np.ndarray) -> np.ndarray:
            out = known[rank] if len(known) else np.zeros(total, np.int64)
            out[rare_at] = others
            return out

        first = each(self.first, SINGLE + MIDDLE + leaf // width**2)
        context = each(self.context, self.shared_context(leaf))
        place = np.arange(total) - np.repeat(starts, sizes)

        def before(values: np.ndarray, back: int, start: int) -> np.ndarray:
            out = np.full(total, start, np.int64)
            out[back:] = values[: max(0, total - back)]
            out[place < back] = start
            return out

        places = np.arange(total) + np.repeat(np.arange(1, len(texts) + 1) * BEFORE, sizes)
        padded = np.full(total + len(texts) * BEFORE, self.shape.contexts - 1)
        padded[places] = context

        return {
            "sizes": sizes,
            "starts": starts,
            "first": first,
            "second": each(self.second, leaf // width % width),
            "third": each(self.third, leaf % width),
            "leaf": each(self.leaf, leaf),
            "count": each(self.counts, -1),
            "places": places,
            "padded": padded,
            "coarse": [before(first, back, FIRST) for back in (1, 2)],
            "rare": rare,
            "rare_of": of,
        }


def _hashed(left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    return (left * 1_000_003 + right + 1) * 2654435761 % 4294967291 % rows


class Choice:
    """One softmax: a bias from counts for each node and choice, and hashed rows of weights for features."""

    def __init__(self, sums: np.ndarray, rows: int):
        with np.errstate(divide="ignore"):
            self.bias = np.where(sums > 0, np.log(sums), -1e4).astype(np.float32)
        self.rows = np.zeros((rows, sums.shape[1]), np.float32)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "rows": self.rows}

    @cached_property
    def factors(self) -> list[np.ndarray]:
        """exp of biases, over that of the largest, and of weights."""
        with np.errstate(over="ignore"):
            return [np.exp(self.bias - self.bias.max()), np.exp(self.rows)]

    def move(self, change: np.ndarray) -> None:
        self.rows += change.astype(np.float32)
        self.__dict__.pop("factors", None)

    def odds(self, node: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, up to a factor of each row, and the sums of rows; shares of the sums are the probabilities."""
        bias, rows = self.factors
        out, sums = np.empty((len(node), rows.shape[1]), np.float32), np.empty(len(node), np.float32)
        more, ones = np.empty((min(len(node), BLOCK), rows.shape[1]), np.float32), np.ones(rows.shape[1], np.float32)
        for begin in range(0, len(node), BLOCK):
            at = slice(begin, begin + BLOCK)
            odds = np.take(bias, node[at], axis=0, out=out[at], mode="clip")
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                for feature in features:
                    odds *= np.take(rows, feature[at], axis=0, out=more[: len(odds)], mode="clip")
                total = np.matmul(odds, ones, out=sums[at])
            if not (total.min() > 1e-25 and total.max() < 1e35):  # too far apart for products
                odds[:] = _odds(self.bias[node[at]] + sum(self.rows[feature[at]] for feature in features))
                sums[at] = odds.sum(axis=1)
        return out, sums


class Model:
    """Three choices in turn; `parts` gives the tokens of a chunk that take part in each, their nodes and features."""

    def __init__(self, words: Vocabulary):
        shape, width = words.shape, words.shape.width
        self.shape = shape
        first, second = np.zeros(FIRST), np.zeros((MIDDLE + TAIL, width))
        third = words.totals[:, 0].reshape(TAIL * width, width) + 1.0
        second[MIDDLE:] = third.sum(axis=1).reshape(TAIL, width)
        middle = np.arange(SINGLE, min(SINGLE + shape.middle, len(words.counts)))
        second[words.first[middle] - SINGLE, words.second[middle]] = words.counts[middle]
        first[: min(SINGLE, len(words.counts))] = words.counts[:SINGLE]
        first[SINGLE:] = second.sum(axis=1)
        rows = shape.contexts
        self.choices = [Choice(first[None, :], 5 * rows), Choice(second, 6 * rows), Choice(third, 2 * rows)]

    def parts(self, data: dict, at: slice) -> Iterator[tuple[Choice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        rows, first = self.shape.contexts, data["first"][at]
        contexts = [data["padded"][data["places"][at] - back] for back in range(1, BEFORE + 1)]
        features = [SLOTS * context + min(turn, SLOTS - 1) for turn, context in enumerate(contexts)]
        features.append(SLOTS * rows + _hashed(*contexts[:2], 2 * rows))
        yield self.choices[0], np.arange(len(first)), np.zeros_like(first), first, features
        yield from self.later_parts(data, at)

    def later_parts(self, data: dict, at: slice) -> Iterator[tuple[Choice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        rows, width = self.shape.contexts, self.shape.width
        first, second, third = data["first"][at], data["second"][at], data["third"][at]
        inner = np.flatnonzero(second >= 0)
        node, own = first[inner] - SINGLE, data["places"][at][inner]
        features = [2 * rows * turn + _hashed(node, data["padded"][own - 1 - turn], 2 * rows) for turn in range(3)]
        yield self.choices[1], inner, node, second[inner], features
        inner = np.flatnonzero(third >= 0)
        node = (first[inner] - SINGLE - MIDDLE) * width + second[inner]
        features = [rows * turn + _hashed(node, coarse[at][inner], rows) for turn, coarse in enumerate(data["coarse"])]
        yield self.choices[2], inner, node, third[inner], features

    def log10(self, data: dict) -> np.ndarray:
        """Of each token, without the share of a word within its leaf."""
        out = np.zeros(len(data["first"]))
        for begin in range(0, len(out), CHUNK):
            at = slice(begin, begin + CHUNK)
            odds, sums = self.first_odds(*self.window(data, at))
            place = data["places"][at] - data["places"][begin]
            own = odds[place, data["first"][at]].astype(np.float64)
            out[at] = np.log10(np.maximum(own / sums[place], 1e-30))
            for choice, inner, node, taken, features in self.later_parts(data, at):
                odds, sums = choice.odds(node, features)
                own = odds[np.arange(len(odds)), taken].astype(np.float64)
                out[at][inner] += np.log10(np.maximum(own / sums, 1e-30))
        return out

    def window(self, data: dict, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """The contexts before and at the places of a chunk, from `BEFORE` places before the first one, and the rows of pairs."""
        places = data["places"][at]
        contexts = data["padded"][places[0] - BEFORE : places[-1] + 1]
        return contexts, SLOTS * self.shape.contexts + _hashed(contexts[3:-1], contexts[2:-2], 2 * self.shape.contexts)

    def first_odds(self, contexts: np.ndarray, pair: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What `Choice.odds` gives for the first choice at every place of a window, those between texts too: a word's rows
        lie side by side, so they are looked up once for all places after it."""
        choice, rows = self.choices[0], SLOTS * self.shape.contexts
        bias, weights = choice.factors
        words = weights[:rows].reshape(-1, SLOTS * FIRST)
        out = np.empty((len(pair), FIRST), np.float32) if out is None else out
        sums, ones = np.empty(len(pair), np.float32), np.ones(FIRST, np.float32)
        found = np.empty((min(len(pair), BLOCK) + BEFORE - 1, SLOTS * FIRST), np.float32)
        for begin in range(0, len(pair), BLOCK):
            at = slice(begin, begin + BLOCK)
            odds = np.take(weights, pair[at], axis=0, out=out[at], mode="clip")
            n = len(odds)
            each = np.take(words, contexts[begin : begin + n + BEFORE - 1], axis=0, out=found[: n + BEFORE - 1], mode="clip")
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                odds *= bias[0]
                for turn in range(BEFORE):
                    slot, back = min(turn, SLOTS - 1), BEFORE - 1 - turn
                    odds *= each[back : back + n, slot * FIRST : (slot + 1) * FIRST]
                total = np.matmul(odds, ones, out=sums[at])
            if not (total.min() > 1e-25 and total.max() < 1e35):  # too far apart for products
                logits = choice.bias[0] + choice.rows[pair[at]]
                for turn in range(BEFORE):
                    back = begin + BEFORE - 1 - turn
                    logits += choice.rows[SLOTS * contexts[back : back + n] + min(turn, SLOTS - 1)]
                odds[:] = _odds(logits)
                sums[at] = odds.sum(axis=1)
        return out, sums

    def zeros(self) -> np.ndarray:
        """Two sums for each weight, observed and expected, of at most `SUMMED` tokens: beyond, adding 1 would be lost."""
        return np.zeros((2, sum(choice.rows.size for choice in self.choices)), np.float32)

    def by_choice(self, flat: np.ndarray) -> list[np.ndarray]:
        """Of an array whose last axis runs over all weights: views in the shapes of the rows."""
        ends = np.cumsum([choice.rows.size for choice in self.choices])
        parts = np.split(flat, ends[:-1], axis=-1)
        return [part.reshape(*flat.shape[:-1], *choice.rows.shape) for part, choice in zip(parts, self.choices)]

    def gather(self, data: dict, sums: np.ndarray) -> None:
        """Add the observed and expected counts of a batch; the gradient of its log-likelihood is their difference."""
        observed, expected = self.by_choice(sums[0]), self.by_choice(sums[1])
        words = np.zeros((self.shape.contexts, BEFORE * FIRST), np.float32)
        total = len(data["first"])
        step = -(-total // max(1, -(-total // GATHERED)))  # parts of even size
        for begin in range(0, total, max(1, step)):
            at = slice(begin, begin + step)
            self.gather_first(data, at, observed[0], words, expected[0])
            for (choice, _, node, taken, features), seen, view in zip(self.later_parts(data, at), observed[1:], expected[1:]):
                shares, sums_of = choice.odds(node, features)
                shares /= sums_of[:, None]
                for feature in features:
                    np.add.at(seen.reshape(-1), feature * seen.shape[1] + taken, np.float32(1))
                    _scatter(view, feature, shares)
        own = expected[0][: SLOTS * self.shape.contexts].reshape(self.shape.contexts, SLOTS * FIRST)
        own += words[:, : SLOTS * FIRST]
        own[:, -FIRST:] += words[:, SLOTS * FIRST :]

    def gather_first(self, data: dict, at: slice, seen: np.ndarray, words: np.ndarray, view: np.ndarray) -> None:
        """`gather` for the first choice: what the places after a word expect lies side by side and is added in one piece."""
        contexts, pair = self.window(data, at)
        shares = np.zeros((len(contexts) + BEFORE, FIRST), np.float32)
        own = shares[BEFORE:-BEFORE]
        _, sums_of = self.first_odds(contexts, pair, own)
        places, taken = data["places"][at], data["first"][at]
        inside = np.zeros(len(pair), np.float32)
        inside[places - places[0]] = 1
        own *= (inside / sums_of)[:, None]  # nothing is expected between texts
        after = np.ndarray(len(contexts), (np.void, BEFORE * FIRST * 4), shares, FIRST * 4, (FIRST * 4,))
        _scatter(words, contexts, after)
        _scatter(view, pair, own)
        for turn in range(BEFORE):
            row = SLOTS * data["padded"][places - 1 - turn] + min(turn, SLOTS - 1)
            np.add.at(seen.reshape(-1), row * FIRST + taken, np.float32(1))
        np.add.at(seen.reshape(-1), pair[places - places[0]] * FIRST + taken, np.float32(1))

    def step(self, sums: np.ndarray, rate: float) -> None:
        """Move each weight along its gradient, by the logarithm of observed over expected counts."""
        change = rate * np.log((sums[0] + PRIOR) / (sums[1] + PRIOR))
        for choice, part in zip(self.choices, self.by_choice(change)):
            choice.move(part)


def _odds(logits: np.ndarray) -> np.ndarray:
    return np.exp(logits - logits.max(axis=1, keepdims=True))


def _scatter(sums: np.ndarray, rows: np.ndarray, expected: np.ndarray) -> None:
    """Add each row of `expected`, which may be one item of bytes, to its row of sums; those of one row are summed first, in
    runs of powers of two."""
    near = rows - rows.min() if len(rows) else rows
    order = np.argsort(near.astype(np.uint16) if near.max(initial=0) < 65536 else near, kind="stable")
    ordered = rows[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(rows)])
    sizes, own = np.diff(begin, append=len(order)), ordered[begin]
    whole = np.dtype((np.void, sums.itemsize * sums.shape[1]))  # rows are copied as one item
    places = sums.view(whole)[:, 0]
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        every = np.flatnonzero(sizes >> bit & 1)
        step = max(1, BLOCK >> bit)  # so that they stay in a core's cache
        for run in (every[first : first + step] for first in range(0, len(every), step)):
            at = order[np.arange(1 << bit)[:, None] + begin[run]].ravel()
            each = np.take(expected, at, axis=0) if expected.ndim > 1 else expected[at].view(sums.dtype).reshape(len(at), sums.shape[1])
            total = np.take(sums, own[run], axis=0)
            total += each.reshape(1 << bit, -1).sum(axis=0).reshape(total.shape) if bit else each
            places[own[run]] = total.view(whole)[:, 0]
        begin[every] += 1 << bit


def packed(sums: np.ndarray) -> bytes:
    """Sums from 0 to a billion as 16-bit steps of their logarithm, within a four-thousandth."""
    return np.minimum(np.rint(np.log1p(sums) * STEPS), 65535).astype(np.uint16).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.expm1(np.frombuffer(data, np.uint16) / STEPS)


_LAST: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The broadcast vocabulary, unpacked once for each worker."""
    name, words, *rest = shared.value
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Vocabulary(words.to_pylist(), *rest)
    return _LAST[name]


def packed_vocabulary(counts: DataFrame) -> tuple:
    """What every task needs of the word counts (stored: word, n): at most `HEAD_WORDS` words, the cuts of endings, and sums
    over all words by leaf (tasks add them up)."""
    number, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shape = Shape(number, distinct)
    head = counts.where(F.col("n") >= head_count(counts, HEAD_WORDS)).toArrow()
    words, n = head["word"].combine_chunks(), head["n"].to_numpy().astype(np.int64)
    order = np.lexsort((np.argsort(np.argsort(np.array(words.to_pylist(), object), kind="stable")), -n)) if len(n) else np.zeros(0, np.int64)
    words, n = words.take(pa.array(order)), n[order]
    cuts = shape.cuts(words.to_pylist(), n)

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, shape.leaves), np.int64)
        for batch in batches:
            leaf = np.searchsorted(cuts, ending_keys(batch.column("word").to_pylist()))
            np.add.at(sums[0], leaf, batch.column("n").to_numpy())
            np.add.at(sums[1], leaf, 1)
        used = np.flatnonzero(sums[1])
        yield pa.record_batch([pa.array(used), *map(pa.array, sums[:, used])], ["leaf", "n", "words"])

    totals = np.zeros((shape.leaves, 2))
    rows = counts.mapInArrow(by_leaf, "leaf long, n long, words long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    found = rows.toArrow()
    totals[found["leaf"].to_numpy()] = np.stack([found["n"].to_numpy(), found["words"].to_numpy()], axis=1)
    known = SINGLE + shape.middle
    leaf = np.searchsorted(cuts, ending_keys(words[:known].to_pylist()))
    np.subtract.at(totals, leaf, np.stack([n[:known], np.ones(len(leaf))], axis=1))
    return words, n, shape, cuts, totals


def train(docs: DataFrame, shared, model: Model, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Gradient updates over all of `docs` (doc_id, text), in `rounds` parts: each document bears on one update, and later
    updates are smaller steps.

    Tasks add the gradients of their rows up and pass on one row per piece; pieces are summed apart. The driver gets
    and sends out the weights, at most `MOST_WEIGHTS` and some for leaves."""
    spark = docs.sparkSession
    few = max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 16)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds))
    for at in range(rounds):
        current = spark.sparkContext.broadcast(model)

        def gradients(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            model, vocabulary = current.value, _vocabulary(shared)
            sums, tokens = model.zeros(), 0

            def out() -> pa.RecordBatch:
                pieces = [packed(piece) for piece in np.array_split(sums, PIECES, axis=1)]
                return pa.record_batch([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "sums"])

            for batch in slices(batches):
                data = vocabulary.encode(utf8(batch.column("text")))
                if tokens and tokens + len(data["first"]) > SUMMED:
                    yield out()
                    sums[:], tokens = 0, 0
                model.gather(data, sums)
                tokens += len(data["first"])
            if tokens:
                yield out()

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(unpacked(each) for each in frame["sums"])
            return pd.DataFrame({"piece": [int(frame.piece.iloc[0])], "sums": [packed(total)]})

        rows = docs.where(part == at).select("text").coalesce(few).mapInArrow(giving_back(gradients), "piece int, sums binary")
        summed = rows.groupBy("piece").applyInPandas(add, "piece int, sums binary").collect()
        if summed:
            pieces = [unpacked(row["sums"]).reshape(2, -1) for row in sorted(summed, key=lambda row: row.piece)]
            model.step(np.concatenate(pieces, axis=1), rate / (1 + at))
    return model


def token_scores(model: Model, words: Vocabulary, data: dict) -> np.ndarray:
    """log10 of the model's share of each token; for words of no known count, of that share over their count plus 1."""
    token = model.log10(data)
    tail = np.flatnonzero(data["leaf"] >= 0)
    within = np.log10(words.totals.sum(axis=1) + 1)
    token[tail] += np.log10(np.maximum(data["count"][tail], 0) + 1.0) - within[data["leaf"][tail]]
    if not words.shape.tokens:
        token[:] = 0
    return token


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Counts come from all training documents. Their most frequent words (a bounded number) go to every task; other words
    of a text are joined with their counts. `base_score` is that of single words; `score` the model's: each token has its
    share of the choices on its way, by the four tokens before it, times its smoothed share of its leaf where it has one;
    the shares of all words and of unknown ones sum to 1. A NULL text is empty: its end is scored. A NULL doc_id counts as an
    empty one. Repeated rows are scored, and counted, each. Without training tokens both scores are 0."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    is_held = fold(F.col("doc_id"), folds) == held
    training = docs.where(~is_held)
    counts = stored(counted(training, tokens), "words")
    found = packed_vocabulary(counts)
    number = found[2].tokens
    least = int(found[1].min()) if len(found[1]) else 1 << 62
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *found))
    known = SINGLE + found[2].middle
    vocabulary = Vocabulary(found[0][:known].to_pylist(), found[1][:known], *found[2:])
    ready = spark.sparkContext.broadcast(train(training, shared, Model(vocabulary)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = ready.value, _vocabulary(shared)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            data = words.encode(utf8(batch.column("text")))
            seen = np.log10(np.maximum(data["count"], 0) + 1.0)
            token = token_scores(model, words, data)
            rare = [[] for _ in range(batch.num_rows)]
            for at, word in zip(data["rare_of"].tolist(), data["rare"]):
                rare[at].append(word)
            sums = [np.add.reduceat(values.astype(np.float64), data["starts"]) for values in (data["count"] > 0, seen, token)]
            base = sums[1] - data["sizes"] * np.log10(words.shape.tokens + words.shape.distinct + 1)
            yield pa.record_batch(
                [
                    pa.array(np.arange(row, row + batch.num_rows)),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    *map(pa.array, (data["sizes"], sums[0].astype(np.int64), base, sums[2])),
                    pa.array(rare, pa.list_(pa.binary())),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )
            row += batch.num_rows

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    rows = stored(docs.withColumn("held_out", is_held).mapInArrow(giving_back(scores), schema), "scores")
    rare = rows.select("row", F.explode("rare").alias("word"))
    rare = rare.join(counts.where(F.col("n") < least), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    rows = rows.drop("rare").join(rare, "row", "left")
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(number).cast("long").alias("train_tokens"),
        (F.col("base_score") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )
