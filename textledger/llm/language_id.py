"""Language ID with hyperdimensional profiles: documents and languages as bundles of bound letter vectors."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textledger.llm.common import fold, ragged, slices
from textledger.sources.shared import stored

DIMENSIONS = 1024
LETTERS = 3  # bound into one vector

#: Vectors of n-grams that a worker keeps, a byte for each dimension.
KEPT_GRAMS = 40_000

#: N-grams whose vectors are unpacked at a time.
GRAMS = 8192

#: Languages whose prototypes go to every task at a time; more are compared in turns.
BLOCK_LANGUAGES = 4096

#: Languages whose sums a task holds before it passes them on.
HELD_LANGUAGES = 256

UNDETERMINED = "und"
_GAP = 0x20  # between letters that do not touch
_FEW = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            lower = letter.lower()
            table[point] = ord(lower) if len(lower) == 1 and lower.isalpha() else point
    return table


@lru_cache(maxsize=8192)
def letter_vector(point: int) -> np.ndarray:
    """The random vector of a letter, of 1 and -1; the same one in every process."""
    bits = np.random.Generator(np.random.Philox(key=point)).integers(0, 2, DIMENSIONS, np.int8)
    return (2 * bits - 1).astype(np.int8)


def gram_vector(points: tuple[int, ...]) -> np.ndarray:
    """The product of the letters' vectors, each rotated by its distance from the last letter."""
    out = np.ones(DIMENSIONS, np.int8)
    for at, point in enumerate(points):
        out *= np.roll(letter_vector(point), len(points) - 1 - at)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of the texts as numbers, and for each n-gram of the texts in a row which one it is; where
    each text's n-grams end. Letters are folded to lower case, all between two words is one gap, and so are both ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    # a gap before each text, and one after the last
    line = np.insert(_letters()[points], starts, 0)
    line = np.append(line, np.uint32(0))
    begins = starts + np.arange(len(texts))
    keep = np.append(True, (line[1:] > 0) | (line[:-1] > 0))
    keep[begins] = True
    at = np.cumsum(keep) - 1
    line, begins = line[keep], np.append(at[begins], np.int64(keep.sum() - 1))
    # a gap that ends a text is the one before the next text
    keep = np.ones(len(line), bool)
    keep[begins[1:] - 1] = line[begins[1:] - 1] > 0
    keep[begins] = True
    line, begins = line[keep], (np.cumsum(keep) - 1)[begins]
    line = np.where(line > 0, line, _GAP).astype(np.int64)
    letters = np.unique(line) if len(line) < _FEW else np.flatnonzero(np.bincount(line))
    rank = np.zeros(int(letters[-1]) + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    places = rank[line]
    keys = np.zeros(max(0, len(line) - LETTERS + 1), np.int64)
    for offset in range(LETTERS):
        keys = keys * len(letters) + places[offset : offset + len(keys)]
    if len(letters) ** LETTERS > _FEW * 64:
        found, which = np.unique(keys, return_inverse=True)
    else:  # as many places as there may be n-grams are fewer than a sort would take
        there = np.zeros(len(letters) ** LETTERS, bool)
        there[keys] = True
        found, which = np.flatnonzero(there), (np.cumsum(there) - 1)[keys]
    known = np.zeros(len(found), np.int64)
    for place in reversed(range(LETTERS)):
        known = known << 21 | letters[found // len(letters) ** place % len(letters)]
    # the last window of a text ends in the gap before the next one
    ends = np.maximum(begins[1:] - LETTERS + 2, begins[:-1])
    return known, which, np.stack([begins[:-1], ends])


class Memory:
    """Vectors of the n-grams that a worker has met."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIMENSIONS), np.int8)

    def take(self, keys: np.ndarray) -> np.ndarray:
        """A row of single-precision numbers for each n-gram."""
        if len(self.rows) + len(keys) > KEPT_GRAMS:
            self.forget()
        mask = (1 << 21) - 1
        for key in keys.tolist():
            if key not in self.rows:
                at = self.rows[key] = len(self.rows)
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[at] = gram_vector(tuple(key >> 21 * place & mask for place in reversed(range(LETTERS))))
        return self.vectors[[self.rows[key] for key in keys.tolist()]].astype(np.float32)


_MEMORY = Memory()


def bundles(texts: list[str]) -> np.ndarray:
    """A row for each text: the sum of the vectors of its n-grams; zeros without letters."""
    known, which, spans = grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    of = np.repeat(np.arange(len(texts)), spans[1] - spans[0])
    which = which[ragged(spans[0], spans[1] - spans[0])]
    for first in range(0, len(known), GRAMS):
        vectors = _MEMORY.take(known[first : first + GRAMS])
        inside = slice(None) if len(known) <= GRAMS else (which >= first) & (which < first + GRAMS)
        cells = of[inside] * len(vectors) + which[inside] - first
        counts = np.bincount(cells, minlength=len(texts) * len(vectors)).reshape(len(texts), len(vectors))
        out += counts.astype(np.float32) @ vectors
    return out


def language_sums(docs: DataFrame) -> DataFrame:
    """lang, dimension, total: the bundle of all texts of each language of `docs` (text, lang), added up in the tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values = [total.tolist() for total in sums.values()]
            return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(values, pa.list_(pa.float64()))], ["lang", "sums"])

        for batch in slices(batches, 256, 1 << 20):
            known, which, spans = grams([text or "" for text in batch.column("text").to_pylist()])
            counts: dict[str, np.ndarray] = {}
            for lang, (begin, end) in zip(batch.column("lang").to_pylist(), spans.T.tolist()):
                if end > begin:
                    own = np.bincount(which[begin:end], minlength=len(known))
                    counts[lang] = counts[lang] + own if lang in counts else own
            for first in range(0, len(known), GRAMS):
                vectors = _MEMORY.take(known[first : first + GRAMS])
                for lang, own in counts.items():
                    sums[lang] = sums.get(lang, 0.0) + (own[first : first + GRAMS].astype(np.float32) @ vectors).astype(np.float64)
            if len(sums) > HELD_LANGUAGES:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = docs.select("text", "lang").mapInArrow(add, "lang string, sums array<double>")
    return parts.select("lang", F.posexplode("sums").alias("dimension", "value")).groupBy("lang", "dimension").agg(F.sum("value").alias("total"))


def prototypes(docs: DataFrame) -> DataFrame:
    """lang, prototype: a row for each language of `docs` (text, lang) whose texts have letters; a NULL lang teaches nothing."""
    sums = language_sums(docs.where(F.col("lang").isNotNull()))
    ordered = F.array_sort(F.collect_list(F.struct("dimension", "total")))
    return sums.groupBy("lang").agg(F.transform(ordered, lambda each: each["total"]).alias("prototype"))


_UNPACKED: dict[str, tuple[list[str], np.ndarray]] = {}


def _units(shared) -> tuple[list[str], np.ndarray]:
    """The broadcast languages and their prototypes, of length 1 and as columns."""
    name, langs, vectors = shared.value
    if name not in _UNPACKED:
        _UNPACKED.clear()
        units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        _UNPACKED[name] = langs, units.T.astype(np.float32)
    return _UNPACKED[name]


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and whatever else) with lang_pred and score: the language of `learned` (lang, prototype) whose
    prototype has the greatest cosine with the text's bundle, and that cosine, 0 to 1.

    Texts that are NULL or without a letter, and all texts where nothing was learned, are `und` with score 0. Texts are
    looked at whole. Equal cosines go to the first language by code point. Prototypes go to the tasks in blocks of bounded
    size; a row carries its best language from one block to the next."""
    spark = docs.sparkSession
    spare = [name for name in docs.columns if name.lower() in ("lang_pred", "score")]
    if spare:
        raise ValueError(f"columns {spare} are in the way")
    order = F.row_number().over(Window.orderBy("lang"))
    numbered = stored(learned.select((order - 1).alias("number"), "lang", "prototype"), "prototypes")
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema) + ", lang_pred string, score double"
    rows = docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    for at in range(math.ceil(numbered.count() / BLOCK_LANGUAGES)):
        block = numbered.where(F.floor(F.col("number") / BLOCK_LANGUAGES) == at).orderBy("number").toArrow()
        langs = block["lang"].to_pylist()
        vectors = np.array(block["prototype"].combine_chunks().flatten()).reshape(len(langs), DIMENSIONS)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, langs, vectors))
        rows = rows.mapInArrow(_compare(shared), schema)
    return rows


def _compare(shared):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, units = _units(shared)
        for batch in slices(batches, 256, 1 << 20):
            found = bundles([text or "" for text in batch.column("text").to_pylist()])
            lengths = np.linalg.norm(found, axis=1)
            cosines = (found @ units) / np.maximum(lengths, 1e-12)[:, None]
            at = cosines.argmax(axis=1)
            cosine = np.clip(cosines[np.arange(len(at)), at].astype(np.float64), 1e-9, 1.0)
            before = batch.column("score").to_numpy()
            better = (lengths > 0) & (cosine > before)
            names = np.array(langs, object)[at]
            best = np.where(better, names, np.array(batch.column("lang_pred").to_pylist(), object))
            columns = [batch.column(name) for name in batch.schema.names[:-2]]
            columns += [pa.array(best.tolist(), pa.string()), pa.array(np.where(better, cosine, before))]
            yield pa.record_batch(columns, batch.schema.names)

    return compare


def predicted_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang).

    Prototypes are learned from all documents outside the held fold whose lang is not NULL; lang, source and doc_id are no
    inputs of a prediction. A NULL doc_id counts as an empty one for the fold. Repeated rows are predicted, and learned
    from, each. An empty table gives no rows."""
    is_held = fold(F.col("doc_id"), folds) == held
    learned = prototypes(docs.where(~is_held).select("text", F.col("lang").cast("string").alias("lang")))
    rows = docs.select("doc_id", "text", is_held.alias("held_out"))
    return identify(rows, learned).select("doc_id", "held_out", "lang_pred", "score")
