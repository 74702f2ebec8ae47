"""Exact Jaccard join of documents on word n-grams: prefix tiles by size, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger.llm.common import head_count, sheltered, slices, utf8
from textledger.llm.components import components
from textledger.sources.shared import stored, stored_for_join

GRAM, SIMILAR = 5, Fraction(3, 4)

#: One document in so many is looked at to see which shingles are common; that only orders the prefixes.
LOOK_AT, COMMON, COMMON_SHINGLES = 16, 4, 1_000_000

TRIES = 8  # pairs of two components that a task compares in the second round
BAND = 1.1  # width of the size bands in which documents of a tile are first compared with one
SENT_BYTES = 8 * 1024 * 1024  # signatures of more are joined, as the driver holds what is sent several times over
REMEMBERED = 200_000  # pairs that a task knows to have passed on, so that it does not do so again

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A random-looking odd number for each byte."""
    return mixed_bits(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(number, base, np.uint64)
        power[:1] = 1
        both.append(np.multiply.accumulate(power))
    return both[0], both[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of all words of the texts, in a row, and how many each text has.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole row of texts, so that no word
    becomes an object."""
    row = np.frombuffer(b"\n".join([*(text.lower() for text in texts), b""]), np.uint8)
    space = _SPACES[row]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    size = 1 << max(20, int(len(row)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(_byte_values()[row] * power[: len(row)], out=sums[1:])
    hashes = mixed_bits((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum([len(text) + 1 for text in texts])
    return hashes, np.diff(np.searchsorted(begin, ends), prepend=0).tolist()


def shingle_sets(texts: list[bytes], gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; of fewer words, one of the whole sequence."""
    hashes, sizes = word_hashes(texts) if texts else (np.zeros(0, np.uint64), [])
    whole = _mixed_windows(hashes, gram)
    sets, start = [], 0
    for size in sizes:
        if size >= gram:
            found = np.sort(whole[start : start + size - gram + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            sets.append(found[fresh])
        else:
            sets.append(_mixed_windows(hashes[start : start + size], size) if size else np.zeros(0, np.uint64))
        start += size
    return sets


def _mixed_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` word hashes; other widths give other hashes."""
    number = max(len(hashes) - width + 1, 0)
    total = np.full(number, width, np.uint64)
    for at in range(width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[at : at + number]
    return mixed_bits(total)


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """64 bits that stand for each whole set; 0 for the empty set."""
    lengths = np.array([len(each) for each in sets], np.int64)
    keys, filled = np.zeros(len(sets), np.int64), np.flatnonzero(lengths)
    if len(filled):
        starts = (np.cumsum(lengths) - lengths)[filled]
        sums = np.add.reduceat(mixed_bits(np.concatenate(sets) ^ np.uint64(0xD6E8FEB86659FD93)), starts)
        keys[filled] = mixed_bits(sums + lengths[filled].astype(np.uint64)).view(np.int64)
    return keys.tolist()


def prefix_length(size: int, similar: Fraction = SIMILAR) -> int:
    """Of two similar sets, each has one of the other's first so many, in any order common to all."""
    return size - -(-size * similar.numerator // similar.denominator) + 1


def signature(shingles: np.ndarray) -> bytes:
    """A bit for each hash of a shingle, in a power of two of at least two bits for each. Bits that only one of two sets
    has count shingles that the other lacks."""
    bits = max(256, 1 << (2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def bits_alone(signatures: list[list[bytes]]) -> list[np.ndarray]:
    """For pairs of signatures: bits that the first has alone, and the second. The larger of unequal ones is folded."""
    lengths = np.array([list(map(len, side)) for side in signatures])
    alone = [np.zeros(lengths.shape[1], np.int64) for _ in signatures]
    for one, other in np.unique(lengths, axis=1).T.tolist():
        at = np.flatnonzero((lengths[0] == one) & (lengths[1] == other))
        least, bits = min(one, other), []
        for side in signatures:
            rows = np.frombuffer(b"".join([side[row] for row in at]), np.uint8).reshape(len(at), -1, least)
            bits.append(np.bitwise_or.reduce(rows, axis=1))
        for side, (x, y) in enumerate((bits, bits[::-1])):
            alone[side][at] = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    return alone


def most_common(size, at, other, other_at):
    """The most that two sets can share whose first common shingle has these places in their orders."""
    if isinstance(size, np.ndarray):
        return np.minimum(size - at, other - other_at)
    return min(size - at, other - other_at)


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def _sets(docs: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """`rows(doc_ids, sets, seen)` of each batch; `seen` is kept for a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            yield rows(batch.column("doc_id").cast(pa.int64()), shingle_sets(utf8(batch.column("text"))), seen)

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's key); for the first row of a set in each task also its signature, and for one
    set in `LOOK_AT` its shingles."""

    def rows(ids: pa.Array, sets: list[np.ndarray], seen: set[int]) -> pa.RecordBatch:
        keys = set_keys(sets)
        signatures, looked_at = [], []
        for key, each in zip(keys, sets):
            fresh = key not in seen and len(each) > 0
            signatures.append(signature(each) if fresh else None)
            looked_at.append(each.view(np.int64) if fresh and key % LOOK_AT == 0 else None)
            seen.add(key)
        return _batch(
            {
                "doc_id": (ids, pa.int64()),
                "n_shingles": (list(map(len, sets)), pa.int64()),
                "node": (keys, pa.int64()),
                "signature": (signatures, pa.binary()),
                "looked_at": (looked_at, pa.list_(pa.int64())),
            }
        )

    return _sets(docs, rows, "doc_id long, n_shingles long, node long, signature binary, looked_at array<long>")


def _prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """shingle, size, at, node: the prefix of each different set, with places in the order; common shingles come last in it."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def rows(_: pa.Array, sets: list[np.ndarray], seen: set[int]) -> pa.RecordBatch:
        often, parts, sizes, nodes = shared.value, [np.zeros(0, np.int64)], [0], [0]
        for key, each in zip(set_keys(sets), sets):
            if not len(each) or key in seen:
                continue
            seen.add(key)
            if len(often):
                is_common = often[np.minimum(np.searchsorted(often, each), len(often) - 1)] == each
                each = np.append(each[~is_common], each[is_common])
            parts.append(each[: prefix_length(len(each))].view(np.int64))
            sizes.append(len(each))
            nodes.append(key)
        lengths = list(map(len, parts))
        return _batch(
            {
                "shingle": (np.concatenate(parts), pa.int64()),
                "size": (np.repeat(np.array(sizes, np.int32), lengths), pa.int32()),
                "at": (np.concatenate([np.arange(length, dtype=np.int32) for length in lengths]), pa.int32()),
                "node": (np.repeat(np.array(nodes, np.int64), lengths), pa.int64()),
            }
        )

    return _sets(docs, rows, "shingle long, size int, at int, node long")


def _in_runs(rows: DataFrame) -> DataFrame:
    """Rows that share a shingle in one task, in the order of size."""
    return rows.repartition("shingle").sortWithinPartitions("shingle", "size", "node")


class _FirstLooks:
    """Passes over sorted rows; holds three sets of the current shingle, whatever the rows that share it.

    Rows may have a component. Sets of one component are not compared, and of two components a few pairs are in each
    task; a set also leads if none of its component does."""

    def __init__(self, joined: bool):
        self.joined = joined
        self.last = self.shingle = None
        self.leaders: list[tuple[int, int, int, int]] = []
        self.told: dict[int, int] = {}

    def stretch(self, table: list[np.ndarray], following: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingles, sizes, places, nodes = table[:4]
        if not len(shingles):
            return
        before = np.append(self.last if self.last is not None else ~shingles[0], shingles[:-1])
        after = np.append(shingles[1:], following if len(following) else ~shingles[-1])
        self.last = shingles[-1]
        at = np.flatnonzero((shingles == before) | (shingles == after))
        looks = [self.look(*row) for row in zip(*(column[at].tolist() for column in table))]
        yield _batch(
            {
                "shingle": (shingles[at], pa.int64()),
                "size": (sizes[at], pa.int32()),
                "at": (places[at], pa.int32()),
                "node": (nodes[at], pa.int64()),
                "leaders": (looks, pa.list_(pa.int64())),
            }
        )

    def look(self, shingle: int, size: int, place: int, node: int, component: int | None = None) -> list[int]:
        if shingle != self.shingle:
            self.shingle, self.leaders = shingle, []
        if len(self.told) > REMEMBERED:
            self.told.clear()
        component = component if self.joined else node
        most, found = TRIES if self.joined else 1, []
        for other, least, least_at, of in self.leaders:
            if of == component or not could_share(least, least_at, size, place):
                continue
            # one number for both; should two pairs ever share it, a later round finds what this one leaves out
            pair = hash((of, component))
            if (times := self.told.get(pair, 0)) < most:
                self.told[pair] = times + 1
                found.append(other)
        # a set whose place is too far back for any set of its size or more leads none
        if could_share(size, place, size, 0):
            leads = not self.leaders or size > self.leaders[-1][1] * BAND
            if leads or self.joined and all(of != component for *_, of in self.leaders):
                self.leaders = [*self.leaders[-2:], (node, size, place, component)]
        return found


def could_share(size, at, other, other_at, similar: Fraction = SIMILAR):
    """Whether two sets can be similar whose first common shingle has these places. It holds for at least one of the
    shingles that similar sets share, so pairs may be dropped wherever it does not."""
    most = most_common(size, at, other, other_at)
    return most * (similar.numerator + similar.denominator) >= (size + other) * similar.numerator


def _looks(rows: DataFrame) -> DataFrame:
    """`rows` of every shingle that two sets or more have, and leaders: sets to compare this one with.

    A set that is `BAND` times as large as the last leader of its shingle leads from there on; a set looks at the last three
    leaders. `rows` are (shingle, size, at, node), and component once there are any."""
    columns = [name for name in ("shingle", "size", "at", "node", "component") if name in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = _FirstLooks(len(columns) > 4), None
        for batch in batches:
            table = [batch.column(name).to_numpy() for name in columns]
            if held is not None:
                table = [np.append(a, b) for a, b in zip(held, table)]
            yield from state.stretch([column[:-1] for column in table], table[0][-1:])
            held = [column[-1:] for column in table]
        if held is not None:
            yield from state.stretch(held, held[0][:0])

    schema = "shingle long, size int, at int, node long, leaders array<long>"
    return _in_runs(rows).select(*columns).mapInArrow(run, schema)


def _other_pairs(rows: DataFrame) -> DataFrame:
    """a, b: all pairs of sets of fitting size that share a shingle of `rows` (shingle, size, at, node, component) but no
    component yet.

    The rows of a shingle's largest component are compared with those outside it only. A task holds a shingle's rows as
    numbers (28 bytes each), not sets."""

    def run_pairs(size: np.ndarray, place: np.ndarray, node: np.ndarray, component: np.ndarray) -> Iterator[np.ndarray]:
        values, which, counts = np.unique(component, return_inverse=True, return_counts=True)
        most = counts.argmax()
        for at in np.flatnonzero(which != most):
            fit = could_share(size, place, size[at], place[at])
            fit &= (which != which[at]) & ((which == most) | (np.arange(len(size)) > at))
            others = node[fit]
            yield np.stack([np.minimum(others, node[at]), np.maximum(others, node[at])])

    def stretch(table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingles, size, place, node, component = table
        if not len(shingles):
            return
        first = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
        ends = np.append(first[1:], len(shingles))
        mixed = np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)
        found, held = [], 0
        for begin, end in zip(first[mixed], ends[mixed]):
            for pairs in run_pairs(size[begin:end].astype(np.int64), place[begin:end], node[begin:end], component[begin:end]):
                found.append(pairs)
                held += pairs.shape[1]
                if held > REMEMBERED:
                    yield out(found)
                    found, held = [], 0
        if found:
            yield out(found)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return _batch({"a": (a, pa.int64()), "b": (b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            table = [batch.column(name).to_numpy() for name in ("shingle", "size", "at", "node", "component")]
            if not batch.num_rows:
                continue
            if held and table[0][-1] == held[0][0][0]:  # the run goes on
                held.append(table)
                continue
            table = [np.concatenate(parts) for parts in zip(*held, table)]
            open_ = int(np.flatnonzero(table[0] != table[0][-1])[-1]) + 1 if (table[0] != table[0][-1]).any() else 0
            yield from stretch([column[:open_] for column in table])
            held = [[column[open_:] for column in table]]
        if held:
            yield from stretch([np.concatenate(parts) for parts in zip(*held)])

    return _in_runs(rows).select("shingle", "size", "at", "node", "component").mapInArrow(run, "a long, b long")


def _could_match(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for enough common shingles. A set has no more in common with
    another than its size less the bits that it alone has set."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = [batch.column(f"{side}_size").to_numpy() for side in "ab"]
            alone = bits_alone([batch.column(f"{side}_bits").to_pylist() for side in "ab"])
            most = np.minimum(size[0] - alone[0], size[1] - alone[1])
            room = most * SIMILAR.denominator >= (size[0] + size[1] - most) * SIMILAR.numerator
            yield batch.select(["a", "b"]).filter(pa.array(room))

    for side in "ab":
        own = signatures.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_size"), F.col("signature").alias(f"{side}_bits"))
        pairs = pairs.join(own, side)
    return pairs.mapInArrow(check, "a long, b long")


def _links(docs: DataFrame, pairs: DataFrame, described: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by intersection of their sorted arrays. Only the texts of pairs that
    the signatures let through are read again."""
    pairs = stored(_could_match(pairs.distinct(), signatures), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = described.where("doc_id IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_wanted"))
    ids, _ = stored_for_join(ids.select("_wanted").distinct(), "ids")
    rows = docs.select("doc_id", "text")
    rows = rows.join(ids, F.col("doc_id") == F.col("_wanted"), "left_semi").union(rows.where("doc_id IS NULL"))

    def keyed(_: pa.Array, sets: list[np.ndarray], seen: set[int]) -> pa.RecordBatch:
        return _batch({"node": (set_keys(sets), pa.int64()), "shingles": ([each.view(np.int64) for each in sets], pa.list_(pa.int64()))})

    sets = stored(_sets(rows, keyed, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            lists = [batch.column(f"{side}_set") for side in "ab"]
            values = [np.asarray(each.values).view(np.uint64) for each in lists]
            offsets = [each.offsets.to_numpy() for each in lists]
            for at in range(batch.num_rows):
                a, b = (v[o[at] : o[at + 1]] for v, o in zip(values, offsets))
                place = np.searchsorted(b, a)
                common = int((b[np.minimum(place, len(b) - 1)] == a).sum())
                similar.append(common * SIMILAR.denominator >= (len(a) + len(b) - common) * SIMILAR.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    return stored(pairs.mapInArrow(check, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`: the smallest doc_id that links of documents with a
    Jaccard similarity of 0.75 or more over word 5-grams lead to.

    Exact, without a cap. Equal sets count as one. Two similar sets share a shingle of their prefixes, so sets that share
    none are never compared; common shingles (found on some documents) come last in the order of all prefixes, which
    keeps what many documents share out of most of them. Among the sets that share a shingle, those of too different sizes are
    not compared. A first round compares each with a few leaders and joins what is linked, a second one some sets of
    different components, and a third one all that is not joined yet. Pairs pass a bound from bitmaps before the exact intersection.

    Sets hold 64-bit hashes. A NULL or wordless text has no shingles and is linked with nothing; a NULL doc_id takes part,
    and is no component's least id unless all its ids are NULL; repeated rows are equal sets. Very long texts count
    whole. An empty table gives no rows."""
    return _members(docs).select("doc_id", "n_shingles", "component_id")


def _members(docs: DataFrame) -> DataFrame:
    """As `near_duplicates`, with node, the key of the row's set, and component, which is NULL for a row without shingles."""
    described = stored(_described(docs), "described")
    looked_at = described.where("looked_at IS NOT NULL").dropDuplicates(["node"])
    often = looked_at.select(F.explode("looked_at").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    often = stored(often, "common")
    often = often.where(F.col("n") >= head_count(often, COMMON_SHINGLES)).select("word").toArrow()
    common = np.sort(often["word"].to_numpy().astype(np.int64).view(np.uint64))
    signatures = described.where("signature IS NOT NULL").select("node", "n_shingles", "signature").dropDuplicates(["node"])
    signatures, _ = stored_for_join(signatures, "signatures", SENT_BYTES)

    def to_leaders(looks: DataFrame) -> DataFrame:
        pairs = looks.select(F.explode("leaders").alias("other"), "node")
        return pairs.select(F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b"))

    looks = stored(_looks(_prefixes(docs, common)), "looks")
    links = _links(docs, to_leaders(looks), described, signatures)
    joined = components(links)
    for others in (lambda rows: to_leaders(_looks(rows).where(F.size("leaders") > 0)), _other_pairs):
        labelled = looks.drop("leaders").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        more = _links(docs, others(labelled), described, signatures)
        if not more.isEmpty():
            links = links.union(more)
            joined = components(links)

    rows = described.select("doc_id", "n_shingles", "node").join(joined, "node", "left")
    rows = stored(rows.select("doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component")), "members")
    least = stored(rows.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    rows = rows.join(least.where("component IS NOT NULL"), "component", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), "node", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each component one row with the smallest doc_id stays.

    Rows that share a doc_id, and those without one, are told apart by their sets: different texts under one id that are
    not linked stay both. A row with a NULL doc_id stays for its component only if no row there has an id. Of rows without
    shingles, which are linked with nothing, those alike in id and text count as one; with a NULL doc_id all stay. Columns
    stay as they are, whatever they are called."""
    rows, restored = sheltered(docs, "doc_id", "text")
    return restored(_one_of_each(rows))


def _one_of_each(docs: DataFrame) -> DataFrame:
    found = stored(_members(docs), "components")
    gone, _ = stored_for_join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    again, number = stored_for_join(again.select(F.col("doc_id").alias("_again")), "again")
    nameless = found.where("doc_id IS NULL")
    single = docs.where("doc_id IS NOT NULL").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if not number and nameless.isEmpty():
        return single

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series(set_keys(shingle_sets([text.encode() for text in texts.fillna("")])), dtype="int64")

    single = single.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    shared = docs.join(again, F.col("doc_id") == F.col("_again"), "left_semi").union(docs.where("doc_id IS NULL"))
    stays = found.join(again, F.col("doc_id") == F.col("_again"), "left_semi").union(nameless)
    stays = stays.where(F.col("component").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("component").alias("_component")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node"))
    shared = stored(shared.withColumn("_key", node("text")).join(stays, same).drop("_id", "_key", "_node"), "shared")
    linked = shared.where("_component IS NOT NULL").dropDuplicates(["_component"])
    wordless = shared.where("_component IS NULL")
    named = wordless.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    rest = linked.union(named).union(wordless.where("doc_id IS NULL")).drop("_component")
    return single.union(rest)
