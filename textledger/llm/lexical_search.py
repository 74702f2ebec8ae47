"""Ranked lexical search of many items at once: what items share is worked out once for each document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textledger.llm.common import slices, utf8
from textledger.sources.shared import stored

#: Items, and different (term, times) of items, that a block holds; there are as many blocks as that asks for.
BLOCK_ITEMS, BLOCK_LEAVES = 1024, 200_000

#: Accumulators (node by document) that a task holds at a time.
CELLS = 2_000_000

#: Pairs that a task keeps before it drops those that cannot be among the best any more.
PENDING = 100_000

ROUNDS = 16  # of merging pairs of nodes; more would only share more

# letters and digits of ASCII, A-Z as a-z, and all bytes of other characters
_TERM_BYTES = bytes(byte if byte > 0x7F or chr(byte).isalnum() else 0x20 for byte in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, ASCII digits and all other non-ASCII characters, A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, times: the terms of each row of `items` (item, item_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [Counter(terms(text)) for text in utf8(batch.column("text"))]
            of = pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, found))))
            columns = [batch.column("item").take(of), batch.column("item_id").take(of)]
            columns += [pa.array(list(chain.from_iterable(found)), pa.binary())]
            columns += [pa.array(list(chain.from_iterable(each.values() for each in found)), pa.int64())]
            yield pa.record_batch(columns, ["item", "item_id", "term", "times"])

    return items.mapInArrow(count, "item long, item_id long, term binary, times long")


def sharing_dag(rows: pd.DataFrame) -> tuple[list[tuple[bytes, int]], list[list[tuple[int, int]]], dict[int, list[int]]]:
    """Leaves (term, times), rounds of nodes (left, right) and the roots of each item, for `rows` (item, term, times).

    Nodes are numbered on from the leaves, in the order of the rounds. Items are sequences of their leaves, those that most
    items have first. In each round neighbours that two or more items have side by side become one node, the most common
    ones first, until no two items share any. A node stands for a set of terms; its items add its accumulator up as one."""
    support = Counter(zip(rows["term"], rows["times"]))
    leaves = sorted(support, key=lambda leaf: (-support[leaf], leaf))
    number = {leaf: at for at, leaf in enumerate(leaves)}
    of: dict[int, list[int]] = {}
    for item, term, times in zip(rows["item"], rows["term"], rows["times"]):
        of.setdefault(item, []).append(number[term, times])
    of = {item: sorted(found) for item, found in of.items()}
    rounds: list[list[tuple[int, int]]] = []
    total = len(leaves)
    for _ in range(ROUNDS):
        shared = Counter(chain.from_iterable(zip(found, found[1:]) for found in of.values()))
        shared = {pair: n for pair, n in shared.items() if n > 1}
        chosen: dict[int, list[int]] = {}  # places where pairs begin that do not overlap
        for item, found in of.items():
            places = [at for at, pair in enumerate(zip(found, found[1:])) if pair in shared]
            taken: set[int] = set()
            for at in sorted(places, key=lambda at: (-shared[found[at], found[at + 1]], at)):
                if at - 1 not in taken and at + 1 not in taken:
                    taken.add(at)
            chosen[item] = sorted(taken)
        used = Counter((of[item][at], of[item][at + 1]) for item, places in chosen.items() for at in places)
        nodes = {pair: total + at for at, pair in enumerate(sorted(pair for pair, n in used.items() if n > 1))}
        if not nodes:
            break
        for item, places in chosen.items():
            found, out, at, begins = of[item], [], 0, set(places)
            while at < len(found):
                node = nodes.get((found[at], found[at + 1])) if at in begins else None
                out.append(found[at] if node is None else node)
                at += 1 if node is None else 2
            of[item] = out
        rounds.append(list(nodes))
        total += len(nodes)
    return leaves, rounds, of


class Plan:
    """What tasks need of a block of items: its terms, and the sharing of their accumulators."""

    def __init__(self, rows: pd.DataFrame):
        leaves, rounds, of = sharing_dag(rows)
        self.terms = sorted({term for term, _ in leaves})
        code = {term: at for at, term in enumerate(self.terms)}
        self.leaf_code = np.array([code[term] for term, _ in leaves], np.int64)
        self.leaf_times = np.array([times for _, times in leaves], np.int64)
        self.rounds = [np.array(pairs, np.int64).T for pairs in rounds]
        self.nodes = len(leaves) + sum(map(len, rounds))
        self.items = np.array(list(of), np.int64)
        self.roots = np.fromiter(chain.from_iterable(of.values()), np.int64)
        self.starts = np.cumsum([0, *map(len, of.values())])[:-1]

    def accumulators(self, gains: np.ndarray) -> np.ndarray:
        """For each node (rows) and document (columns) the sum of the gains of its leaves, from those of terms."""
        out = np.empty((self.nodes, gains.shape[1]), np.int64)
        at = len(self.leaf_code)
        np.multiply(gains[self.leaf_code], self.leaf_times[:, None], out=out[:at])
        for left, right in self.rounds:
            np.add(out[left], out[right], out=out[at : at + len(left)])
            at += len(left)
        return out

    def scores(self, gains: np.ndarray) -> np.ndarray:
        """Of each item and document."""
        return np.add.reduceat(self.accumulators(gains)[self.roots], self.starts, axis=0)


def _blocks(leaves: DataFrame) -> int:
    """Into how many blocks items go by a hash so that none is too large, but for an item that is so by itself."""
    blocks, number = 1, leaves.agg(F.count_distinct("item")).first()[0]
    while blocks < 2 * number:
        sizes = leaves.groupBy(_block(blocks)).agg(F.count_distinct("item").alias("items"), F.count("*").alias("leaves"))
        items, most = sizes.agg(F.max("items"), F.max("leaves")).first()
        if items <= BLOCK_ITEMS and most <= BLOCK_LEAVES:
            break
        blocks *= 2
    return blocks


def _block(blocks: int):
    return F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")


def _postings(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, codes, times: of each document the number of its terms, and which of the block's it has how often."""
    names: dict[int, dict[bytes, int]] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.setdefault(0, {term: at for at, term in enumerate(shared.value.terms)})
        for batch in slices(batches):
            lists = [terms(text) for text in utf8(batch.column("text"))]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            codes = np.fromiter(map(known.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(lists)), sizes)[codes >= 0]
            cells, times = np.unique(of * len(known) + codes[codes >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(lists) + 1) * len(known)).astype(np.int32))
            codes = pa.array((cells % max(1, len(known))).astype(np.int32))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes)]
            columns += [pa.ListArray.from_arrays(ends, codes), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            yield pa.record_batch(columns, ["doc_id", "n", "codes", "times"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, codes array<int>, times array<int>")


class _Best:
    """The k best documents of each item among those seen."""

    def __init__(self, items: int, k: int):
        self.k, self.reached = k, np.ones(items, np.int64)
        self.columns = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is NULL, id
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.reached[:, None])
        self.waiting.append([item, scores[item, at], missing[at], ids[at]])
        self.size += len(item)
        if self.size > PENDING:
            self.close()

    def close(self) -> None:
        item, score, missing, ids = (np.concatenate(each) for each in zip(self.columns, *self.waiting))
        order = np.lexsort((ids, missing, -score, item))
        first = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.columns = [each[order] for each in (item, score, missing, ids)]
        kth = np.flatnonzero(np.bincount(self.columns[0], minlength=len(self.reached)) == self.k)
        last = np.searchsorted(self.columns[0], kth, "right") - 1
        self.reached[kth] = self.columns[1][last]
        self.waiting, self.size = [], 0


def _scored(postings: DataFrame, shared, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task for each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        best = _Best(len(plan.items), k)
        for batch in slices(batches, max(1, min(512, CELLS // max(1, plan.nodes)))):
            n = batch.column("n").to_numpy()
            codes, times = (batch.column(name).flatten().to_numpy().astype(np.int64) for name in ("codes", "times"))
            of = np.repeat(np.arange(len(n)), batch.column("codes").value_lengths().to_numpy())
            length = 100 - 75 + 75 * n * documents // total
            gains = np.zeros((len(plan.terms), len(n)), np.int64)
            gains[codes, of] = weights[codes] * (1_000_000_000 * times // (1000 * times + 8 * length[of]))
            ids = batch.column("doc_id")
            best.add(plan.scores(gains), ids.is_null().to_numpy(False).astype(np.int64), ids.fill_null(0).to_numpy())
        best.close()
        item, scores, missing, ids = best.columns
        columns = [pa.array(plan.items[item]), pa.array(ids, mask=missing > 0), pa.array(scores)]
        yield pa.record_batch(columns, ["item", "doc_id", "score"])

    return postings.where("n > 0").mapInArrow(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) with the highest score above 0 for each item (item_id, text).

    The score is the sum over an item's terms, repeats included, of the term's weight times its saturated number of
    occurrences, in whole numbers. Equal scores go to the smaller doc_id, a NULL one last. Items are put into blocks
    of bounded size, whose sharing plan goes to every task; texts are cut into terms once for each block, and counts of
    terms are stored, since weights follow from all documents. For a slice of documents each node of the plan is added
    up once for all items that share it. A task passes at most k documents on for each item.

    A NULL or empty text has no terms: such an item has no rows, such a document is none of an item's and does not count.
    Rows of `items` that repeat an item_id are items of their own, rows of `docs` that repeat a doc_id documents of their
    own. Without documents or items there are no rows. Other columns are not read."""
    spark = docs.sparkSession
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    leaves = stored(item_terms(stored(numbered, "items")), "item-terms")
    found = [
        _search_block(spark, docs, leaves.where(_block(blocks) == at), k)
        for blocks in [_blocks(leaves)]
        for at in range(blocks)
    ]
    found = [part for part in found if part is not None]
    names = leaves.select("item", "item_id").distinct()
    if not found:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    rows = found[0]
    for part in found[1:]:
        rows = rows.union(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    rows = rows.withColumn("rank", place).where(F.col("rank") <= k)
    return rows.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, docs: DataFrame, leaves: DataFrame, k: int) -> DataFrame | None:
    rows = leaves.select("item", "term", "times").toArrow().to_pandas()  # a block, of bounded size
    if not len(rows):
        return None
    shared = spark.sparkContext.broadcast(plan := Plan(rows.sort_values(["item", "term"])))
    postings = stored(_postings(docs, shared), "postings")
    documents, total = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not documents:
        return None
    counts = postings.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).toArrow()
    holding = np.zeros(len(plan.terms), np.int64)
    holding[counts["code"].to_numpy()] = counts["n"].to_numpy()
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()]
    return stored(_scored(postings, shared, np.array(weights, np.int64), documents, total, k), "scored")
