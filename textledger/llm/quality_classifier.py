"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textledger.llm.common import fold

#: Labelled documents that the trees are fitted on at most: those with the smallest hashes of their ids.
TRAIN_DOCS = 20_000

TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 1.0

_LETTERS = np.zeros((256, 8))
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>", b"\n")):
    _LETTERS[list(_bytes), _kind] = 1
_LETTERS[list(range(0x80, 0x100)), 6] = 1
_LETTERS[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *b"@[]{}\\^_`~+=/"], 7] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """Statistics of whole texts (UTF-8), a row each. Empty texts have zeros."""
    out = np.zeros((len(texts), 20))
    for at, text in enumerate(texts):
        found = text.split()
        if not found:
            continue
        lower = text.lower().split()
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _LETTERS
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        lines = [line for line in text.split(b"\n") if line.strip()]
        triples = list(zip(lower, lower[1:], lower[2:]))
        different = len(set(lower))
        out[at] = [
            np.log1p(len(text)),
            np.log1p(len(found)),
            lengths.mean(),
            lengths.std(),
            lengths.max(),
            *(kinds / len(text)),
            different / len(found),
            different / len(found) ** 0.8,
            1 - len(set(lines)) / len(lines),
            1 - len(set(triples)) / max(1, len(triples)),
            len(found) / len(lines),
            kinds[3] / len(found),
            (lengths == 1).mean(),
        ]
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of equal depth, flattened: inner nodes by level, then leaves. Smaller than 200 kB."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; a greater value goes right
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, for all rows and trees at once level by level."""
        trees, inner = self.feature.shape
        node, rows, tree = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while inner and node.min(initial=inner) < inner:
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.limit[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit by gradients and second derivatives of the logistic loss, added up in histograms of each node."""
    edges = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, x.T)])
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    total, features, limits, leaves = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = [], []
        for level in range(DEPTH):
            best = np.zeros(1 << level), np.zeros(1 << level, np.int64), np.full(1 << level, BINS)
            for at, bins in enumerate(binned):
                place = node * BINS + bins
                g, h = (np.cumsum(np.bincount(place, w, BINS << level).reshape(-1, BINS), axis=1) for w in (slope, curve))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(h < 1) | (h[:, -1:] - h < 1)] = 0
                cut = gain.argmax(axis=1)
                better = gain[np.arange(len(cut)), cut] > best[0] + 1e-9
                for kept, fresh in zip(best, (gain[np.arange(len(cut)), cut], np.full(len(cut), at), cut)):
                    kept[better] = fresh[better]
            _, chosen, cut = best
            feature += chosen.tolist()
            limit += [edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(chosen, cut)]
            node = 2 * node + (binned[chosen[node], np.arange(len(y))] > cut[node])
        g, h = (np.bincount(node, w, 1 << DEPTH) for w in (slope, curve))
        leaf = -RATE * g / (h + RIDGE)
        total = total + leaf[node]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), base)


def document_statistics(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics([text.encode() for text in texts.fillna("")])))

    return each(text)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Trees:
    """Trees from at most `bound` labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    A document whose labels differ counts by the greatest; NULL ids and labels are left out; of rows that share an id
    one counts. Without any labelled document every score is the even chance."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", document_statistics(F.col("text")).alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row")).orderBy("doc_id").select("row.*")
    table = rows.limit(bound).toArrow()
    if not table.num_rows:
        inner = (1 << DEPTH) - 1
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), 0.0)
    x = table["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    return boost(x, (table["quality"].to_numpy() == 1).astype(np.float64))


def score(text: Column, trees: Trees) -> Column:
    """The score of each text, 0 to 1. NULL is an empty text, which has a score like any other."""

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(statistics([text.encode() for text in texts.fillna("")])))

    return each(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`.

    One pass for the bounded sample and one over all texts, without a shuffle of texts. Repeated rows and ties have
    equal scores; an empty table gives no rows; only doc_id and text are read, and only the text bears on a score."""
    rows = docs.select("doc_id", score(F.col("text"), fit(docs, labels)).alias("score"))
    return rows.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with their columns, whatever they are called.

    Without a labelled document to learn from nothing is known to be bad, so all rows stay."""
    trees = fit(docs, labels)
    if not trees.leaf.any() and trees.base == 0.0:
        return docs
    return docs.where(score(F.col("text"), trees) >= threshold)
