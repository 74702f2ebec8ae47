"""Hard negatives by threshold joins over an inverted index that leaves out what norms of prefixes cover (L2AP)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textledger.llm.tiles import EXACT, TILE, block_number, exact_scores, matrix, norm, packed, pairs, whole_numbers
from textledger.sources.shared import stored

STEP = 16  # dimensions of a run of postings
SPARSE = 0.05  # share of pairs left below which they are followed one by one

#: Thresholds of the search for positives, as shares of the greatest score that norms allow; then there is none.
LADDER = (0.5, 0.25)

#: How far below a positive's score negatives are looked for first, and then; the last one is the window's end.
DEPTHS = (0.05, 0.2)

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_OVER = 1 + 1e-9  # rounds a norm up


def labelled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part: none of the three is NULL, all components are finite."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding"), scale).alias("vector"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def index_starts(prefix: np.ndarray, least: float) -> np.ndarray:
    """The first run of dimensions in which each vector has postings: where the norm of what comes up to its end reaches
    `least`, the lowest threshold over the norm of its query. Whatever lies before cannot reach a threshold by itself."""
    return (prefix[:, 1:] < least).sum(axis=1)


def candidates(vectors: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (vector, query) whose inner product may reach the query's `least`, with the product and whether it is exact.

    Runs of dimensions go from last to first, those of the most weight last in order and so first here. In each run the
    postings of the vectors that are indexed there add to partial scores; a pair leaves once its score plus the product of
    the norms of what is left stays below the threshold. Few pairs that are left are followed one by one."""
    dims = vectors.shape[1]
    order = np.argsort((vectors**2).sum(axis=0), kind="stable")
    rows, asked = vectors[:, order], queries[:, order]
    ends = np.unique(np.append(np.arange(dims % STEP, dims + 1, STEP), [0, dims]))

    def prefixes(values: np.ndarray) -> np.ndarray:
        """Norms of the components before each end."""
        squares = np.zeros((len(values), dims + 1))
        np.cumsum(values**2, axis=1, out=squares[:, 1:])
        return np.sqrt(squares[:, ends]) * _OVER

    row_norms, query_norms = prefixes(rows), prefixes(asked)
    # what rounding may have taken from an estimate; nothing where all sums are exact
    top = row_norms[:, -1].max(initial=0) * query_norms[:, -1].max(initial=0)
    slack = 0.0 if top < EXACT else top * 1e-15 * (dims + 8)
    bar = least.astype(np.float64) - slack - np.where(np.abs(least.astype(np.float64)) < EXACT, 0, 2048)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(query_norms[:, -1] > 0, bar / query_norms[:, -1], np.where(bar > 0, np.inf, -np.inf))
    starts = index_starts(row_norms, share.min(initial=np.inf))
    runs = len(ends) - 1
    live = np.flatnonzero(starts < runs) if runs else np.arange(len(rows))
    partial = np.zeros((len(live), len(asked)))
    some = partial >= bar
    at = runs
    while at > 0 and len(live):
        begin, end = ends[at - 1], ends[at]
        posted = starts[live] < at
        if posted.all():
            partial += rows[live, begin:end] @ asked[:, begin:end].T
        else:
            partial[posted] += rows[live[posted], begin:end] @ asked[:, begin:end].T
        at -= 1
        # of vectors without postings here, what they left out is more than what comes before this run
        cut = np.maximum(at, starts[live])
        rest = query_norms[:, at] if (cut == at).all() else query_norms[:, cut].T
        some = partial + row_norms[live, cut][:, None] * rest >= bar
        stays = some.any(axis=1)
        if not stays.all():
            live, partial, some = live[stays], partial[stays], some[stays]
        if some.size and some.mean() < SPARSE:
            break
    which, query = np.nonzero(some)
    row, score = live[which], partial[which, query]
    cut = np.maximum(at, starts[row])
    for at in range(int(cut.max(initial=0)), 0, -1):
        more = np.flatnonzero(cut >= at)
        begin, end = ends[at - 1], ends[at]
        score[more] += np.einsum("ij,ij->i", rows[row[more], begin:end], asked[query[more], begin:end])
        left = np.minimum(cut, at - 1)
        left = score + row_norms[row, left] * query_norms[query, left] >= bar[query]
        row, query, score, cut = row[left], query[left], score[left], cut[left]
    safe = row_norms[row, -1] * query_norms[query, -1] < EXACT
    return row, query, score, safe


def best_in_windows(tile: dict, block: dict, k: int) -> tuple[np.ndarray, ...]:
    """anchor, window, vec_id, score: the k best rows of a tile in each window of a block's anchors.

    A window belongs to an anchor (its position in the block) and takes scores from low to high, of rows with the anchor's
    label or of all others."""
    anchors = len(block["row"])
    least = np.full(anchors, MOST)
    np.minimum.at(least, block["of"], block["low"])
    row, query, score, safe = candidates(tile["vector"], block["vector"], least)
    score = exact_scores(tile["vector"], block["vector"], row, query, score, safe)
    other = tile["row"][row] != block["row"][query]
    row, query, score = row[other], query[other], score[other]
    order = np.argsort(query, kind="stable")
    row, query, score = row[order], query[order], score[order]
    same = tile["label"][row] == block["label"][query]
    starts, stops = np.searchsorted(query, np.arange(anchors)), np.searchsorted(query, np.arange(anchors), "right")
    out: list[list[np.ndarray]] = []
    for number in np.unique(block["window"]):  # at most one window of an anchor at a time
        window = np.flatnonzero(block["window"] == number)
        mine = np.full(anchors, -1)
        mine[block["of"][window]] = window
        w = mine[query]
        fits = w >= 0
        fits[fits] = (score[fits] >= block["low"][w[fits]]) & (score[fits] <= block["high"][w[fits]]) & (same[fits] == block["same"][w[fits]])
        at = np.flatnonzero(fits)
        order = np.lexsort((tile["row"][row[at]], tile["vec_id"][row[at]], -score[at].astype(np.float64), query[at]))
        if len(at) and np.abs(score[at].astype(np.float64)).max() >= EXACT:  # doubles would tie
            order = np.array(sorted(range(len(at)), key=lambda i: (query[at[i]], -int(score[at[i]]), tile["vec_id"][row[at[i]]], tile["row"][row[at[i]]])))
        at = at[order]
        first = np.searchsorted(query[at], query[at])
        at = at[np.arange(len(at)) - first < k]
        out.append([block["row"][query[at]], np.full(len(at), number), tile["vec_id"][row[at]], score[at]])
    return tuple(np.concatenate(each) for each in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _work(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                tile = {name: np.frombuffer(pair[name], np.int64) for name in ("row", "vec_id", "label")}
                tile["vector"] = matrix(pair["vector"], pair["dims"], pair["size"])
                block = {name: np.frombuffer(pair[f"q_{name}"], np.int64) for name in ("row", "label", "of", "window", "low", "high", "same")}
                block["vector"], block["same"] = matrix(pair["q_vector"], pair["dims"], pair["q_size"]), block["same"] > 0
                columns = best_in_windows(tile, block, k)
                yield pa.record_batch([pa.array(each.astype(np.int64)) for each in columns], ["anchor", "window", "vec_id", "score"])

    return work


def _blocks(windows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, int]:
    """Windows (anchor, window, low, high, same) with their anchors' vectors, packed by blocks of anchors, and their number."""
    rows = windows.join(anchors.withColumnRenamed("row", "anchor"), "anchor").withColumnRenamed("anchor", "row")
    number = block_number(rows.select("row", "dims").distinct())

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "window"])
        first = ~frame["row"].duplicated()
        one = frame[first]
        low = frame["low"].to_numpy(np.int64)
        least = np.full(len(one), MOST)
        np.minimum.at(least, first.cumsum().to_numpy() - 1, low)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(one["norm"] > 0, least / one["norm"], np.where(least > 0, np.inf, -np.inf)).min()
        whole = {name: frame[name].to_numpy(np.int64).tobytes() for name in ("window", "low", "high", "same")}
        row = {"dims": one["dims"].iloc[0], "tile": one["block"].iloc[0], "size": len(one), "least": reach, **whole}
        row |= {"of": (first.cumsum().to_numpy() - 1).astype(np.int64).tobytes(), "vector": np.concatenate(one["vector"].to_numpy()).astype(np.float64).tobytes()}
        row |= {name: one[name].to_numpy(np.int64).tobytes() for name in ("row", "label")}
        return pd.DataFrame([row])

    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)).cast("long")).withColumn("same", F.col("same").cast("long"))
    schema = "dims int, tile long, size int, least double, row binary, label binary, of binary, window binary, low binary, high binary, same binary, vector binary"
    return stored(rows.groupBy("dims", "block").applyInPandas(pack, schema), "blocks"), number


def threshold_join(tiles: DataFrame, number: int, anchors: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """anchor, window, place, vec_id, score: the k best rows, by score and then smaller vec_id, of all (`number`) tiles in
    each window."""
    # a tile whose longest vector stays below all thresholds of a block is not looked at
    worth = (F.col("q_least") <= 0) | (F.col("longest") * F.lit(_OVER) >= F.col("q_least") * F.lit(1 - 1e-9))
    schema = "anchor long, window long, vec_id long, score long"
    blocks, parts = _blocks(windows, anchors)
    found = pairs(tiles, number, blocks, parts, worth, _work(k), schema)
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _until_filled(tiles: DataFrame, number: int, anchors: DataFrame, windows: DataFrame, lower: list[Column], k: int) -> DataFrame:
    """The best of each window (anchor, window, end, high, same), whose threshold goes down by `lower` to its end, until it
    holds k rows."""
    done = []
    for low in lower:
        windows = windows.withColumn("low", F.greatest("end", low))
        found = stored(threshold_join(tiles, number, anchors, windows, k), "found")
        full = found.groupBy("anchor", "window").agg(F.count("*").alias("n"))
        tried = windows.join(full, ["anchor", "window"], "left")
        closed = (F.coalesce("n", F.lit(0)) == k) | (F.col("low") <= F.col("end"))
        tried = stored(tried.withColumn("closed", closed).drop("low", "n"), "tried")
        done.append(found.join(tried.where("closed").select("anchor", "window"), ["anchor", "window"], "left_semi"))
        windows = tried.where("NOT closed").drop("closed")
        if windows.isEmpty():
            break
    rows = done[0]
    for part in done[1:]:
        rows = rows.union(part)
    return rows


def mine(vectors: DataFrame, anchors: Column, k: int = 5, positives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `vectors` (vec_id, label,
    vector of whole numbers, none NULL) that `anchors` picks.

    An anchor's positives are its best other rows of the same label. For each of them the k best rows of other labels whose
    score is between four fifths of the positive's and the positive's score itself are its negatives. Best is the
    greatest inner product, then the smaller vec_id. Both are threshold joins against all rows: thresholds start high and
    go down until k rows are found or the window ends, and only what is not full yet goes on. Tiles hold rows of like
    norms, so that those whose norms cannot reach a threshold are passed over.

    Rows of different length are not compared, and have a score of 0 if they have no components. Rows that repeat a vec_id
    are rows of their own, as anchors too: only an anchor's own row is left out. A positive with a negative score has no
    negatives. Scores beyond 64 bits are the greatest or least such number. Empty tables give no rows."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), "vector", anchors.alias("is_anchor"))
    rows = stored(rows.withColumns({"dims": F.size("vector"), "norm": norm(F.col("vector"))}), "vectors")
    number = max(1, -(-rows.count() // TILE))
    ranged = rows.repartitionByRange(number, "dims", "norm", "row").sortWithinPartitions("dims", "norm", "row")
    tiles = stored(packed(ranged, ["row", "vec_id", "label"]), "tiles")
    tile_number = tiles.count()
    asked = stored(rows.where("is_anchor").select("row", "vec_id", "label", "vector", "dims", "norm"), "anchors")

    longest = tiles.groupBy("dims").agg(F.max("longest").alias("longest"))
    windows = asked.join(longest, "dims").select(
        F.col("row").alias("anchor"),
        F.lit(0).cast("long").alias("window"),
        F.lit(LEAST).cast("long").alias("end"),
        F.lit(MOST).cast("long").alias("high"),
        F.lit(True).alias("same"),
        (F.col("norm") * F.col("longest")).alias("most"),
    )
    shares = [F.floor(F.least(F.lit(9e18), F.col("most") * share)).cast("long") for share in LADDER]
    near = _until_filled(tiles, tile_number, asked, windows, [*shares, F.lit(LEAST).cast("long")], positives)
    near = stored(near.select("anchor", F.col("place").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score")
    end = score - F.expr("positive_score div 5")
    windows = near.where("positive_score >= 0").select("anchor", "window", end.alias("end"), score.alias("high"), F.lit(False).alias("same"))
    depths = [F.col("high") - F.floor(F.col("high") * depth).cast("long") for depth in DEPTHS[:-1]]
    found = _until_filled(tiles, tile_number, asked, windows, [*depths, F.lit(LEAST).cast("long")], k)
    found = found.join(near, ["anchor", "window"]).join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """`mine` over the rows of `vectors` (vec_id, embedding, label), where every seventh vec_id has the label after its own and
    every hundredth is an anchor."""
    rows = labelled_vectors(vectors)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
