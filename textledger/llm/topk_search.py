"""Exact top-k by inner product with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textledger.llm import tiles
from textledger.llm.tiles import EXACT, TILE, block_number, exact_scores, matrix, norm, packed, pairs
from textledger.sources.shared import stored

LEVELS = 256  # cells of a component within a tile: a byte each
HELD_BLOCKS = 256  # blocks whose best bounds a task holds before it passes them on

_OVER = 1 + 1e-9  # rounds up


def whole_numbers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, of any size; NULL for a vector that is NULL or holds a NULL or non-finite one."""
    return tiles.whole_numbers(vector, scale)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a tile's vectors (a byte for each component), and the least value and the width of a cell in each dimension."""
    low = vectors.min(axis=0)
    width = (vectors.max(axis=0) - low) / LEVELS
    with np.errstate(divide="ignore", invalid="ignore"):
        cells = np.where(width > 0, np.floor((vectors - low) / width), 0)
    return np.clip(cells, 0, LEVELS - 1).astype(np.uint8), low, width


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query (rows) and vector (columns) the inner product with the middle of the vector's cell, and for each query
    how far from that the true one can be."""
    middles = (queries * width) @ cells.astype(np.float64).T + (queries @ (low + width / 2))[:, None]
    # half a cell in each dimension, and what sums of doubles may have lost
    largest = np.maximum(np.abs(low), np.abs(low + width * LEVELS))
    lost = 1e-14 * (len(low) + 8) * np.linalg.norm(queries, axis=1) * np.linalg.norm(largest)
    return middles, np.abs(queries) @ (width / 2) * _OVER + lost


def approximations(packed_tiles: DataFrame) -> DataFrame:
    """The approximation file: cells, low and width of each tile instead of its vectors, an eighth of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tile in batch.to_pylist():
                cells, low, width = quantised(matrix(tile["vector"], tile["dims"], tile["size"]))
                found.append((cells.tobytes(), low.tobytes(), width.tobytes()))
            columns = [batch.column(name) for name in ("dims", "tile", "size", "longest", "row")]
            columns += [pa.array(values, pa.binary()) for values in zip(*found)]
            yield pa.record_batch(columns, ["dims", "tile", "size", "longest", "row", "cells", "low", "width"])

    return packed_tiles.mapInArrow(run, "dims int, tile long, size int, longest double, row binary, cells binary, low binary, width binary")


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries (row, vector, dims, norm, floor: the least score that counts) packed by blocks, and the blocks' number."""
    number = block_number(queries)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        floor = frame["floor"].to_numpy(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(frame["norm"] > 0, floor / frame["norm"], np.where(floor > 0, np.inf, -np.inf)).min()
        row = {"dims": frame["dims"].iloc[0], "tile": frame["block"].iloc[0], "size": len(frame), "least": least, "floor": floor.tobytes()}
        row |= {"row": frame["row"].to_numpy(np.int64).tobytes(), "vector": np.concatenate(frame["vector"].to_numpy()).astype(np.float64).tobytes()}
        return pd.DataFrame([row])

    rows = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)).cast("long"))
    schema = "dims int, tile long, size int, least double, floor binary, row binary, vector binary"
    return stored(rows.groupBy("dims", "block").applyInPandas(pack, schema), "blocks"), number


def _pair(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the tile, of the block, middles (-inf where a query meets its own row) and distances."""
    own, asked = np.frombuffer(row["row"], np.int64), np.frombuffer(row["q_row"], np.int64)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(row["size"], row["dims"])
    low, width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
    middles, far = bounds(cells, low, width, matrix(row["q_vector"], row["dims"], row["q_size"]))
    middles[asked[:, None] == own[None, :]] = -np.inf
    return own, asked, middles, far


def _nearest(k: int):
    """For each query the k greatest lower bounds among all tiles that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            lists = [values[values > -np.inf].tolist() for _, near in best.values() for values in near]
            asked = np.concatenate([asked for asked, _ in best.values()])
            return pa.record_batch([pa.array(asked), pa.array(lists, pa.list_(pa.float64()))], ["query", "near"])

        for batch in batches:
            for row in batch.to_pylist():
                _, asked, middles, far = _pair(row)
                near, block = middles - far[:, None], (row["dims"], row["q_tile"])
                if block in best:
                    near = np.concatenate([near, best[block][1]], axis=1)
                if near.shape[1] > k:
                    near = -np.partition(-near, k - 1, axis=1)[:, :k]
                best[block] = asked, near
                if len(best) > HELD_BLOCKS:
                    yield out()
                    best.clear()
        if best:
            yield out()

    return run


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose upper bound reaches the query's floor."""
    for batch in batches:
        for row in batch.to_pylist():
            own, asked, middles, far = _pair(row)
            most = middles + far[:, None]
            query, at = np.nonzero((most >= np.frombuffer(row["q_floor"])[:, None]) & (most > -np.inf))
            yield pa.record_batch([pa.array(asked[query]), pa.array(own[at]), pa.array(most[query, at])], ["query", "row", "most"])


def _exact(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query, vec_id, score of the pairs `found` (query, row): only their vectors are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            scores = np.zeros(len(dims), np.int64)
            for width in np.unique(dims):
                at = np.flatnonzero(dims == width)
                own, asked = (tiles.flat(batch.column(name).take(pa.array(at))).astype(np.float64).reshape(len(at), width) for name in ("vector", "asked"))
                safe = np.sqrt((own**2).sum(axis=1)) * np.sqrt((asked**2).sum(axis=1)) * _OVER < EXACT
                each = np.arange(len(at))
                scores[at] = exact_scores(own, asked, each, each, np.einsum("ij,ij->i", own, asked), safe)
            yield pa.record_batch([batch.column("query"), batch.column("vec_id"), pa.array(scores)], ["query", "vec_id", "score"])

    asked = queries.select(F.col("row").alias("query"), F.col("vector").alias("asked"), "dims")
    rows = found.select("query", "row").join(vectors.select("row", "vec_id", "vector"), "row").join(asked, "query")
    return rows.mapInArrow(run, "query long, vec_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id")))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def survivors(approximation: DataFrame, tile_number: int, queries: DataFrame, k: int) -> DataFrame:
    """query, row, most: the vectors whose upper bound is not below the kth best lower bound of the query, and that bound."""
    open_ = queries.withColumn("floor", F.lit(float("-inf")))
    blocks, number = _blocks(open_)
    near = pairs(approximation, tile_number, blocks, number, F.lit(True), _nearest(k), "query long, near array<double>")
    kth = F.get(F.sort_array(F.flatten(F.collect_list("near")), asc=False), F.lit(k - 1))
    floors = near.groupBy("query").agg(F.coalesce(kth, F.lit(float("-inf"))).alias("floor"))
    floors = stored(floors.withColumnRenamed("query", "row"), "floors")
    blocks, number = _blocks(queries.join(floors, "row"))
    # tiles whose longest vector cannot reach a block's floors are not looked at
    worth = (F.col("q_least") <= 0) | (F.col("longest") * F.lit(_OVER) >= F.col("q_least") * F.lit(1 - 1e-9))
    return pairs(approximation, tile_number, blocks, number, worth, _reaching, "query long, row long, most double")


def top_k(vectors: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` (vec_id, vector of whole numbers) with the greatest inner
    product, for each row that `asked` picks.

    The approximation file has a byte for each component: its cell within its tile. Scanning it bounds every product from
    both sides. A first scan finds for each query a score that k vectors surely reach, a second one the vectors whose upper
    bound is not below that. Of these, the ones with the greatest bounds are read exactly first, and then only those whose
    bound is not below the kth exact score: with that the result is certain. Tiles hold vectors of like norms, so that the
    second scan passes over those that cannot reach any query's floor.

    Ties go to the smaller vec_id. A query never finds its own row; other rows that repeat its vec_id are candidates. Rows
    with a NULL vec_id or vector take no part; vectors of different lengths are not compared. Of equal vectors the k + 1
    with the smallest ids are candidates, as no query can return more; that keeps groups of copies of any size small. Query
    rows that repeat each other are queries each. Scores beyond 64 bits are the greatest or least such number."""
    rows = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.coalesce(asked, F.lit(False)).alias("is_query"))
    rows = stored(rows.withColumns({"dims": F.size("vector"), "norm": norm(F.col("vector"))}), "vectors")
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row"))
    candidates = stored(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy", "is_query"), "candidates")
    queries = stored(rows.where("is_query").drop("is_query"), "queries")
    number = max(1, -(-candidates.count() // TILE))
    ranged = candidates.repartitionByRange(number, "dims", "norm", "row").sortWithinPartitions("dims", "norm", "row")
    approximation = stored(approximations(packed(ranged, ["row"])), "approximations")

    found = survivors(approximation, approximation.count(), queries, k)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "row"))
    found = stored(found, "survivors")
    first = stored(found.withColumn("place", place).where(F.col("place") <= 2 * k).drop("place"), "first")
    scored = stored(_exact(first, candidates, queries), "scored")
    kth = _best(scored, k).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    rest = found.join(first.select("query", "row"), ["query", "row"], "left_anti").join(kth, "query", "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("most") + F.abs("most") * F.lit(1e-12) >= F.col("kth")))
    scored = scored.union(_exact(rest, candidates, queries))
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return _best(scored, k).join(names, "query").select("query_id", "rank", "vec_id", "score")
