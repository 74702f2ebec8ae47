"""Vectors of whole numbers in tiles, queries in blocks, and the pairs of both that tasks work on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 2048  # vectors of a tile
BLOCK = 512  # queries of a block
TILE_BYTES, BLOCK_BYTES = 1 << 20, 1 << 18  # of vectors in a tile or block, where that is fewer
GROUP = 64  # tiles, or blocks, that go to one place together at most

#: Sums of whole numbers below this are exact in a double.
EXACT = float(1 << 53)

_WHOLE = float(1 << 52)  # doubles from here on are whole numbers


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles; NULL for a vector that is NULL or holds a NULL or non-finite one."""

    def whole(x: Column) -> Column:
        value = x.cast("double") * F.lit(scale)
        return F.when(F.abs(value) >= _WHOLE, value).otherwise(F.floor(value).cast("double"))

    # NaN is greater than all numbers; beyond `most`, the square of a length would not fit in a double
    bad = F.exists(vector, lambda x: x.isNull() | ~(F.abs(x.cast("double")) < float("inf")))
    most = 1e150
    bounded = F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), whole(x))))
    return F.when(~F.coalesce(bad, F.lit(True)), bounded)


def norm(vector: Column) -> Column:
    """The length of a vector."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def matrix(values: bytes, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(values, np.float64).reshape(rows, dims)


def flat(lists: pa.Array) -> np.ndarray:
    """The elements of an Arrow column of lists, one list after the other."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def block_number(rows: DataFrame) -> int:
    """Into how many blocks `rows` (dims) go."""
    queries, dims = rows.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    return max(1, -(-queries // BLOCK), -(-8 * dims // BLOCK_BYTES))


def packed(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """dims, tile, size, longest, and each of `numbers` and vector as binary: the rows of each partition (of one number of
    dimensions after the other) in pieces of bounded size. `longest` is the greatest `norm` of the piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            starts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
            for begin, end in zip(starts, [*starts[1:], len(dims)]):
                size = max(1, min(TILE, TILE_BYTES // (8 * max(1, int(dims[begin])))))
                for at in range(int(begin), int(end), size):
                    piece = batch.slice(at, min(size, int(end) - at))
                    columns = [pa.array([int(dims[at])], pa.int32()), pa.array([part + made]), pa.array([piece.num_rows], pa.int32())]
                    columns += [pa.array([piece.column("norm").to_numpy().max()])]
                    columns += [pa.array([piece.column(name).cast(pa.int64()).to_numpy().tobytes()], pa.binary()) for name in numbers]
                    columns += [pa.array([flat(piece.column("vector")).astype(np.float64).tobytes()], pa.binary())]
                    yield pa.record_batch(columns, ["dims", "tile", "size", "longest", *numbers, "vector"])
                    made += 1

    fields = ", ".join(f"{name} binary" for name in numbers)
    return rows.select("dims", "norm", *numbers, "vector").mapInArrow(pack, f"dims int, tile long, size int, longest double, {fields}, vector binary")


def places(number: int) -> int:
    """Into how many groups `number` tiles or blocks go: few of them to a group, so that there are groups for all cores, and
    `GROUP` where there are many."""
    return max(1, -(-number // min(GROUP, max(1, number // 64))))


def pairs(tiles: DataFrame, tile_number: int, blocks: DataFrame, block_number: int, worth: Column, work: Callable, schema: str) -> DataFrame:
    """`work` (a function for mapInArrow) on every pair of a row of `tiles` and one of `blocks` with the same dims, where
    `worth` holds; columns of blocks are named `q_...`.

    Groups of tiles meet groups of blocks, so a tile is sent once for a group of blocks and a block once for a group of
    tiles; a pair exists in the task that works on it only."""
    across, down = places(tile_number), places(block_number)
    columns = [F.col(name).alias(f"q_{name}") for name in blocks.columns if name != "dims"]
    left = tiles.withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(across)).cast("int"))
    left = left.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = blocks.select("dims", *columns).withColumn("h", F.pmod(F.xxhash64("q_tile"), F.lit(down)).cast("int"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    met = left.join(right.hint("shuffle_hash"), ["dims", "g", "h"]).where(worth)
    return met.drop("g", "h").mapInArrow(work, schema)


def exact_scores(rows: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray, estimates: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows and queries as 64-bit numbers: the estimates where they are `safe`, else worked out in
    numbers of any size. What does not fit in 64 bits is the greatest or least that does."""
    out = np.zeros(len(estimates), np.int64)
    out[safe] = estimates[safe].astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    for at in np.flatnonzero(~safe).tolist():
        total = sum(int(a) * int(b) for a, b in zip(rows[row[at]].tolist(), queries[query[at]].tolist()))
        out[at] = min(high, max(low, total))
    return out
