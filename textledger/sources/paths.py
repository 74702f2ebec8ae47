"""Which paths a ledger may hold: a Bloom filter of bounded size that listing tasks can ask."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per path, of which each path sets `PROBES`, and bits in all at most; beyond that more paths look known than are.
PATH_BITS, PROBES, MOST_BITS = 12, 4, 1 << 27


def path_filter(paths: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that adds to rows with `path` whether `paths` (path) may hold it, as `maybe_known`: never false for a path
    that is there, and true for about one in a hundred of the others.

    Bits are set by an aggregation of words of 64 bits; at most 16 MB of them go through the driver to the tasks."""
    spark = paths.sparkSession
    number = paths.agg(F.approx_count_distinct("path")).first()[0]
    words = 1 << max(0, (min(MOST_BITS, max(64, number * PATH_BITS)) // 64 - 1).bit_length())

    def probes(path):
        """A word and a bit in it for each probe, from the low and the high bits of a hash."""
        hashes = F.array(*[F.xxhash64(path, F.lit(at)) for at in range(PROBES)])
        return F.transform(hashes, lambda h: F.struct(h.bitwiseAND(words - 1).alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit")))

    bits = paths.select(F.explode(probes(F.col("path"))).alias("at"))
    bits = bits.select("at.word", F.expr("shiftleft(1L, at.bit)").alias("bit"))
    table = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(words, np.int64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(held)

    def ask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = shared.value
        for word, bit in batches:
            word, bit = (each.flatten().to_numpy().reshape(-1, PROBES) for each in (word, bit))
            yield pa.array((held[word] >> bit & 1).all(axis=1))

    def asked(rows: DataFrame) -> DataFrame:
        at = probes(F.col("path"))
        return rows.withColumn("maybe_known", F.arrow_udf(ask, "boolean")(at["word"], at["bit"]))

    return asked
