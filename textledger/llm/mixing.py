"""Mixing sources to target weights by Efraimidis-Spirakis sampling within each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textledger.llm.common import sheltered, words
from textledger.sources.shared import stored, stored_for_join

#: Slices of the keys' range for each doubling of the key; only the slice in which a source's budget ends is sorted.
SLICES = 4096

SYMBOLS = r"[#*$%&|<>]"


def document_weight(text: Column) -> Column:
    """The quality weight, 0.2 to 1: documents whose characters are symbols by a tenth or more have the least."""
    size = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.2), F.lit(1.0) - F.lit(8.0) * symbols / size)


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """The exponential key -ln(u) / weight; u comes from id and text. Taking the least keys first samples by weight."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Weights repeat over the sources by code point, NULL last. A target is level * weight, or `most` times the size where
    that is less; with sources in the order of the level at which they reach it, the level follows from running sums."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    cap = F.col("source_size") * most
    rows = rows.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / share)
    # the first source that stays below its cap has the level of all after it
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "source", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Sizes and keys of documents (doc_id, source, size, key), and one row per source with what it gives:
    source, source_size, target, epochs, last_key. A document is taken `epochs` times, and once more up to last_key.

    Whole epochs come first. What is left of the target is filled in the order of the keys; the last document is taken
    if more than half of it fits. Where that ends is found from sums of slices of the key's range, and only the slice
    that it falls into is sorted, so that a source of any size is no single task's work. Rows alike in id, source and
    text share a key and are taken together or not at all."""
    text = F.coalesce("text", F.lit(""))
    weight = document_weight(text)
    thin = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        sampling_key(F.col("doc_id"), F.col("text"), weight, seed).alias("key"),
    )
    thin = stored(thin.withColumn("slice", F.floor(F.log2("key") * SLICES).cast("int")), "sizes")
    slices = thin.groupBy("source", "slice").agg(F.sum("size").alias("size"), F.max("key").alias("top"))
    slices = stored(slices, "slices")
    sources = source_targets(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", whole.cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    sources = stored(sources.withColumn("rest", rest), "sources")

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    running = Window.partitionBy("source").orderBy("slice")
    earlier = running.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("after", F.sum("size").over(running)).withColumn("before", F.col("after") - F.col("size"))
    slices = slices.withColumn("last_before", F.coalesce(F.max("top").over(earlier), F.lit(-1.0)))
    ends = slices.alias("a").join(sources.alias("b"), same).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("after")))
    ends = ends.select("a.source", "slice", "before", "rest", "last_before")
    marked = thin.alias("a").join(ends.alias("b"), same & (F.col("a.slice") == F.col("b.slice")))
    at_key = marked.groupBy("a.source", "key").agg(F.sum("size").alias("size"), F.min("before").alias("before"), F.min("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    inside = at_key.withColumn("upto", F.col("before") + upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max("key").alias("key"))
    # without a document of the slice, all of the slices before are taken
    last = ends.alias("a").join(last.alias("b"), same, "left").select(
        "a.source", F.coalesce("b.key", "last_before").alias("last_key")
    )
    sources = sources.alias("a").join(last.alias("b"), same, "left")
    # where the rest is nothing, or a source has no words, no document is taken for it
    last_key = F.when(F.col("rest") > 0, F.col("last_key")).otherwise(-1.0)
    sources = sources.select("a.source", "source_size", "target", "epochs", F.coalesce(last_key, F.lit(-1.0)).alias("last_key"))
    return thin.drop("slice"), stored_for_join(sources, "sources")[0]


def _copies() -> Column:
    return F.col("epochs") + (F.col("key") <= F.col("last_key")).cast("long")


def mix_counts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for each row of `docs`.

    A NULL text has no words; a NULL source is a source of its own; a NULL doc_id is an id like others; an empty table
    gives no rows. Other columns of `docs` are not read."""
    thin, sources = mixed(docs, **settings)
    rows = thin.join(sources.withColumnRenamed("source", "of"), thin.source.eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """The rows of `docs`, all columns whatever they are called, each as often as the mix takes it. Texts are not shuffled:
    every task works out the keys of its own rows and looks the sources up."""
    _, sources = mixed(docs, seed=seed, **settings)
    docs, restored = sheltered(docs, "doc_id", "text", "source")
    sources = sources.select(F.col("source").alias("of"), "epochs", "last_key")
    key = sampling_key(F.col("doc_id"), F.col("text"), document_weight(F.coalesce("text", F.lit(""))), seed)
    rows = docs.withColumn("key", key).join(sources, F.col("source").cast("string").eqNullSafe(F.col("of")))
    rows = rows.withColumn("copies", _copies().cast("int")).where("copies > 0")
    return restored(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
