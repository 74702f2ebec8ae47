"""Quality rules in DataFrame functions only: counts of bad signs, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textledger.llm.common import let, sheltered, words
from textledger.sources.shared import stored, stored_for_join

BUCKETS = 16_384  # of hashed words and word pairs
SMOOTHING = 131_072.0  # n-grams of the raw corpus that the trusted counts are filled up with
THRESHOLD = -0.08  # of the ratio per n-gram; below it, a text is unlike the trusted ones

SYMBOLS = r"[#*$%&|<>]"


def repeated_words(found: Column, window: int = 3) -> Column:
    """Words that stand in a window of `window` words that occurs more than once among `found`.

    Windows are compared by 64-bit hashes; sorted by hash, a repeated one has an equal neighbour. Each then covers words
    up to the next one, `window` at most."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return let(ordered, lambda rows: let(repeats(rows), lengths))

    def repeats(rows: Column) -> Column:
        alike = lambda row, at: (F.get(rows, at - 1)["h"] == row["h"]) | (F.get(rows, at + 1)["h"] == row["h"])
        return F.sort_array(F.transform(F.filter(rows, lambda row, at: F.coalesce(alike(row, at), F.lit(False))), lambda row: row["at"]))

    def lengths(places: Column) -> Column:
        reach = F.transform(places, lambda place, at: F.least(F.lit(window), F.coalesce(F.get(places, at + 1) - place, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def count(rows: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(rows) - window), lambda at: F.xxhash64(*(F.get(rows, at + i) for i in range(window))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(found) >= window, count(found)).otherwise(0).cast("long")


def base_counts(text: Column, found: Column) -> dict[str, Column]:
    """The counts of a text (not NULL) and its words."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda rows: F.size(rows) - F.size(F.array_distinct(rows))).cast("long"),
        "n_repeat_words": repeated_words(found),
    }


def buckets(found: Column, number: int = BUCKETS) -> Column:
    """Hashed buckets of all words and of all pairs of neighbouring words."""
    one = lambda word, at: F.pmod(F.xxhash64(word), F.lit(number)).cast("int")
    two = lambda word, at: F.pmod(F.xxhash64(F.get(found, at - 1), word), F.lit(number)).cast("int")
    pairs = F.when(F.size(found) > 1, F.slice(F.transform(found, two), F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))))
    return F.concat(F.transform(found, one), F.coalesce(pairs, F.array().cast("array<int>")))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, number: int = BUCKETS) -> DataFrame:
    """One row with an array: for each bucket the logarithm of its share among texts of trusted ids over that in all texts.
    The trusted counts are smoothed towards the raw shares, so that few trusted texts say little.

    Counts are over all texts, added up in the tasks first; `number` rows at most come out of the shuffle."""
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted")).distinct()
    ids, _ = stored_for_join(ids, "trusted")
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    rows = rows.select(F.col("_trusted").isNotNull().cast("long").alias("trusted"), words(F.col("text")).alias("found"))
    grams = rows.select("trusted", F.explode(buckets(F.col("found"), number)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    counts = stored(counts, "buckets")
    every = counts.sparkSession.range(number).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target")))
    sums = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))
    raw = lambda row: (row["raw"] + F.lit(1.0)) / (F.col("raws") + F.lit(float(number)))
    target = lambda row: (row["target"] + F.lit(SMOOTHING) * raw(row)) / (F.col("targets") + F.lit(SMOOTHING))
    ratio = F.transform("rows", lambda row: F.ln(target(row) / raw(row)))
    return stored(sums.select(F.when(F.col("targets") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), number)).alias("ratios")), "ratios")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, name: str = "_rules") -> DataFrame:
    """`docs` with a struct column `name`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ratio (per n-gram; NULL without words) and kept. `trusted` has the ids of the trusted texts.

    A NULL text has no words, and so fails; texts of any length are judged whole; repeated rows are judged alike. Without
    a trusted text all ratios are 0. The ratios are one array of fixed size, which a scalar subquery hands to the tasks;
    texts are not shuffled (but where ids of trusted texts are too many to be broadcast, for the count)."""
    ratios = bucket_ratios(docs, trusted).scalar()
    text = F.coalesce("text", F.lit(""))

    def verdict(found: Column) -> Column:
        total = F.aggregate(buckets(found), F.lit(0.0), lambda total, bucket: total + F.get(F.col("_ratios"), bucket))
        ratio = F.when(F.size(found) > 0, total / (F.size(found) * 2 - 1))
        counts = F.struct(*(value.alias(key) for key, value in base_counts(text, found).items()), ratio.alias("ratio"))
        return let(counts, lambda row: let(base_failed(row), lambda failed: decided(row, failed)))

    def base_failed(row: Column) -> Column:
        return (row["n_words"] < 50) | (100 * row["n_repeat_words"] > 50 * row["n_words"])

    def decided(row: Column, failed: Column) -> Column:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        kept = ~failed & (F.coalesce(row["ratio"], F.lit(0.0)) >= threshold)
        return F.struct(*(row[name].alias(name) for name in names), failed.alias("base_failed"), row["ratio"].alias("ratio"), kept.alias("kept"))

    # one expression, so that a filter on the verdict does not work it out once for each field that it takes in
    return docs.withColumn("_ratios", ratios).withColumn(name, let(words(F.col("text")), verdict)).drop("_ratios")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that are labelled good and not toxic; NULL labels trust nothing."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def quality_verdicts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the fields of `judged` for each row of `docs`."""
    return judged(docs.select("doc_id", "text"), trusted, threshold).select("doc_id", "_rules.*")


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, with their columns, whatever they are called."""
    rows, restored = sheltered(docs, "doc_id", "text")
    return restored(judged(rows, trusted, threshold).where(F.col("_rules")["kept"]))
