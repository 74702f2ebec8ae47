"""Versions of ledger rows: upsert by (file_path, file_hash), current view, already-processed test.

A ledger grows by batches; a later row replaces an earlier one with the same path and hash as a whole. A NULL
hash equals nothing, so such rows neither replace nor are replaced. A changed file has a new hash and
gets a row of its own: the current view still holds every version of a file's content.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger.schema import KEY


def replaced_keys(versions: DataFrame) -> DataFrame:
    """`KEY` and `last_batch` of every key that more than one batch wrote.

    Reads keys only and keeps two numbers per key before the shuffle, so a key that very many rows share arrives as
    a few short rows. One row per key results, however often it was rewritten.
    """
    written = versions.where(F.col("file_hash").isNotNull()).groupBy(*KEY)
    spans = written.agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"))
    return spans.where("first_batch < last_batch").select(*KEY, "last_batch")


def without_replaced(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """`rows` without those of earlier batches than `replaced_keys` names; the extra join key is as in `_tested`."""
    key_hash = F.xxhash64(*KEY)
    left, right = rows.withColumn("key_hash", key_hash).alias("rows"), replaced.withColumn("key_hash", key_hash).alias("last")
    same_key = [F.col(f"rows.{name}") == F.col(f"last.{name}") for name in [*KEY, "key_hash"]]
    earlier = F.col("rows.batch_id") < F.col("last.last_batch")
    return left.join(right, [*same_key, earlier], "left_anti").select(*rows.columns)


def current_versions(rows: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Rows that no later batch replaces.

    `versions` is the full history when `rows` is only a part of it (filtered, or fewer columns): give
    `rows` cut down to what is needed, keeping `KEY` and `batch_id`, and texts stay where they are. At run
    time the adaptive planner broadcasts the replaced rows' keys if they are few.
    """
    return without_replaced(rows, replaced_keys(rows if versions is None else versions))


def one_per_key(rows: DataFrame, sequence: str | None = None) -> DataFrame:
    """One row of each key, and all rows with a NULL hash.

    Of several rows of a key the one with the greatest `sequence` stays; a NULL sequence is the lowest, and equal ones
    are told apart by the other columns in their order. Without `sequence`, several rows of a key fail the job.
    Each task keeps one row per key before the shuffle, so a hot key stays small.
    """
    rest = [name for name in rows.columns if name not in [*KEY, sequence]]
    ordered = F.struct(*([sequence] if sequence else []), *rest)
    lone = F.when(F.col("file_hash").isNull(), F.monotonically_increasing_id())
    best = rows.groupBy(*KEY, lone.alias("lone")).agg(F.max(ordered).alias("best"), F.count("*").alias("n"))
    if sequence is None:
        refused = F.raise_error(F.lit("several rows of one key; name the column that orders them as sequence"))
        best = best.where(F.when(F.col("n") > 1, refused.cast("boolean")).otherwise(True))
    return best.select(*KEY, "best.*").select(*rows.columns)


def upsert(
    versions: DataFrame, rows: DataFrame, batch_id: int, sequence: str | None = None, unique: bool = False
) -> DataFrame:
    """The history after `rows` are written as batch `batch_id`; `current_versions` reads the outcome.

    `sequence` names a column that numbers writes inside the batch (the last one wins, see `one_per_key`); without
    it a key that occurs twice in `rows` fails the job. `unique` vouches for that and spares the shuffle.
    """
    if sequence is not None or not unique:
        rows = one_per_key(rows, sequence)
    if sequence is not None:
        rows = rows.drop(sequence)
    return versions.unionByName(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")))


def _tested(files: DataFrame, versions: DataFrame, how: str) -> DataFrame:
    # Distinct before the join: a key rewritten many times counts once, and is shuffled once. The extra join
    # key gives the join a shuffle of its own after that; only then can the adaptive planner split the
    # rows of `files` if one key holds many of them.
    key_hash = F.xxhash64(*KEY)
    known = versions.where(F.col("file_hash").isNotNull()).select(*KEY).distinct().withColumn("key_hash", key_hash)
    tested = files.withColumn("key_hash", key_hash).join(known, [*KEY, "key_hash"], how)
    return tested.select(*files.columns)


def already_processed(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files whose path and hash the ledger holds, failed rows included."""
    return _tested(files, versions, "left_semi")


def pending(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files the ledger does not hold; a NULL hash is always pending."""
    return _tested(files, versions, "left_anti")
