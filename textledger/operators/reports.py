"""Exports of a ledger: a text report and JSON records. Both hold failed rows and every current version."""

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger import formats
from textledger.functions.text import json_time, shown_time
from textledger.operators.versions import current_versions
from textledger.schema import LEDGER


def _current(ledger: DataFrame) -> DataFrame:
    return current_versions(ledger) if "batch_id" in ledger.columns else ledger


def text_blocks(ledger: DataFrame) -> DataFrame:
    """One report block per row: `file_path`, `file_hash`, `block`."""
    text, message = F.col("extracted_text"), F.col("error_message")
    body = (
        F.when(F.col("success") & (text != ""), text)
        .when(message.isNotNull(), F.concat(F.lit("ERROR: "), message, F.lit("\n")))
        .otherwise("")
    )
    block = F.concat(
        F.lit("FILE: "),
        F.col("file_path"),
        F.lit("\nMETHOD: "),
        F.col("extraction_method"),
        F.lit("\nSUCCESS: "),
        F.col("success").cast("string"),
        F.lit("\nTIMESTAMP: "),
        shown_time(F.col("timestamp")),
        F.lit(f"\n{formats.RULE}\n"),
        body,
        F.lit(f"\n{formats.RULE}\n\n"),
    )
    return _current(ledger).select("file_path", "file_hash", block.alias("block"))


def write_text_report(ledger: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the report under `path`: its part files in name order, put together, are the report.

    The title sorts ahead of all blocks and so opens the first part. The order is by path, then hash, in as many parts as
    `spark.sql.shuffle.partitions` says; their borders come from a scan of paths and hashes, so that texts are read once.
    `single_file` has one task write all of them in order.
    """
    spark = ledger.sparkSession
    title = spark.range(1).select(
        F.lit(0).alias("rank"),
        F.lit("").alias("file_path"),
        F.lit(None).cast("string").alias("file_hash"),
        F.lit(f"{formats.REPORT_TITLE}\n{formats.RULE}\n\n").alias("block"),
    )
    lines = title.unionByName(text_blocks(ledger).withColumn("rank", F.lit(1)))
    keys = title.drop("block").unionByName(_current(ledger.select(*_KEYS, *_versioning(ledger))).select(*_KEYS).withColumn("rank", F.lit(1)))
    number = 1 if single_file else int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash of the block breaks ties, so the order of equal paths with a NULL hash is always the same.
    order = ["rank", "file_path", "file_hash"]
    ordered = _in_ranges(lines, keys, order, number).sortWithinPartitions(*order, F.xxhash64("block"))
    # Blocks end in a line break and the writer adds one per row.
    ordered.select(F.left("block", F.length("block") - 1)).write.mode("overwrite").text(path)


_KEYS = ["file_path", "file_hash"]


def _versioning(ledger: DataFrame) -> list[str]:
    return [name for name in ["batch_id"] if name in ledger.columns]


def _in_ranges(rows: DataFrame, keys: DataFrame, order: list[str], number: int) -> DataFrame:
    """`rows` in `number` partitions that follow one another in `order`, by borders that a scan of `keys` alone finds.

    Texts are read once, and sent right to their partition. Rows with equal keys share one: a file has few versions with
    a NULL hash."""
    if number == 1:
        return rows.coalesce(1)
    ranged = keys.repartitionByRange(number, *order)
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    # one row for each partition; NULL comes first in Spark's order
    comparable = lambda rank, path, file_hash: (rank, path, file_hash is not None, file_hash or "")
    borders = sorted(comparable(*row) for row in firsts.collect())

    def find(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            found = zip(*(column.to_pylist() for column in columns))
            yield pa.array([max(0, bisect_right(borders, comparable(*row)) - 1) for row in found], pa.int32())

    part = F.arrow_udf(find, "int")(*order)
    return rows.withColumn("part", part).repartitionById(number, "part")


def json_records(ledger: DataFrame, include_text: bool = False) -> DataFrame:
    """Rows of the JSON export: the ledger's columns, its text only on request, time as RFC 3339."""
    names = [name for name in LEDGER.names if include_text or name != "extracted_text"]
    versioning = [name for name in ["batch_id"] if name in ledger.columns]
    rows = _current(ledger.select(*names, *versioning)).select(*names)
    return rows.withColumn("timestamp", json_time(F.col("timestamp")))


def write_json(ledger: DataFrame, path: str, include_text: bool = False, single_file: bool = False) -> None:
    """Write JSON lines under `path`, one object per row, NULLs spelled out; `single_file` as for the text report."""
    rows = json_records(ledger, include_text)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
