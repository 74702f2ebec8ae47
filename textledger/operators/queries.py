"""Questions to a ledger: statistics, text search, listing, run summary.

Each function takes ledger rows. If they carry `batch_id` they are a history and only current versions
count; the version test then runs on keys and the few columns asked for, never on whole texts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textledger.functions.text import contains_like, preview, shown_time
from textledger.operators.versions import current_versions


def _current(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    return current_versions(rows, ledger) if "batch_id" in ledger.columns else rows


def _versioning(ledger: DataFrame) -> list[str]:
    return [name for name in ["batch_id"] if name in ledger.columns]


def statistics(ledger: DataFrame) -> DataFrame:
    """One row: total, successful, failed, success_rate (percent, NULL if empty), avg_processing_time."""
    narrow = ledger.select(
        "file_path", "file_hash", "success", "processing_time_seconds", *_versioning(ledger)
    )
    counted = _current(narrow, ledger).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.avg(F.when(F.col("success"), F.col("processing_time_seconds"))).alias("average"),
    )
    return counted.select(
        "total",
        "successful",
        (F.col("total") - F.col("successful")).alias("failed"),
        F.try_divide(F.col("successful") * F.lit(100.0), F.col("total")).alias("success_rate"),
        F.coalesce("average", F.lit(0.0)).alias("avg_processing_time"),
    )


def search(ledger: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Successful rows whose text is `LIKE '%query%'`, newest first: path, method, preview, timestamp."""
    hits = ledger.where("success").where(contains_like(F.col("extracted_text"), query))
    shown = hits.select(
        "file_path",
        "file_hash",
        "extraction_method",
        preview(F.col("extracted_text")).alias("preview"),
        "timestamp",
        *_versioning(ledger),
    )
    return (
        _current(shown, ledger)
        .orderBy(F.desc("timestamp"), "file_path", "file_hash")
        .limit(limit)
        .select("file_path", "extraction_method", "preview", shown_time(F.col("timestamp")).alias("timestamp"))
    )


def list_files(
    ledger: DataFrame, method: str | None = None, include_failed: bool = False, ordered: bool = True
) -> DataFrame:
    """Ledger rows without their text, by path; failed ones only on request."""
    rows = ledger.select(*[name for name in ledger.columns if name != "extracted_text"])
    if method is not None:
        rows = rows.where(F.col("extraction_method") == method)
    if not include_failed:
        rows = rows.where("success")
    rows = _current(rows, ledger).withColumn("timestamp", shown_time(F.col("timestamp"))).drop("batch_id")
    # Time lets rows of one path with a NULL hash be cut into several ranges.
    return rows.orderBy("file_path", "file_hash", "timestamp") if ordered else rows


def run_summary(versions: DataFrame, batch_id: int) -> DataFrame:
    """Counts of one run: processed, successful, failed."""
    return versions.where(F.col("batch_id") == batch_id).agg(*summary_counts())


def summary_counts():
    """The run counts as aggregates, also used to observe a write as it happens."""
    return [
        F.count("*").alias("processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    ]
