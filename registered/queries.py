"""Registered queries: each maps (spark, sf_dir) to a DataFrame over the given tables."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registered import fixtures
from textledger.functions.decoders import FormFeedText, form_feed_text
from textledger.functions.fingerprint import fast_fingerprint, full_fingerprint
from textledger.functions.text import is_blank, is_substantial, preview, shown_time, trimmed_bytes
from textledger.operators.cascade import OUTCOME, cascade, direct_choice
from textledger.operators.pages import assemble_pages, page_counts
from textledger.operators.queries import list_files, run_summary, search, statistics
from textledger.operators.reports import json_records, text_blocks, write_json, write_text_report
from textledger.operators.versions import already_processed, current_versions, pending, upsert
from textledger.plans.extraction import extract, pending_rows, run_extraction, with_file_hash, with_fingerprint
from textledger.schema import LEDGER, VERSIONS
from textledger.sources.files import scan_files
from textledger.sources.ledger import read_ledger, read_versions, write_batch
from textledger.sources.shared import fresh_path


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.ledger(spark, sf_dir).select(*LEDGER.names)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (rows.select(*LEDGER.names) for rows in fixtures.batches(spark, sf_dir))
    history = first.withColumn("batch_id", F.lit(1).cast("bigint"))
    return upsert(history, second, 2, unique=True).select(*VERSIONS.names)


def search_text(spark, sf_dir):
    return search(_ledger(spark, sf_dir), "the on")


def search_wildcard(spark, sf_dir):
    return search(_ledger(spark, sf_dir), "th_ ", 25)


def search_two_parts(spark, sf_dir):
    return search(_ledger(spark, sf_dir), "ocr%THE_", 25)


def search_ascii_case(spark, sf_dir):
    return search(_ledger(spark, sf_dir), "É", 1000)


def search_everything(spark, sf_dir):
    return search(_ledger(spark, sf_dir), "", 1000)


def search_versions(spark, sf_dir):
    return search(_versions(spark, sf_dir), "the on", 100)


def ledger_stats(spark, sf_dir):
    return statistics(_ledger(spark, sf_dir))


def ledger_stats_versions(spark, sf_dir):
    return statistics(_versions(spark, sf_dir))


def ledger_stats_empty(spark, sf_dir):
    return statistics(_ledger(spark, sf_dir).where("file_path < '/corpus/'"))


def list_all_successful(spark, sf_dir):
    return list_files(_ledger(spark, sf_dir))


def list_method(spark, sf_dir):
    return list_files(_ledger(spark, sf_dir), method="direct_partial")


def list_with_failed(spark, sf_dir):
    return list_files(_ledger(spark, sf_dir), include_failed=True)


def export_json_rows(spark, sf_dir):
    return json_records(_ledger(spark, sf_dir))


def export_json_rows_text(spark, sf_dir):
    return json_records(_ledger(spark, sf_dir), include_text=True)


def export_text_blocks(spark, sf_dir):
    return text_blocks(_ledger(spark, sf_dir))


def page_assembly(spark, sf_dir):
    return assemble_pages(fixtures.pages(spark, sf_dir), "file_id")


def page_assembly_ocr(spark, sf_dir):
    return assemble_pages(fixtures.pages(spark, sf_dir), "file_id", ocr=True)


def page_count(spark, sf_dir):
    return page_counts(fixtures.pages(spark, sf_dir), "file_id")


def blank_pages(spark, sf_dir):
    return fixtures.pages(spark, sf_dir).where(is_blank(F.col("page_text"))).select("file_id", "page_num")


def text_gate(spark, sf_dir):
    text = F.col("text")
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", trimmed_bytes(text).alias("trimmed_bytes"), is_substantial(text).alias("is_substantial")
    )


def text_preview(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def alt_text_choice(spark, sf_dir):
    rows = fixtures.candidates(spark, sf_dir).withColumn(
        "chosen_text", direct_choice(F.col("direct_text"), F.col("alt_text"))
    )
    return rows.select("name", "chosen_text", trimmed_bytes(F.col("chosen_text")).alias("chosen_bytes"))


def _cascade(**mode):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cascade(fixtures.candidates(spark, sf_dir), **mode).select("file_path", *OUTCOME)

    return query


def full_fingerprints(spark, sf_dir):
    return fixtures.files(spark, sf_dir).select("path", full_fingerprint().alias("file_hash"))


def fast_fingerprints(spark, sf_dir):
    return fixtures.files(spark, sf_dir).select("path", fast_fingerprint().alias("file_hash"))


def upsert_current(spark, sf_dir):
    rows = current_versions(_versions(spark, sf_dir))
    return rows.withColumn("timestamp", shown_time(F.col("timestamp")))


def upsert_sequence(spark, sf_dir):
    """The second batch writes each key three times, one of them without a number."""
    first, second = fixtures.batches(spark, sf_dir)
    number = F.explode(F.array(*map(F.lit, range(3))))
    writes = second.withColumn("n", number).withColumns(
        {
            "seq": F.expr("IF(doc_id % 3 = n, NULL, n)"),
            "extracted_text": F.concat(F.lit("write "), F.col("n").cast("string"), F.lit(" "), "extracted_text"),
        }
    )
    history = first.select(*LEDGER.names).withColumn("batch_id", F.lit(1).cast("bigint"))
    rows = current_versions(upsert(history, writes.select(*LEDGER.names, "seq"), 2, sequence="seq"))
    return rows.withColumn("timestamp", shown_time(F.col("timestamp")))


def _first_ledger_and_second_listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    first, second = fixtures.batches(spark, sf_dir)
    return first, second.select("file_path", "file_hash")


def already_processed_files(spark, sf_dir):
    held, listing = _first_ledger_and_second_listing(spark, sf_dir)
    return already_processed(listing, held)


def pending_files(spark, sf_dir):
    held, listing = _first_ledger_and_second_listing(spark, sf_dir)
    return pending(listing, held)


def summary_of_run(spark, sf_dir):
    return run_summary(_versions(spark, sf_dir), 2)


def _extract(alternative=fixtures.native_repeated_text, ocr=fixtures.native_marked_pages, **mode):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = extract(fixtures.files(spark, sf_dir), form_feed_text, alternative=alternative, ocr=ocr, **mode)
        return rows.drop("processing_time_seconds")

    return query


def extract_run(spark, sf_dir):
    """With decoders in Python; the other extract queries have native ones."""
    return _extract(fixtures.repeated_text(), fixtures.marked_pages())(spark, sf_dir)


def extract_pending(spark, sf_dir):
    """A second run over files of which every other one (by hash) is already in the ledger."""
    files = fixtures.files(spark, sf_dir)
    hashed = with_fingerprint(files, full_hash=True).withColumnRenamed("path", "file_path")
    held = hashed.where("file_hash < '8'").select("file_path", "file_hash")
    todo = pending_rows(files, held, full_hash=True)
    rows = extract(todo, form_feed_text, ocr=fixtures.native_marked_pages, full_hash=True)
    return rows.drop("processing_time_seconds")


def discovered_files(spark, sf_dir):
    """The given tables' own files, found and fingerprinted as documents are."""
    files = with_file_hash(scan_files(spark, sf_dir, suffix="parquet"))
    return files.select("path", "length", F.unix_seconds("modificationTime").alias("modified"), "file_hash")


def discovered_tree(spark, sf_dir):
    """Files under names of all kinds, in folders of all kinds, with sizes, times and both fingerprints."""
    folder = fixtures.tree(spark, sf_dir)
    files = with_file_hash(scan_files(spark, folder)).withColumnRenamed("file_hash", "fast_hash").drop("problem")
    files = with_file_hash(files, full_hash=True)
    at = F.locate(folder.rsplit("/", 1)[-1], F.col("path")) + len(folder.rsplit("/", 1)[-1]) + 1
    modified = F.unix_seconds("modificationTime").alias("modified")
    return files.select(F.substring("path", at, F.length("path")).alias("path"), "length", modified, "fast_hash", "file_hash")


def _role():
    return F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("role")


def paged_ocr(spark, sf_dir):
    """Long documents decoded by ranges of pages, in many tasks."""
    found = fixtures.paged_marks(16).spread(fixtures.role_files(spark, sf_dir), ocr=True)
    return found.select(_role(), "text", F.col("pages").alias("page_count"))


def ranged_text(spark, sf_dir):
    """Long documents decoded by ranges of bytes, which cut pages and letters."""
    found = FormFeedText(range_bytes=4099).spread(fixtures.role_files(spark, sf_dir))
    return found.select(_role(), "text", F.col("pages").alias("page_count"), "error")


def page_count_files(spark, sf_dir):
    """Pages of document files, counted by ranges of bytes."""
    return FormFeedText(range_bytes=4099).count_pages(fixtures.role_files(spark, sf_dir)).select(_role(), F.col("pages").alias("page_count"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Path of a ledger with two batches."""
    path = fresh_path(spark, "ledger")
    for day, rows in enumerate(fixtures.batches(spark, sf_dir), start=1):
        write_batch(rows, path, loaded_at=datetime(2024, 1, day))
    return path


def stored_ledger(spark, sf_dir):
    """Two batches written to storage, the current rows read back."""
    return read_ledger(spark, _stored(spark, sf_dir)).withColumn("timestamp", shown_time(F.col("timestamp")))


def stored_search(spark, sf_dir):
    return search(read_versions(spark, _stored(spark, sf_dir)), "the on", 100)


def stored_stats(spark, sf_dir):
    return statistics(read_versions(spark, _stored(spark, sf_dir)))


def stored_list(spark, sf_dir):
    return list_files(read_versions(spark, _stored(spark, sf_dir)), include_failed=True)


def run_files(spark, sf_dir):
    """Conversations as text files: one run over half of them, a second one after the others were added."""
    folder, ledger = fresh_path(spark, "in"), fresh_path(spark, "ledger")
    for day, half in enumerate(["conv_id % 2 = 0", "conv_id % 2 = 1"], start=1):
        fixtures.written(fixtures.conversation_files(spark, sf_dir).where(half), folder)
        run_extraction(
            spark, folder, ledger, suffix="txt", full_hash=True, text_only=True, loaded_at=datetime(2024, 1, day),
            direct=form_feed_text, alternative=form_feed_text,
        )
    rows = read_ledger(spark, ledger).withColumn("timestamp", shown_time(F.col("timestamp")))
    conv_id = F.regexp_extract("file_path", r"(\d+)\.txt$", 1).cast("bigint").alias("conv_id")
    return rows.select(conv_id, "file_hash", "file_size", "extraction_method", "extracted_text", "page_count", "timestamp")


def stored_report(spark, sf_dir):
    """The text report as written, by lines."""
    path = fresh_path(spark, "report")
    write_text_report(_ledger(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def stored_json(spark, sf_dir):
    """The JSON export as written."""
    path = fresh_path(spark, "json")
    rows = _ledger(spark, sf_dir)
    write_json(rows, path, include_text=True)
    return spark.read.schema(json_records(rows, include_text=True).schema).json(path)


QUERIES = {
    "search_text": search_text,
    "search_wildcard": search_wildcard,
    "search_two_parts": search_two_parts,
    "search_ascii_case": search_ascii_case,
    "search_everything": search_everything,
    "search_versions": search_versions,
    "ledger_stats": ledger_stats,
    "ledger_stats_versions": ledger_stats_versions,
    "ledger_stats_empty": ledger_stats_empty,
    "list_files": list_all_successful,
    "list_method": list_method,
    "list_with_failed": list_with_failed,
    "export_json_rows": export_json_rows,
    "export_json_rows_text": export_json_rows_text,
    "export_text_blocks": export_text_blocks,
    "page_assembly": page_assembly,
    "page_assembly_ocr": page_assembly_ocr,
    "page_count": page_count,
    "blank_pages": blank_pages,
    "text_gate": text_gate,
    "text_preview": text_preview,
    "alt_text_choice": alt_text_choice,
    "cascade_default": _cascade(),
    "cascade_text_only": _cascade(text_only=True),
    "cascade_ocr_only": _cascade(ocr_only=True),
    "cascade_both_flags": _cascade(text_only=True, ocr_only=True),
    "full_fingerprint": full_fingerprints,
    "fast_fingerprint": fast_fingerprints,
    "upsert_current": upsert_current,
    "upsert_sequence": upsert_sequence,
    "already_processed": already_processed_files,
    "pending_files": pending_files,
    "run_summary": summary_of_run,
    "extract_run": extract_run,
    "extract_text_only": _extract(text_only=True),
    "extract_ocr_only": _extract(ocr_only=True),
    "extract_pending": extract_pending,
    "stored_ledger": stored_ledger,
    "stored_search": stored_search,
    "stored_stats": stored_stats,
    "stored_list": stored_list,
    "run_files": run_files,
    "stored_report": stored_report,
    "stored_json": stored_json,
    "discovered_files": discovered_files,
    "discovered_tree": discovered_tree,
    "paged_ocr": paged_ocr,
    "ranged_text": ranged_text,
    "page_count_files": page_count_files,
}
