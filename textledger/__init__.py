"""Searchable text from document collections, as Spark jobs over a Parquet ledger."""

from textledger.functions.decoders import form_feed_text, paged_decoder, poppler_text, python_decoder, tesseract_ocr
from textledger.operators.queries import list_files, run_summary, search, statistics
from textledger.operators.reports import json_records, text_blocks, write_json, write_text_report
from textledger.plans.extraction import extract, run_extraction
from textledger.sources.files import scan_files
from textledger.sources.ledger import compact, read_dropped, read_ledger, read_versions, write_batch

__all__ = [
    "compact",
    "extract",
    "form_feed_text",
    "json_records",
    "list_files",
    "paged_decoder",
    "poppler_text",
    "python_decoder",
    "read_dropped",
    "read_ledger",
    "read_versions",
    "run_extraction",
    "run_summary",
    "scan_files",
    "search",
    "statistics",
    "tesseract_ocr",
    "text_blocks",
    "write_batch",
    "write_json",
    "write_text_report",
]
