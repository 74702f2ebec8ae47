import glob
import json
from datetime import datetime

import pytest

from textledger.operators.reports import write_json, write_text_report
from textledger.schema import LEDGER

ROWS = [
    ("b", "2", 3, "ocr", "second\nversion", 1, 0.5, datetime(2024, 1, 2, 3, 4, 5), True, None),
    ("b", "1", 3, "direct", "text", 2, 0.5, datetime(2024, 1, 1), True, None),
    ("c", "1", 3, "ocr", "", 1, 0.5, datetime(2024, 1, 1), True, None),
    ("a", None, 0, "error", "", 0, 0.5, datetime(2024, 1, 1), False, "Direct: x, OCR: y"),
    ("Z", "1", 3, "direct_partial", "zé", 1, 0.5, datetime(2024, 1, 1), True, None),
]

RULE = "=" * 80


def block(path, method, success, time, body):
    return f"FILE: {path}\nMETHOD: {method}\nSUCCESS: {success}\nTIMESTAMP: {time}\n{RULE}\n{body}\n{RULE}\n\n"


REPORT = (
    f"PDF Text Extraction Results (Rust Edition)\n{RULE}\n\n"
    + block("Z", "direct_partial", "true", "2024-01-01 00:00:00", "zé")
    + block("a", "error", "false", "2024-01-01 00:00:00", "ERROR: Direct: x, OCR: y\n")
    + block("b", "direct", "true", "2024-01-01 00:00:00", "text")
    + block("b", "ocr", "true", "2024-01-02 03:04:05", "second\nversion")
    + block("c", "ocr", "true", "2024-01-01 00:00:00", "")
)


def parts(path):
    return [open(name, "rb").read().decode() for name in sorted(glob.glob(f"{path}/part-*"))]


@pytest.mark.parametrize("single_file", [False, True])
def test_report_byte_for_byte(spark, tmp_path, single_file):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    path = str(tmp_path / "report")
    write_text_report(ledger, path, single_file=single_file)
    assert "".join(parts(path)) == REPORT
    if single_file:
        assert len(parts(path)) == 1


def test_report_stays_in_order_over_many_parts(spark, tmp_path):
    ledger = spark.range(3000).selectExpr(
        "lpad(id, 5, '0') AS file_path", "CAST(NULL AS string) AS file_hash", "1L AS file_size", "'direct' AS extraction_method",
        "repeat('x', 50) AS extracted_text", "1 AS page_count", "0.5D AS processing_time_seconds",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS timestamp", "true AS success", "CAST(NULL AS string) AS error_message",
    )
    path = str(tmp_path / "report")
    enabled = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_text_report(ledger, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", enabled)
    found = parts(path)
    assert len(found) > 4
    assert [line for line in "".join(found).splitlines() if line.startswith("FILE")] == [f"FILE: {n:05}" for n in range(3000)]


def records(path):
    return [json.loads(line) for part in parts(path) for line in part.splitlines()]


def test_json_lines(spark, tmp_path):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    write_json(ledger, str(tmp_path / "plain"))
    write_json(ledger, str(tmp_path / "full"), include_text=True)
    full = {(r["file_path"], r["file_hash"]): r for r in records(tmp_path / "full")}
    assert list(full["a", None]) == LEDGER.names
    assert full["a", None]["error_message"] == "Direct: x, OCR: y"
    assert full["b", "2"]["timestamp"] == "2024-01-02T03:04:05Z"
    assert full["b", "2"]["error_message"] is None
    assert full["b", "2"]["extracted_text"] == "second\nversion"
    plain = records(tmp_path / "plain")
    assert len(plain) == 5 and all("extracted_text" not in r for r in plain)
