"""Every row of the decision table, with decoders that fail, find nothing, or find text."""

import pytest

from textledger.functions.decoders import form_feed_text, python_decoder
from textledger.plans.extraction import extract
from textledger.schema import FILES

LONG, SHORT = "direct text that is long enough to stand on its own", "short"
DISABLED = "OCR disabled (text-only mode)"


def labelled(text, mark=""):
    return f"--- Page 1{mark} ---\n{text}\n\n"


def ocr(outcome):
    def decode(content):
        if outcome == "raises":
            raise RuntimeError("pdftoppm failed: bad file")
        return {"text": ["scan"], "blank pages": [" ", None], "no images": []}[outcome]

    return python_decoder(decode)


def run(spark, content, outcome, **mode):
    files = spark.createDataFrame([("f.pdf", None, len(content), bytearray(content))], FILES)
    row = extract(files, form_feed_text, ocr=ocr(outcome), **mode).first()
    return row.extraction_method, row.extracted_text, row.page_count, row.success, row.error_message


GOOD, THIN, BROKEN = LONG.encode(), SHORT.encode(), b"\xff\xfe"
FAILED = "Failed to load PDF document"
SCAN = labelled("scan", " (OCR)")


@pytest.mark.parametrize(
    "content, outcome, mode, expected",
    [
        (GOOD, "raises", {}, ("direct", labelled(LONG), 1, True, None)),
        (THIN, "text", {}, ("ocr", SCAN, 1, True, None)),
        (THIN, "blank pages", {}, ("ocr", "", 2, True, None)),
        (THIN, "raises", {}, ("direct_partial", labelled(SHORT), 1, True, None)),
        (THIN, "no images", {}, ("direct_partial", labelled(SHORT), 1, True, None)),
        (b" \f ", "raises", {}, ("direct_partial", "", 2, True, None)),
        (BROKEN, "text", {}, ("ocr", SCAN, 1, True, None)),
        (BROKEN, "raises", {}, ("error", "", 0, False, f"Direct: {FAILED}, OCR: pdftoppm failed: bad file")),
        (BROKEN, "no images", {}, ("error", "", 0, False, f"Direct: {FAILED}, OCR: No images generated from PDF")),
        (b"", "no images", {}, ("error", "", 0, False, f"Direct: {FAILED}, OCR: No images generated from PDF")),
        (GOOD, "text", {"ocr_only": True}, ("ocr", SCAN, 1, True, None)),
        (GOOD, "raises", {"ocr_only": True}, ("error", "", 0, False, "OCR failed: pdftoppm failed: bad file")),
        (GOOD, "text", {"text_only": True}, ("direct", labelled(LONG), 1, True, None)),
        (THIN, "text", {"text_only": True}, ("direct_partial", labelled(SHORT), 1, True, None)),
        (BROKEN, "text", {"text_only": True}, ("error", "", 0, False, f"Direct: {FAILED}, OCR: {DISABLED}")),
        (GOOD, "text", {"text_only": True, "ocr_only": True}, ("error", "", 0, False, f"OCR failed: {DISABLED}")),
    ],
)
def test_decision_table(spark, content, outcome, mode, expected):
    assert run(spark, content, outcome, **mode) == expected


def test_a_row_without_content_is_an_error_row(spark):
    files = spark.createDataFrame([("f.pdf", None, 3_000_000_000, None)], FILES)
    row = extract(files, form_feed_text, ocr=ocr("text")).first()
    assert (row.extraction_method, row.file_hash, row.file_size, row.success) == ("error", None, 3_000_000_000, False)
    assert row.error_message.startswith("Direct: The row holds no content, OCR: The row")


def test_alternative_text_has_no_labels_and_keeps_the_page_count(spark):
    def decode(content):
        return ["alternative text " * 4]

    files = spark.createDataFrame([("f.pdf", None, 9, bytearray(b"a" * 9 + b"\f \f" + b"b" * 9))], FILES)
    row = extract(files, form_feed_text, alternative=python_decoder(decode), ocr=ocr("raises")).first()
    # With their labels the two pages make exactly 50 bytes: not short, not substantial.
    text = f"--- Page 1 ---\n{'a' * 9}\n\n--- Page 3 ---\n{'b' * 9}\n\n"
    assert (row.extraction_method, row.extracted_text) == ("direct_partial", text)
    files = spark.createDataFrame([("f.pdf", None, 9, bytearray(b"a\f \f "))], FILES)
    row = extract(files, form_feed_text, alternative=python_decoder(decode), ocr=ocr("raises")).first()
    assert (row.extraction_method, row.extracted_text, row.page_count) == ("direct", "alternative text " * 4, 3)


def test_alternative_failure_is_ignored(spark):
    def decode(content):
        raise ValueError("no")

    files = spark.createDataFrame([("f.pdf", None, 1, bytearray(b"a"))], FILES)
    row = extract(files, form_feed_text, alternative=python_decoder(decode), ocr=ocr("raises")).first()
    assert (row.extraction_method, row.error_message) == ("direct_partial", None)


def test_costly_decoders_see_only_the_files_that_need_them(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def recording(name):
        def decode(content):
            with open(seen, "ab") as calls:
                calls.write(name + b" " + content + b"\n")
            return ["x" * 60] if content == b"helped" else ["x"]

        return python_decoder(decode)

    contents = [GOOD, THIN, BROKEN, b"helped", b"y" * 40]
    files = spark.createDataFrame([(f"{n}.pdf", None, len(c), bytearray(c)) for n, c in enumerate(contents)], FILES)
    rows = extract(files, form_feed_text, alternative=recording(b"alt"), ocr=recording(b"ocr"))
    assert {r.file_path: r.extraction_method for r in rows.collect()} == {
        "0.pdf": "direct",
        "1.pdf": "ocr",
        "2.pdf": "ocr",
        "3.pdf": "direct",
        "4.pdf": "direct",
    }
    calls = sorted(open(seen, "rb").read().splitlines())
    assert calls == sorted([b"alt helped", b"alt short", b"ocr " + BROKEN, b"ocr short"])


def test_extraction_is_one_pass_without_shuffle(spark):
    files = spark.createDataFrame([("f.pdf", None, 1, bytearray(b"a"))], FILES)
    rows = extract(files, form_feed_text, alternative=ocr("text"), ocr=ocr("text"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 2
