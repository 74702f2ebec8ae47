import os
from datetime import datetime

import pytest

from textledger import form_feed_text, paged_decoder, python_decoder, read_dropped, read_ledger, read_versions, run_extraction, scan_files, search
from textledger.functions.decoders import FormFeedText
from textledger.plans import extraction
from textledger.schema import FILES
from textledger.sources.ledger import batch_ids
from textledger.sources.paths import path_filter

LONG = b"a text that is long enough to stand on its own, in one page"


def scan():
    def decode(content):
        if content == b"raise":
            raise ValueError("unreadable")
        return ["scanned " + content.decode("latin-1")]

    return python_decoder(decode)


@pytest.fixture
def folder(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"")
    (folder / "b.pdf").write_bytes(LONG)
    (folder / "sub" / "c.pdf").write_bytes(b"raise")
    (folder / "sub" / "d [1].pdf").write_bytes(b"first page\f \flast page")
    (folder / "n.txt").write_bytes(LONG)
    return folder


def run(spark, folder, ledger, **options):
    return run_extraction(spark, str(folder), ledger, direct=form_feed_text, alternative=scan(), ocr=scan(), **options)


def outcome(spark, ledger):
    return {os.path.basename(r.file_path): r for r in read_ledger(spark, ledger).collect()}


def test_runs_skip_what_is_done(spark, folder, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert run(spark, folder, ledger, loaded_at=datetime(2024, 1, 1)) == {"processed": 4, "successful": 4, "failed": 0}
    rows = outcome(spark, ledger)
    assert {name: row.extraction_method for name, row in rows.items()} == {
        "a.pdf": "ocr", "b.pdf": "direct", "c.pdf": "direct_partial", "d [1].pdf": "direct"}
    assert rows["d [1].pdf"].extracted_text == "--- Page 1 ---\nfirst page\n\n--- Page 3 ---\nlast page\n\n"
    assert (rows["d [1].pdf"].page_count, rows["d [1].pdf"].file_size) == (3, 22)
    assert rows["b.pdf"].file_path == f"file:{folder}/b.pdf"

    assert run(spark, folder, ledger) == {"processed": 0, "successful": 0, "failed": 0}
    # Changed, new, and new but empty.
    (folder / "sub" / "d [1].pdf").write_bytes(b"rewritten " + LONG)
    (folder / "e{x}.pdf").write_bytes(LONG)
    (folder / "sub" / "f.pdf").write_bytes(b"")
    assert run(spark, folder, ledger, loaded_at=datetime(2024, 1, 2)) == {"processed": 3, "successful": 3, "failed": 0}
    assert read_ledger(spark, ledger).count() == 7
    assert [r.file_path for r in search(read_versions(spark, ledger), "REWRITTEN").collect()] == [f"file:{folder}/sub/d [1].pdf"]

    assert run(spark, folder, ledger, force=True) == {"processed": 6, "successful": 6, "failed": 0}
    assert read_ledger(spark, ledger).count() == 7
    assert read_versions(spark, ledger).count() == 13


def test_pending_rows_of_a_table(spark):
    rows = [("a", None, 1, bytearray(b"a")), ("b", datetime(2024, 1, 1), 1, bytearray(b"b")), ("c", None, 1, bytearray(b"c"))]
    files = spark.createDataFrame(rows, FILES)
    hashed = extraction.with_fingerprint(files, full_hash=True).withColumnRenamed("path", "file_path")

    def left(held):
        return sorted(row.path for row in extraction.pending_rows(files, hashed.where(held), full_hash=True).collect())

    assert left("file_path = 'a'") == ["b", "c"]
    assert left("file_path <> 'b'") == ["b"]
    assert left("true") == []
    assert left("false") == ["a", "b", "c"]


@pytest.mark.parametrize("full_hash", [False, True])
def test_only_files_with_a_known_path_are_opened_for_the_test(spark, folder, tmp_path, full_hash):
    ledger = str(tmp_path / "ledger")
    run(spark, folder, ledger, full_hash=full_hash)
    (folder / "new.pdf").write_bytes(LONG)
    (folder / "b.pdf").write_bytes(LONG + b" changed")
    listing = scan_files(spark, str(folder))
    (folder / "new.pdf").unlink()  # opening it would show
    (folder / "sub" / "c.pdf").unlink()
    new, changed = extraction.pending_files(listing, read_versions(spark, ledger), full_hash)
    assert [os.path.basename(row.path) for row in new.collect()] == ["new.pdf"]
    assert {os.path.basename(row.path): row.problem is None for row in changed.collect()} == {"b.pdf": True, "c.pdf": False}


def test_paths_that_the_ledger_does_not_know(spark, monkeypatch):
    known = spark.range(3000).selectExpr("concat('file:/a/', id, '.pdf') AS path")
    rows = spark.range(6000).selectExpr("concat('file:/a/', id, '.pdf') AS path", "id")
    asked = path_filter(known)(rows)
    assert asked.where("id < 3000 AND NOT maybe_known").count() == 0
    assert asked.where("id >= 3000 AND maybe_known").count() < 150
    assert path_filter(known.limit(0))(rows).where("maybe_known").count() == 0
    monkeypatch.setattr("textledger.sources.paths.MOST_BITS", 64)  # full: all look known, none is lost
    assert path_filter(known)(rows).where("id < 3000 AND NOT maybe_known").count() == 0


def test_a_file_that_cannot_be_read_is_dropped_and_the_run_goes_on(spark, folder, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    for at in range(30):
        (folder / f"f{at}.pdf").write_bytes(LONG)
    listed = scan_files(spark, str(folder))
    (folder / "f7.pdf").unlink()
    (folder / "f8.pdf").unlink()
    (folder / "f8.pdf").mkdir()
    monkeypatch.setattr(extraction, "scan_files", lambda *_: listed)
    assert run(spark, folder, ledger, loaded_at=datetime(2024, 1, 1)) == {"processed": 32, "successful": 32, "failed": 0}
    dropped = {os.path.basename(row.path): row.problem for row in read_dropped(spark, ledger).collect()}
    assert set(dropped) == {"f7.pdf", "f8.pdf"} and "No such file" in dropped["f7.pdf"]
    assert batch_ids(spark, ledger) == [1] and read_ledger(spark, ledger).count() == 32
    monkeypatch.undo()
    (folder / "f8.pdf").rmdir()
    (folder / "f7.pdf").write_bytes(LONG)
    assert run(spark, folder, ledger) == {"processed": 1, "successful": 1, "failed": 0}


def test_runs_over_nothing_but_unreadable_files(spark, folder, tmp_path, monkeypatch):
    listed = scan_files(spark, str(folder)).where("path LIKE '%b.pdf'")
    (folder / "b.pdf").unlink()
    monkeypatch.setattr(extraction, "scan_files", lambda *_: listed)
    assert run(spark, folder, str(tmp_path / "ledger")) == {"processed": 0, "successful": 0, "failed": 0}
    assert read_dropped(spark, str(tmp_path / "ledger")).count() == 1
    assert read_dropped(spark, str(tmp_path / "none")).count() == 0


def test_three_runs_leave_one_row_of_a_large_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "sparse.pdf", "wb") as file:
        file.truncate(300 << 20)
    ledger, size = str(tmp_path / "ledger"), python_decoder(lambda source: [f"{source.seek(0, 2)} bytes in all, which nobody holds at a time"], opened=True)
    for force in (False, False, True):
        run_extraction(spark, str(tmp_path / "in"), ledger, direct=size, full_hash=True, force=force)
    assert [(row.file_size, len(row.file_hash), "314572800 bytes" in row.extracted_text) for row in read_ledger(spark, ledger).collect()] == [(300 << 20, 64, True)]
    assert read_versions(spark, ledger).count() == 2


def test_hidden_names_are_documents(spark, folder, tmp_path):
    (folder / ".d").mkdir()
    for name in ("_i.pdf", ".j.pdf", ".d/x.pdf"):
        (folder / name).write_bytes(LONG)
    assert run(spark, folder, str(tmp_path / "ledger"))["processed"] == 7


def test_no_content_in_the_plan_of_a_run(spark, folder):
    rows = extraction.with_file_hash(scan_files(spark, str(folder))).drop("problem")
    plan = extraction.extract(rows, form_feed_text, alternative=scan(), ocr=scan())._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Exchange" not in plan and "binary" not in plan


def paged():
    return paged_decoder(lambda source: 3, lambda source, first, last: [f"scan {at} of a page that nobody could read otherwise" for at in range(first, last + 1)], 1)


def test_parts_of_files_in_a_run(spark, folder, tmp_path):
    """Large texts by ranges of bytes and OCR by ranges of pages give the rows that one piece gives."""
    (folder / "big.pdf").write_bytes("\f".join(f"é page {at}" for at in range(200)).encode())
    (folder / "big blank.pdf").write_bytes(b" \f" * 300)
    (folder / "big broken.pdf").write_bytes(b"x" * 300 + b"\xff")
    found = []
    for direct in (FormFeedText(100), form_feed_text):
        for mode in ({}, {"text_only": True}, {"ocr_only": True}):
            ledger = str(tmp_path / f"ledger{len(found)}")
            run_extraction(spark, str(folder), ledger, direct=direct, alternative=direct, ocr=paged(), **mode)
            rows = read_ledger(spark, ledger).drop("timestamp", "processing_time_seconds").collect()
            found.append(sorted(map(tuple, rows)))
            assert read_ledger(spark, ledger).where("processing_time_seconds IS NULL").count() == 0
    assert found[:3] == found[3:]
    methods = {os.path.basename(row[0]): row[3] for row in found[0]}
    assert methods == {"a.pdf": "ocr", "b.pdf": "direct", "c.pdf": "ocr", "d [1].pdf": "direct", "big.pdf": "direct", "big blank.pdf": "ocr", "big broken.pdf": "ocr"}


def test_modes_and_failures(spark, folder, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert run(spark, folder, ledger, ocr_only=True) == {"processed": 4, "successful": 3, "failed": 1}
    assert outcome(spark, ledger)["c.pdf"].error_message == "OCR failed: unreadable"
    # A failed file counts as processed.
    assert run(spark, folder, ledger, text_only=True)["processed"] == 0
    assert run(spark, folder, ledger, text_only=True, force=True) == {"processed": 4, "successful": 3, "failed": 1}
    assert outcome(spark, ledger)["a.pdf"].error_message == "Direct: Failed to load PDF document, OCR: OCR disabled (text-only mode)"


def test_no_documents_no_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path / "in", str(tmp_path / "ledger"))["processed"] == 0
    assert not (tmp_path / "ledger").exists()


def test_large_files_pass_through_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ["a", "b", "c"]:
        (tmp_path / "in" / f"{name}.pdf").write_bytes(b"\xff" * 40_000_000)

    def measure(content):
        return [f"{len(content)} bytes"]

    ledger = str(tmp_path / "ledger")
    run_extraction(spark, str(tmp_path / "in"), ledger, direct=form_feed_text, ocr=python_decoder(measure))
    assert {r.extracted_text for r in read_ledger(spark, ledger).collect()} == {"--- Page 1 (OCR) ---\n40000000 bytes\n\n"}


def test_a_repeated_batch_is_rebuilt_as_a_whole(spark, folder, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert run(spark, folder, ledger, batch_id=7)["processed"] == 4
    (folder / "e.pdf").write_bytes(LONG)
    assert run(spark, folder, ledger, batch_id=7)["processed"] == 5
    assert set(outcome(spark, ledger)) == {"a.pdf", "b.pdf", "c.pdf", "d [1].pdf", "e.pdf"}
    assert read_versions(spark, ledger).count() == 5


def test_folders_inside_one_another_list_a_file_once(spark, folder, tmp_path):
    ledger = str(tmp_path / "ledger")
    both = [str(folder), f"{folder}/sub/"]
    options = dict(direct=form_feed_text, alternative=scan(), ocr=scan())
    assert run_extraction(spark, both, ledger, **options) == {"processed": 4, "successful": 4, "failed": 0}
