"""The command decoders, with stand-ins for the commands: none of the real tools is installed here."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from textledger.functions.decoders import FormFeedText, form_feed_text, paged_decoder, poppler_text, python_decoder, tesseract_ocr
from textledger.operators.pages import assemble_array
from textledger.sources.files import scan_files


def decode(spark, decoder, content):
    rows = spark.createDataFrame([(bytearray(content) if content is not None else None,)], "content binary")
    return rows.select(decoder(F.col("content")).alias("d")).select("d.pages", "d.error", "d.seconds").first()


@pytest.fixture
def command(tmp_path, monkeypatch):
    """Stand-in commands by name; workers are looked up by path, as PATH of running ones cannot be changed."""
    import subprocess

    folder = tmp_path / "bin"
    folder.mkdir()

    def install(name, script):
        path = folder / name
        path.write_text("#!/bin/sh\n" + script)
        path.chmod(path.stat().st_mode | stat.S_IEXEC)

    def run(args, **options):
        return real(args, **{**options, "env": {**os.environ, "PATH": f"{folder}:/bin:/usr/bin"}})

    real = subprocess.run
    monkeypatch.setattr(subprocess, "run", run)
    install.folder = folder
    return install


def call(decoder_factory, content, **options):
    """Run the Python function inside a decoder in this process."""
    kept = []
    import textledger.functions.decoders as module

    original = module.python_decoder
    module.python_decoder = lambda function, failure=None: kept.append(function) or original(function, failure)
    try:
        decoder_factory(**options)
    finally:
        module.python_decoder = original
    return kept[0](content)


def test_python_decoder_reports_and_times(spark):
    def upper(content):
        if content == b"bad":
            raise ValueError("cannot read")
        if content == b"silent":
            raise KeyError()
        return [content.decode().upper(), None, "\ud800"]

    assert decode(spark, python_decoder(upper), b"ok").pages == ["OK", None, "?"]
    assert decode(spark, python_decoder(upper), b"ok").seconds >= 0
    assert decode(spark, python_decoder(upper), b"bad").error == "cannot read"
    assert decode(spark, python_decoder(upper), b"silent").error == "KeyError"
    assert decode(spark, python_decoder(upper, "fixed"), b"bad").error == "fixed"
    assert tuple(decode(spark, python_decoder(upper), None)) == (None, None, None)


def test_text_command_pages(spark, command):
    command("pdftotext", r"""printf 'one\f\ftwo\f'""")
    assert call(poppler_text, b"%PDF") == ["one", "", "two"]
    command("pdftotext", "exit 1")
    with pytest.raises(Exception):
        call(poppler_text, b"%PDF")
    command("pdftotext", r"""printf '%s\f' "$*" """)
    assert call(poppler_text, b"%PDF", raw=True)[0].startswith("-raw -enc UTF-8 ")


def test_text_command_missing_is_a_load_failure(spark):
    assert decode(spark, poppler_text(), b"%PDF").error == "Failed to load PDF document"


def test_ocr_pages_in_name_order_and_failed_ones_skipped(spark, command):
    command("pdftoppm", """[ "$1" = -png ] && grep -q PDF "$2" && for n in 10 02 01; do echo $n > "$3-$n.png"; done""")
    command("tesseract", """n=$(cat "$1"); [ $n = 02 ] && exit 1; echo "page $n: $*" | sed "s#$1#image#" """)
    assert call(tesseract_ocr, b"%PDF") == ["page 01: image stdout -l eng\n", None, "page 10: image stdout -l eng\n"]
    gpu = "page 01: image stdout -l eng --oem 1 --psm 3 -c use_opencl=1\n"
    assert call(tesseract_ocr, b"%PDF", use_gpu=True)[0] == gpu


def test_ocr_failures(spark, command):
    command("pdftoppm", "echo Syntax Error >&2; exit 3")
    with pytest.raises(RuntimeError, match="^pdftoppm failed: Syntax Error\n$"):
        call(tesseract_ocr, b"x")
    command("pdftoppm", "exit 0")
    with pytest.raises(RuntimeError, match="^No images generated from PDF$"):
        call(tesseract_ocr, b"x")
    command("pdftoppm", """echo 1 > "$3-1.png" """)
    command("tesseract", "exit 1")
    assert call(tesseract_ocr, b"x") == [None]


def test_ocr_command_missing(spark):
    assert decode(spark, tesseract_ocr(), b"%PDF").error == "Failed to run pdftoppm"


def test_error_messages_may_hold_lone_surrogates(spark):
    def decode(content):
        raise ValueError("cannot open \udcff.pdf")

    rows = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    assert rows.select(python_decoder(decode)(rows.content).alias("out")).first().out.error == "cannot open ?.pdf"


def outcomes(frame, *columns):
    return {os.path.basename(row[0]): tuple(row[1:]) for row in frame.select("path", *columns).collect()}


TEXTS = {
    "one": "no separator", "edges": "\fa\f\fb\f", "letters": "é\f漢字😀\f \fß" * 3, "only": "\f\f\f", "blank": " \n ", "long": "x" * 50 + "\f" + "é" * 40,
    "one letter": "😀", "lines": "a\nb\f--- Page 2 ---\nc",
}
BROKEN = {"start": b"\x80abc\fd", "lead": b"abc\xe9", "amid": b"ab\xff\fcd", "long run": b"a" + b"\x80" * 9, "cut": "漢".encode()[:2] + b"\f", "half": b"\xed\xa0\x80"}


@pytest.fixture(scope="module")
def ranges(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ranges")
    for name, text in TEXTS.items():
        (folder / f"{name}.pdf").write_bytes(text.encode())
    for name, content in BROKEN.items():
        (folder / f"{name} broken.pdf").write_bytes(content)
    return scan_files(spark, str(folder)).cache()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 16, 1000])
def test_every_cut_of_a_text_gives_the_text_in_one_piece(spark, ranges, size):
    whole = ranges.select("path", form_feed_text.of_files(F.col("path")).alias("d"))
    expected = outcomes(whole, assemble_array(F.col("d.pages")), F.when(F.col("d.error").isNull(), F.size("d.pages")), "d.error")
    decoder = FormFeedText(range_bytes=size)
    assert outcomes(decoder.spread(ranges), "text", "pages", "error") == expected
    assert sum(error is not None for _, _, error in expected.values()) == len(BROKEN)
    counted = decoder.count_pages(ranges)
    assert outcomes(counted, "pages", "error") == {name: row[1:] for name, row in expected.items()}
    plain = ranges.select("path", form_feed_text.of_files(F.col("path")).alias("d")).select("path", F.array_join("d.pages", "").alias("text"))
    if size in (1, 4):
        assert outcomes(decoder.spread(ranges, labelled=False), "text") == outcomes(plain, "text")


def test_bytes_and_files_and_natives_agree(spark, ranges):
    rows = [(name, bytearray(open(path.removeprefix("file:"), "rb").read())) for path in [row.path for row in ranges.collect()] for name in [path]]
    table = spark.createDataFrame(rows, "path string, content binary")
    native = outcomes(table.select("path", form_feed_text(F.col("content")).alias("d")), "d.pages", "d.error")
    assert native == outcomes(ranges.select("path", form_feed_text.of_files(F.col("path")).alias("d")), "d.pages", "d.error")


def test_empty_files_have_no_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"")
    files = scan_files(spark, str(tmp_path))
    assert outcomes(FormFeedText(4).count_pages(files), "pages", "error") == {"a.pdf": (None, "Failed to load PDF document")}


def pages_of(at_once):
    def count(source):
        pages = source.read().count(b"\f") + 1
        if pages == 3:
            raise ValueError("three pages")
        return 0 if pages == 2 else pages

    def decode(source, first, last):
        if first == 5:
            raise ValueError("this range only")
        source.seek(0)
        found = source.read().decode().split("\f")[first - 1 : last]
        return [None if page == "x" else page for page in found]

    return paged_decoder(count, decode, at_once)


def test_ranges_of_pages_are_the_work_of_many_tasks(spark, tmp_path):
    body = "\f".join(["x" if at == 2 else f"page {at}" for at in range(1, 101)])
    for name, text in {"long": body, "none": "a\fb", "three": "a\fb\fc", "one": "é"}.items():
        (tmp_path / f"{name}.pdf").write_bytes(text.encode())
    files, decoder = scan_files(spark, str(tmp_path)), pages_of(4)
    pages = decoder.page_rows(decoder.count_pages(files))
    assert pages.where("path LIKE '%long%'").select("task").distinct().count() > 3
    lost = {2, 5, 6, 7, 8}
    text = "".join(f"--- Page {at} (OCR) ---\npage {at}\n\n" for at in range(1, 101) if at not in lost)
    assert outcomes(decoder.spread(files, ocr=True), "text", "pages", "error") == {
        "long.pdf": (text, 100, None), "none.pdf": (None, 0, None), "three.pdf": (None, None, "three pages"), "one.pdf": ("--- Page 1 (OCR) ---\né\n\n", 1, None),
    }
    whole = files.select("path", decoder.of_files(F.col("path")).alias("d"))
    assert outcomes(whole, assemble_array(F.col("d.pages"), True))["long.pdf"] == (text,)


def test_an_open_file_for_a_decoder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"0123456789")

    def ends(source):
        source.seek(-3, 2)
        return [source.read().decode()]

    decoder = python_decoder(ends, opened=True)
    files = scan_files(spark, str(tmp_path))
    assert outcomes(files.select("path", decoder.of_files(F.col("path")).alias("d")), "d.pages") == {"a.pdf": (["789"],)}
    assert decode(spark, decoder, b"abcdef").pages == ["def"]
    missing = spark.createDataFrame([(f"file:{tmp_path}/none.pdf",)], "path string")
    assert "No such file" in missing.select(decoder.of_files(F.col("path")).alias("d")).first().d.error


def test_ranges_with_places_read_no_pages_before_them(spark, tmp_path, monkeypatch):
    import io

    from registered.fixtures import paged_marks
    from textledger.functions import decoders

    pages = [f"{at} é" + "x" * (at % 7) for at in range(1, 101)] + ["", "y" * 200_000, "last"]
    (tmp_path / "long.pdf").write_bytes("\f".join(pages).encode())
    (tmp_path / "empty.pdf").write_bytes(b"")
    files, decoder = scan_files(spark, str(tmp_path)), paged_marks(4)
    shown = [None if len(page) % 5 == 0 else "OCR " + page for page in pages]
    text = "".join(f"--- Page {at} (OCR) ---\n{page}\n\n" for at, page in enumerate(shown, start=1) if page)
    assert outcomes(decoder.spread(files, ocr=True), "text", "pages", "error") == {"long.pdf": (text, 103, None), "empty.pdf": ("", 1, None)}
    assert outcomes(files.select("path", decoder.of_files(F.col("path")).alias("d")), "d.pages")["long.pdf"] == (shown,)

    seen = []

    class Watched(io.BytesIO):
        def read(self, size=-1):
            seen.append((self.tell(), size))
            return super().read(size)

    monkeypatch.setattr(decoders, "open_file", lambda path: Watched((tmp_path / "long.pdf").read_bytes()))
    places = decoder._counted("long.pdf")["places"]
    assert all(0 < size <= 1 << 16 for _, size in seen) and len(places) == 26
    seen.clear()
    assert decoder._ranged("long.pdf", 97, 100, places[24])["pages"] == shown[96:100]
    assert [at for at, _ in seen] == [places[24]]


def test_files_of_roles_are_written_by_many_tasks(spark, tmp_path):
    from registered.fixtures import role_files

    rows = [(at % 40, at % 3, "user" if at % 4 else "system", None if at % 11 == 0 else f"é{at % 50}") for at in range(400)]
    rows += [(0, 0, "blank", ""), (0, 0, "blank", None), (1, 0, "one", "only")]
    rows += [(None, at, "tool", f"t{at}") for at in range(3)] + [(1, None, "tool", "u")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {row.path.rsplit("/", 1)[-1]: open(row.path.removeprefix("file:"), "rb").read() for row in role_files(spark, str(tmp_path)).collect()}
    least = lambda value: (value is not None, value or 0)
    for role in {row[2] for row in rows}:
        turns = sorted((least(conv), least(turn), (text or "").encode()) for conv, turn, of, text in rows if of == role)
        assert found.pop(f"{role}.pdf") == b"\f".join(text for *_, text in turns)
    assert not found
