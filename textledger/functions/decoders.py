"""Decoders: documents in, pages out.

A decoder takes documents in three ways, all with the same outcome. Called on a BINARY column, it decodes bytes that are
values of a table. `of_files` takes a column of paths: the task opens the file, and its bytes never are a value of a row.
NULL gives NULL without any call into Python, which is how a run keeps costly decoders away from files that do not need
them. Where `far` says so, `spread` decodes a file in parts that different tasks work on.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textledger import formats
from textledger.operators.pages import assemble_pages
from textledger.sources.files import spread
from textledger.sources.shared import stored, stored_for_join
from textledger.sources.stores import open_file, read_range

# pages: text by page, in page order, NULL for a page that failed; error: why the file failed as a whole.
DECODED = "struct<pages: array<string>, error: string, seconds: double>"

_DECODED = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string()), ("seconds", pa.float64())])

#: What `spread` gives for each file.
SPREAD = "path string, text string, pages int, error string, seconds double"


def _utf8(text: str | None) -> str | None:
    return text if text is None else text.encode("utf-8", "replace").decode()


def _attempt(work: Callable, failure: str | None) -> tuple:
    """What `work` returns, the error of the file, and seconds."""
    from time import perf_counter

    started = perf_counter()
    out, error = None, None
    try:
        out = work()
    except Exception as caught:
        error = _utf8(failure or str(caught) or type(caught).__name__)
    return out, error, perf_counter() - started


def _decoded(work: Callable, failure: str | None) -> dict:
    pages, error, seconds = _attempt(lambda: [_utf8(page) for page in work()], failure)
    return {"pages": pages, "error": error, "seconds": seconds}


def _row_udf(one: Callable) -> Callable[[Column], Column]:
    """`one` on each value that is not NULL."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # row by row, so that the pages of few documents are held at a time
            found = [pa.array([one(item.as_py()) if item.is_valid else None], _DECODED) for item in batch]
            yield pa.concat_arrays(found) if found else pa.array([], _DECODED)

    # Times differ between calls, and the optimizer must not run a decoder twice for one row.
    return F.arrow_udf(run, DECODED).asNondeterministic()


class Decoder:
    """A decoder of whole documents, around a Python function from bytes, or an open file, to a list of page texts."""

    def __init__(self, decode: Callable, failure: str | None = None, opened: bool = False):
        def of_bytes(content: bytes) -> dict:
            import io

            return _decoded(lambda: decode(io.BytesIO(content) if opened else content), failure)

        def of_file(path: str) -> dict:
            def work():
                with open_file(path) as source:
                    return decode(source if opened else source.read())

            return _decoded(work, failure)

        self._of_bytes, self._of_file = of_bytes, of_file

    def __call__(self, content: Column) -> Column:
        return _row_udf(self._of_bytes)(content)

    def of_files(self, path: Column) -> Column:
        return _row_udf(self._of_file)(path)

    def far(self, length: Column) -> Column:
        """Whether a file of this length is decoded in parts."""
        return F.lit(False)

    def spread(self, files: DataFrame, ocr: bool = False, labelled: bool = True) -> DataFrame:
        """One row of `SPREAD` for each of `files` (path, length): the text that its pages make up."""
        raise NotImplementedError


def python_decoder(decode: Callable, failure: str | None = None, opened: bool = False) -> Decoder:
    """Decoder around a Python function from bytes to a list of page texts; `opened` hands it an open file instead.

    An exception becomes the file's error: `failure` if given, else the exception's own message. The
    function travels to the workers by value, so define it inside another function or ship its module.
    """
    return Decoder(decode, failure, opened)


class FormFeedText(Decoder):
    """Decoder for UTF-8 text whose pages are separated by form feeds.

    On a column it runs without Python. Files of more than `range_bytes` are cut into ranges of so many bytes, which tasks
    read and check each by itself; pages are numbered by sums of the separators before them, and the pieces of a page that
    a border cuts are put together again. Text that is not UTF-8, or empty, fails as a whole.
    """

    def __init__(self, range_bytes: int = 32 * 1024 * 1024):
        self.range_bytes = range_bytes
        super().__init__(_form_feed_pages, formats.LOAD_FAILED)

    def __call__(self, content: Column) -> Column:
        text = F.try_validate_utf8(F.when(F.octet_length(content) > 0, content).cast("string"))
        decoded = F.struct(
            F.split(text, "\f").alias("pages"),
            F.when(text.isNull(), F.lit(formats.LOAD_FAILED)).alias("error"),
            F.lit(0.0).alias("seconds"),
        )
        return F.when(content.isNotNull(), decoded)

    def far(self, length: Column) -> Column:
        return length > self.range_bytes

    def _ranges(self, files: DataFrame) -> DataFrame:
        """path, part, size of the ranges of each file."""
        last = F.greatest(F.lit(0), F.expr(f"(length - 1) div {self.range_bytes}"))
        return files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).withColumn("size", F.lit(self.range_bytes))

    def pieces(self, files: DataFrame, texts: bool = True) -> DataFrame:
        """path, part, piece, pieces, seconds, text: what form feeds cut each range into. A range that is not UTF-8 has a
        single piece with a NULL number of pieces. Without `texts` there is one row for each range, as its first piece.

        A letter that a border cuts belongs to the range that it begins in; as every task finds the same place, each byte
        is looked at once."""
        size, kind = self.range_bytes, "path string, part long, piece long, pieces long, seconds double, text string"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist()):
                    found, _, seconds = _attempt(lambda: _range_pages(path, part * size, size), None)
                    shown = found if found is not None and texts else [None]
                    pieces = None if found is None else len(found)
                    columns = [[path] * len(shown), [part] * len(shown), range(len(shown)), [pieces] * len(shown)]
                    columns = [pa.array(values, each) for values, each in zip(columns, (pa.string(), *[pa.int64()] * 3))]
                    columns += [pa.array([seconds] + [0.0] * (len(shown) - 1)), pa.array(shown, pa.string())]
                    yield pa.record_batch(columns, ["path", "part", "piece", "pieces", "seconds", "text"])

        ranges = stored(self._ranges(files), "ranges")
        return spread(ranges, "path", "part", weight="size").select("path", "part").mapInArrow(read, kind)

    def _summed(self, firsts: DataFrame) -> DataFrame:
        """path, pages, error, seconds of each file from the first pieces of its ranges."""
        sums = firsts.groupBy("path").agg(
            (F.sum(F.col("pieces") - 1) + 1).alias("pages"), F.max(F.col("pieces").isNull()).alias("bad"), F.sum("seconds").alias("seconds")
        )
        error = F.when(F.col("bad"), F.lit(formats.LOAD_FAILED))
        return sums.select("path", F.when(~F.col("bad"), F.col("pages")).cast("int").alias("pages"), error.alias("error"), "seconds")

    def count_pages(self, files: DataFrame) -> DataFrame:
        """path, pages, error of each of `files` (path, length), of any size; no text leaves its task."""
        empty = files.where("length = 0").select("path", F.lit(None).cast("int").alias("pages"), F.lit(formats.LOAD_FAILED).alias("error"))
        return self._summed(self.pieces(files.where("length > 0"), texts=False)).drop("seconds").unionByName(empty)

    def spread(self, files: DataFrame, ocr: bool = False, labelled: bool = True) -> DataFrame:
        pieces = stored(self.pieces(files), "pieces")
        firsts = pieces.where("piece = 0").select("path", "part", "pieces", "seconds")
        summed = self._summed(firsts)
        before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = firsts.select("path", "part", F.coalesce(F.sum(F.col("pieces") - 1).over(before), F.lit(0)).alias("before"))
        offsets = offsets.join(summed.where("error IS NULL").select("path", F.col("pages").alias("total")), "path")
        # the first page of all and the last one are cut on one side only
        offsets, _ = stored_for_join(offsets, "offsets")
        rows = pieces.join(offsets, ["path", "part"]).withColumn("page_num", F.col("before") + F.col("piece") + 1)
        cut = ((F.col("piece") == 0) & (F.col("part") > 0)) | (F.col("piece") == F.col("pieces") - 1)
        ordered = F.array_sort(F.collect_list(F.struct("part", "text")))["text"]
        met = rows.where(cut).groupBy("path", "page_num").agg(F.array_join(ordered, "").alias("page_text"))
        pages = rows.where(~cut).select("path", "page_num", F.col("text").alias("page_text")).unionByName(met)
        texts = assemble_pages(pages, "path", ocr, labelled=labelled).select("path", "text")
        return texts.join(summed, "path", "right").select("path", "text", "pages", "error", "seconds")


def _form_feed_pages(content: bytes) -> list[str]:
    if not content:
        raise ValueError(formats.LOAD_FAILED)
    return content.decode("utf-8").split("\f")


def _range_pages(path: str, start: int, size: int) -> list[str]:
    """Text between form feeds of the letters that begin in a range of a file; raises where it is not UTF-8."""

    def inside(data: bytes) -> int:
        """Bytes at the start that go on with a letter, which no letter has more than three of."""
        return next((at for at, byte in enumerate(data[:3]) if byte & 0xC0 != 0x80), len(data[:3]))

    with open_file(path) as source:
        data = read_range(source, start, size + 3)
    begin = inside(data) if start else 0
    end = size + inside(data[size:])
    return data[begin:end].decode("utf-8").split("\f")


#: Native decoder for UTF-8 text whose pages are separated by form feeds.
form_feed_text = FormFeedText()


class PagedDecoder(Decoder):
    """Decoder whose pages can be decoded by themselves, such as OCR: a range of pages is the unit of work.

    `count` takes an open file and gives its number of pages; what it raises is the file's error. `decode` takes an open
    file, a first and a last page (from 1) and gives their texts, None for a page that failed; what it raises costs the
    pages of that range only. Ranges of `at_once` pages are dealt out to tasks, so that one long document is the work of
    many, and pages meet as rows.

    Where pages are only found by reading on, `count` gives a pair: the number of pages, and the byte at which each range
    of `at_once` pages begins. `decode` then takes that byte as a fourth argument, so that no range reads those before it.
    """

    def __init__(self, count: Callable, decode: Callable, at_once: int = 4, failure: str | None = None):
        def located(source) -> tuple[int, list[int] | None]:
            """Number of pages, and places of the ranges if there are any."""
            found = count(source)
            return found if isinstance(found, tuple) else (found, None)

        def whole(source) -> list[str | None]:
            pages, places = located(source)
            firsts = range(1, pages + 1, at_once)
            return [page for at, first in enumerate(firsts) for page in part(source, first, min(pages, first + at_once - 1), places and places[at])]

        def part(source, first: int, last: int, place: int | None) -> list[str | None]:
            """The range's texts, as many as it has pages."""
            where = (first, last) if place is None else (first, last, place)
            found = _attempt(lambda: [_utf8(page) for page in decode(source, *where)], None)[0] or []
            return (found + [None] * (last - first + 1))[: last - first + 1]

        def counted(path: str) -> dict:
            def work():
                with open_file(path) as source:
                    return located(source)

            found, error, seconds = _attempt(work, failure)
            pages, places = found or (None, None)
            return {"pages": pages, "error": error, "seconds": seconds, "places": places}

        def ranged(path: str, first: int, last: int, place: int | None) -> dict:
            def work():
                with open_file(path) as source:
                    return part(source, first, last, place)

            pages, _, seconds = _attempt(work, None)
            return {"pages": pages or [None] * (last - first + 1), "seconds": seconds}

        super().__init__(whole, failure, opened=True)
        self._counted, self._ranged, self.at_once = counted, ranged, at_once

    def far(self, length: Column) -> Column:
        return F.lit(True)

    def count_pages(self, files: DataFrame) -> DataFrame:
        """path, pages, error, seconds of each of `files` (path, length), and places of ranges where `count` gives them."""
        kind = pa.struct([("pages", pa.int64()), ("error", pa.string()), ("seconds", pa.float64()), ("places", pa.list_(pa.int64()))])
        one = self._counted

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([one(path) for path in batch.to_pylist()], kind)

        udf = F.arrow_udf(run, "struct<pages: long, error: string, seconds: double, places: array<long>>").asNondeterministic()
        return stored(spread(files).select("path", udf("path").alias("counted")).select("path", "counted.*"), "counted")

    def page_rows(self, files: DataFrame) -> DataFrame:
        """path, page_num, page_text, seconds (of its range, on the first page of it), task: the pages of `files` (path,
        pages, places), each range decoded by itself."""
        kind, one = pa.struct([("pages", pa.list_(pa.string())), ("seconds", pa.float64())]), self._ranged

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                rows = zip(*(column.to_pylist() for column in columns))
                yield pa.concat_arrays([pa.array([one(*row)], kind) for row in rows])

        udf = F.arrow_udf(run, "struct<pages: array<string>, seconds: double>").asNondeterministic()
        first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages"), F.lit(self.at_once).cast("long"))).alias("first")
        ranges = files.where("pages > 0").select("path", "pages", "places", first)
        place = F.get("places", ((F.col("first") - 1) / self.at_once).cast("int"))
        ranges = ranges.withColumns({"last": F.least(F.col("first") + self.at_once - 1, "pages"), "place": place, "length": F.lit(0)}).drop("places")
        dealt = spread(stored(ranges, "ranges"), "path", "first")
        done = dealt.select("path", "first", udf("path", "first", "last", "place").alias("done"), F.spark_partition_id().alias("task"))
        rows = done.select("path", "first", "task", "done.seconds", F.posexplode("done.pages").alias("at", "page_text"))
        seconds = F.when(F.col("at") == 0, F.col("seconds")).otherwise(0.0).alias("seconds")
        return rows.select("path", (F.col("first") + F.col("at")).alias("page_num"), "page_text", seconds, "task")

    def spread(self, files: DataFrame, ocr: bool = False, labelled: bool = True) -> DataFrame:
        counted = self.count_pages(files)
        pages = stored(self.page_rows(counted), "pages")
        texts = assemble_pages(pages, "path", ocr, labelled=labelled).select("path", "text")
        spent = pages.groupBy("path").agg(F.sum("seconds").alias("spent"))
        rows = counted.join(texts, "path", "left").join(spent, "path", "left")
        seconds = F.col("seconds") + F.coalesce("spent", F.lit(0.0))
        return rows.select("path", "text", F.col("pages").cast("int").alias("pages"), "error", seconds.alias("seconds"))


def paged_decoder(count: Callable, decode: Callable, at_once: int = 4, failure: str | None = None) -> PagedDecoder:
    """Decoder that tasks apply to ranges of `at_once` pages; see `PagedDecoder`."""
    return PagedDecoder(count, decode, at_once, failure)


def poppler_text(raw: bool = False) -> Decoder:
    """PDF text by the `pdftotext` command on the workers; `raw` keeps content-stream order."""
    flags = ["-raw"] if raw else []

    def decode(content):
        import subprocess
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".pdf") as source:
            source.write(content)
            source.flush()
            done = subprocess.run(
                ["pdftotext", *flags, "-enc", "UTF-8", source.name, "-"], capture_output=True, check=True
            )
        pages = done.stdout.decode("utf-8", "replace").split("\f")
        return pages[:-1] if pages[-1] == "" else pages

    return python_decoder(decode, formats.LOAD_FAILED)


def tesseract_ocr(use_gpu: bool = False) -> Decoder:
    """OCR by the `pdftoppm` and `tesseract` commands on the workers, one image per page, English."""
    not_run, failed, no_images = formats.RENDER_NOT_RUN, formats.RENDER_FAILED, formats.NO_IMAGES
    gpu_flags = ["--oem", "1", "--psm", "3", "-c", "use_opencl=1"] if use_gpu else []

    def decode(content):
        import pathlib
        import subprocess
        import tempfile

        # Scratch of one call on one worker; the tools exchange page images through files.
        with tempfile.TemporaryDirectory() as scratch:
            source = pathlib.Path(scratch, "source.pdf")
            source.write_bytes(content)
            try:
                render = subprocess.run(
                    ["pdftoppm", "-png", str(source), str(pathlib.Path(scratch, "page"))], capture_output=True
                )
            except OSError as caught:
                raise RuntimeError(not_run) from caught
            if render.returncode:
                raise RuntimeError(failed + render.stderr.decode("utf-8", "replace"))
            images = sorted(pathlib.Path(scratch).glob("*.png"))
            if not images:
                raise RuntimeError(no_images)

            def read(image):
                try:
                    done = subprocess.run(
                        ["tesseract", str(image), "stdout", "-l", "eng", *gpu_flags],
                        capture_output=True,
                        check=True,
                    )
                except (OSError, subprocess.CalledProcessError):
                    return None
                return done.stdout.decode("utf-8", "replace")

            return [read(image) for image in images]

    return python_decoder(decode)
