"""The extraction run: list, skip what is done, fingerprint, decode, decide, store."""

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textledger import formats
from textledger.functions.decoders import DECODED, Decoder, form_feed_text
from textledger.functions.fingerprint import file_fingerprint, fingerprint
from textledger.functions.text import is_short, is_substantial
from textledger.operators.cascade import cascade, stands_alone
from textledger.operators.pages import assemble_array
from textledger.operators.versions import pending
from textledger.sources.files import scan_files, spread
from textledger.sources.ledger import batch_ids, read_versions, write_batch, write_dropped
from textledger.sources.paths import path_filter
from textledger.sources.shared import stored, stored_for_join

NO_CONTENT = "The row holds no content"

_log = logging.getLogger(__name__)


def with_fingerprint(files: DataFrame, full_hash: bool = False) -> DataFrame:
    """Rows with `content`, and their `file_hash`: NULL where the content is NULL."""
    return files.withColumn("file_hash", fingerprint(full_hash))


def with_file_hash(files: DataFrame, full_hash: bool = False) -> DataFrame:
    """Listed files with `file_hash`, or why they cannot be read as `problem`; stored, so that they are read once."""
    seconds = F.unix_seconds("modificationTime")
    hashed = spread(files).withColumn("hashed", file_fingerprint(F.col("path"), F.col("length"), seconds, full_hash))
    return stored(hashed.select(*files.columns, "hashed.*"), "hashed")


def decode_candidates(
    files: DataFrame,
    direct: Decoder,
    alternative: Decoder | None = None,
    ocr: Decoder | None = None,
    text_only: bool = False,
    ocr_only: bool = False,
    full_hash: bool = False,
) -> DataFrame:
    """Candidate rows of the cascade.

    `files` either hold their bytes as `content` (then `full_hash` chooses the fingerprint), or are listed files with
    `file_hash`, which the tasks open. Each decoder sees only files that need it: the alternative one those whose direct
    text is short, OCR those whose text then is not substantial; for all others its input is NULL. That takes one pass and
    no shuffle, but for files that a decoder spreads over tasks in parts.
    """
    listed = "content" not in files.columns
    rows = (files if listed else with_fingerprint(files, full_hash)).withColumnRenamed("path", "file_path")
    source = F.col("file_path") if listed else F.col("content")
    missing = F.lit(None).cast("string") if listed else F.when(F.col("content").isNull(), F.lit(NO_CONTENT))
    direct_text, alt_text = F.col("direct_text"), F.col("alt_text")

    def run(rows: DataFrame, route: str, decoder: Decoder | None, needed: Column) -> DataFrame:
        """`rows` with text, pages, error and seconds of a route."""
        far = decoder.far(F.col("length")) if decoder and listed else F.lit(False)
        if decoder is None:
            rows = rows.withColumn("decoded", F.lit(None).cast(DECODED))
        elif listed:
            rows = rows.withColumn("decoded", decoder.of_files(F.when(needed & ~far, source)))
        else:
            rows = rows.withColumn("decoded", decoder(F.when(needed, source)))
        pages = F.col("decoded.pages")
        rows = rows.withColumns(
            {
                f"{route}_text": F.array_join(pages, "") if route == "alt" else assemble_array(pages, route == "ocr"),
                f"{route}_pages": F.size(pages),
                f"{route}_error": F.coalesce("decoded.error", missing),
                f"{route}_seconds": F.coalesce("decoded.seconds", F.lit(0.0)),
            }
        ).drop("decoded")
        # known from the listing, before anything is decoded
        if decoder is None or not listed or files.where(far).isEmpty():
            return rows
        return _with_far(rows, route, decoder, F.coalesce(needed & far, F.lit(False)))

    rows = run(rows, "direct", None if ocr_only else direct, F.lit(True))
    if ocr_only:
        rows = run(rows, "alt", None, F.lit(False))
        rows = run(rows, "ocr", None if text_only else ocr, F.lit(True))
    else:
        rows = run(rows, "alt", alternative, is_short(direct_text))
        rows = run(rows, "ocr", None if text_only else ocr, ~stands_alone(direct_text, alt_text))
    no_images = F.col("ocr_pages") == 0
    return rows.select(
        "file_path",
        "file_hash",
        F.col("length").alias("file_size"),
        "direct_text",
        "direct_pages",
        "direct_error",
        "alt_text",
        F.when(~no_images, F.col("ocr_text")).alias("ocr_text"),
        "ocr_pages",
        F.coalesce("ocr_error", F.when(no_images, F.lit(formats.NO_IMAGES))).alias("ocr_error"),
        (F.col("direct_seconds") + F.col("alt_seconds") + F.col("ocr_seconds")).alias("processing_time_seconds"),
    )


def _with_far(rows: DataFrame, route: str, decoder: Decoder, needed: Column) -> DataFrame:
    """`rows` where the files that `needed` marks have what their parts come to.

    What is decoded so far is stored, as parts are worked on in jobs of their own; only rows with such files are joined."""
    rows = stored(rows.withColumn("in_parts", needed), "decoded")
    asked = rows.where("in_parts").select(F.col("file_path").alias("path"), "length")
    if asked.isEmpty():
        return rows.drop("in_parts")
    found = decoder.spread(asked, ocr=route == "ocr", labelled=route != "alt")
    found = found.select(F.col("path").alias("file_path"), *(F.col(name).alias(f"{route}_{name}") for name in ("text", "pages", "error", "seconds")))
    met = rows.where("in_parts").drop(*(name for name in found.columns if name != "file_path")).join(found, "file_path", "left")
    return rows.where("NOT in_parts").unionByName(met.withColumn(f"{route}_seconds", F.coalesce(f"{route}_seconds", F.lit(0.0)))).drop("in_parts")


def extract(files: DataFrame, direct: Decoder, text_only: bool = False, ocr_only: bool = False, **options) -> DataFrame:
    """Ledger rows (all but `timestamp`) of `files`; options as for `decode_candidates`."""
    candidates = decode_candidates(files, direct, text_only=text_only, ocr_only=ocr_only, **options)
    return cascade(candidates, text_only=text_only, ocr_only=ocr_only)


def pending_rows(files: DataFrame, versions: DataFrame, full_hash: bool = False) -> DataFrame:
    """Rows with `content` that the ledger does not hold. The test runs on paths and hashes; content is shuffled only if the
    pending paths are too many to be broadcast."""
    hashed = with_fingerprint(files, full_hash).select(F.col("path").alias("file_path"), "file_hash")
    todo, _ = stored_for_join(pending(hashed, versions).select(F.col("file_path").alias("path")).distinct(), "pending")
    return files.join(todo, "path", "left_semi")


def pending_files(files: DataFrame, versions: DataFrame, full_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """Listed files (path, modificationTime, length) that the ledger does not hold, in two parts: those whose path it does
    not know, of which nothing is opened here, and those with another hash than it has for their path, or that cannot be
    read (with file_hash, problem).

    Tasks that hold the listing first ask a filter of the ledger's paths. Paths that it does not know are new and go
    nowhere; the others are joined with the ledger's paths, and only files with a known path are hashed."""
    known = versions.select(F.col("file_path").alias("path"))
    asked = path_filter(known)(files)
    asked = stored(asked, "asked")
    maybe = asked.where("maybe_known").drop("maybe_known")
    # hashed keys split a path with very many versions before it meets the listing
    paths = known.distinct()
    # a file that is there twice is twice new or twice known: paths of a listing are unique
    same = stored(maybe.join(paths.withColumn("is_known", F.lit(True)), "path", "left"), "paths")
    new = asked.where("NOT maybe_known").drop("maybe_known").unionByName(same.where("is_known IS NULL").drop("is_known"))
    hashed = with_file_hash(same.where("is_known").drop("is_known"), full_hash)
    changed = pending(hashed.withColumnRenamed("path", "file_path"), versions).withColumnRenamed("file_path", "path")
    return new, changed


def run_extraction(
    spark: SparkSession,
    folder: str | list[str],
    ledger_path: str,
    text_only: bool = False,
    ocr_only: bool = False,
    full_hash: bool = False,
    force: bool = False,
    direct: Decoder = form_feed_text,
    alternative: Decoder | None = None,
    ocr: Decoder | None = None,
    batch_id: int | None = None,
    loaded_at: datetime | None = None,
    suffix: str = "pdf",
) -> dict[str, int]:
    """Extract every `.suffix` file under `folder` that `ledger_path` does not hold yet (`force`: every one of them).

    A `batch_id` that the ledger holds is rebuilt as a whole: only rows of other batches count as held.

    Returns processed, successful and failed counts. Rows carry paths; tasks open the files. A file that is gone by then, or
    cannot be opened, is dropped from the run: it is logged, stays pending, and `read_dropped` has it with the reason. What
    a decoder raises is an error row.
    """
    files = scan_files(spark, folder, suffix)
    fresh, hashed = files, None
    if not force and batch_ids(spark, ledger_path):
        held = read_versions(spark, ledger_path)
        if batch_id is not None:
            held = held.where(F.col("batch_id") != batch_id)
        fresh, hashed = pending_files(files, held, full_hash)
    rows = with_file_hash(fresh, full_hash)
    if hashed is not None:
        rows = stored(rows.unionByName(hashed), "pending")
    sums = rows.agg(F.count_if(F.col("problem").isNull()), F.count("problem")).first()
    if sums[1]:
        dropped = rows.where("problem IS NOT NULL").select("path", "problem")
        write_dropped(dropped, ledger_path, loaded_at)
        _log.warning("%d of %d files cannot be read; see read_dropped", sums[1], sum(sums))
    if not sums[0]:
        return {"processed": 0, "successful": 0, "failed": 0}
    readable = spread(rows.where("problem IS NULL").drop("problem"))
    found = extract(readable, direct, alternative=alternative, ocr=ocr, text_only=text_only, ocr_only=ocr_only)
    # each path is listed once
    return write_batch(found, ledger_path, batch_id, loaded_at, unique=True)
