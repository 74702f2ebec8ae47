"""Ledgers, pages and files derived from the given tables, as DataFrames."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textledger import formats
from textledger.functions.decoders import Decoder, paged_decoder, python_decoder
from textledger.operators.cascade import cascade
from textledger.sources.files import scan_files
from textledger.sources.shared import fresh_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text, and a title page of each as a document of its own: number, name, body."""
    documents = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    texts = documents.selectExpr(*columns, "false AS is_title", "text AS body")
    titles = documents.selectExpr(*columns, "true AS is_title", "concat('Document ', source, ' ', lang) AS body")
    return texts.unionByName(titles).withColumn("name", F.expr("concat(doc_id, IF(is_title, '-title', ''))"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per entry; which routes fail follows from its number. Documents always have a text, by one route."""
    return entries(spark, sf_dir).selectExpr(
        "doc_id",
        "name",
        "concat('/corpus/', source, '/', lang, '/', name, '.pdf') AS file_path",
        "sha2(body, 256) AS file_hash",
        "n_chars AS file_size",
        "CASE WHEN doc_id % 7 <> 3 THEN body END AS direct_text",
        "CASE WHEN doc_id % 7 = 3 THEN 'Failed to load PDF document' END AS direct_error",
        "CAST(1 + doc_id % 5 AS INT) AS direct_pages",
        """CASE WHEN is_title AND doc_id % 4 = 0 THEN concat('Document ', doc_id, ' of the corpus, from ', source, ', written in language ', lang)
                WHEN is_title AND doc_id % 2 = 0 THEN source END AS alt_text""",
        "CASE WHEN NOT (is_title AND doc_id % 3 = 0) THEN concat('OCR ', body) END AS ocr_text",
        "CASE WHEN is_title AND doc_id % 3 = 0 THEN 'No images generated from PDF' END AS ocr_error",
        "CAST(1 + doc_id % 4 AS INT) AS ocr_pages",
        "CAST(n_chars AS DOUBLE) / 1024 AS processing_time_seconds",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + (doc_id % 37) * INTERVAL '1' MINUTE AS timestamp",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of one run over all documents."""
    return cascade(candidates(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs: all entries; then half of them again, one quarter unchanged, one quarter rewritten."""
    rows = ledger(spark, sf_dir).withColumn("file_path", F.expr("concat('/corpus/', name, '.pdf')"))
    unhashed = "CASE WHEN doc_id % 50 = 8 THEN NULL ELSE {} END"
    first = rows.withColumn("file_hash", F.expr(unhashed.format("file_hash")))
    second = rows.where("doc_id % 4 IN (0, 1)").withColumns(
        {
            "file_hash": F.expr(
                unhashed.format("CASE doc_id % 4 WHEN 0 THEN file_hash ELSE sha2(concat(file_hash, 'v2'), 256) END")
            ),
            "extracted_text": F.expr("concat('v2 ', extracted_text)"),
            "timestamp": F.expr("timestamp + INTERVAL '1' DAY"),
        }
    )
    return first, second


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages; every sixth page is blank."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS file_id",
        "CAST(turn + 1 AS INT) AS page_num",
        "CASE WHEN (conv_id + turn) % 6 = 5 THEN '  ' ELSE text END AS page_text",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as files that a table holds: a page per line, every seventh not valid UTF-8."""
    return entries(spark, sf_dir).selectExpr(
        "concat('/corpus/', source, '/', lang, '/', name, '.pdf') AS path",
        "timestamp_seconds(1700000000 + doc_id) AS modificationTime",
        "concat(IF(doc_id % 7 = 3, X'FF', X''), encode(replace(body, '\n', '\f'), 'UTF-8')) AS content",
    ).selectExpr("path", "modificationTime", "CAST(octet_length(content) AS BIGINT) AS length", "content")


def repeated_text() -> Decoder:
    """Stand-in for an alternative extractor: the text three times; fails on every third size."""

    def decode(content):
        if len(content) % 3 == 0:
            raise ValueError("unsupported")
        return [content.decode("utf-8").replace("\f", " ") * 3]

    return python_decoder(decode)


def marked_pages() -> Decoder:
    """Stand-in for OCR: marks each page, fails on pages of some lengths and on every fourth size."""

    def decode(content):
        if len(content) % 4 == 0:
            raise ValueError("No images generated from PDF")
        text = content.removeprefix(b"\xff").decode("utf-8")
        return [None if len(page) % 5 == 0 else "OCR " + page for page in text.split("\f")]

    return python_decoder(decode)


def _native(content: Column, fails: Column, error: str, pages: Column) -> Column:
    decoded = F.struct(F.when(~fails, pages).alias("pages"), F.when(fails, F.lit(error)).alias("error"), F.lit(0.0).alias("seconds"))
    return F.when(content.isNotNull(), decoded)


def native_repeated_text(content: Column) -> Column:
    """`repeated_text` without Python."""
    text = F.replace(content.cast("string"), F.lit("\f"), F.lit(" "))
    return _native(content, F.octet_length(content) % 3 == 0, "unsupported", F.array(F.repeat(text, 3)))


def native_marked_pages(content: Column) -> Column:
    """`marked_pages` without Python."""
    body = F.when(F.hex(F.substring(content, 1, 1)) == "FF", F.expr("substring(content, 2)")).otherwise(content)
    pages = F.split(body.cast("string"), "\f")
    marked = F.transform(pages, lambda page: F.when(F.length(page) % 5 != 0, F.concat(F.lit("OCR "), page)))
    return _native(content, F.octet_length(content) % 4 == 0, formats.NO_IMAGES, marked)


def paged_marks(at_once: int) -> Decoder:
    """Stand-in for OCR by ranges of pages: marks each page, fails on pages of some lengths. One pass over a file finds where
    its ranges begin; a range reads on from there."""
    block = 1 << 16

    def count(source):
        pages, at, places = 1, 0, [0]
        while data := source.read(block):
            place = -1
            while (place := data.find(b"\f", place + 1)) >= 0:
                if pages % at_once == 0:
                    places.append(at + place + 1)
                pages += 1
            at += len(data)
        return pages, places

    def decode(source, first, last, place):
        source.seek(place)
        wanted, found, held = last - first + 1, 0, []
        while found < wanted and (data := source.read(block)):
            found += data.count(b"\f")
            held.append(data)
        pages = [page.decode("utf-8") for page in b"".join(held).split(b"\f")[:wanted]]
        return [None if len(page) % 5 == 0 else "OCR " + page for page in pages]

    return paged_decoder(count, decode, at_once)


def local_path(folder: str) -> str:
    return re.sub("^file:(//)?", "", folder)


def written(files: DataFrame, folder: str) -> None:
    """Write `files` (name, modified in seconds, content) under a folder that all tasks share, with their times."""

    def write(batches):
        import os

        base = local_path(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = os.path.join(base, row["name"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}", "wb") as target:
                    target.write(row["content"])
                os.utime(target.name, (row["modified"], row["modified"]))
                os.replace(target.name, path)
            yield batch.select(["name"])

    files.select("name", "modified", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, and a text file of each conversation's turns, a line each, for `written`."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    lines = "array_join(transform(turns, t -> concat(coalesce(t.text, ''), '\n')), '')"
    return turns.selectExpr("conv_id", "concat('c', conv_id % 16, '/', conv_id, '.txt') AS name", "1700000000 + conv_id AS modified", f"CAST({lines} AS BINARY) AS content")


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each conversation, under names of all kinds, and files with other names beside them."""
    folder = fresh_path(spark, "tree")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("size"))
    name = """CASE conv_id % 6 WHEN 0 THEN concat('a/b c/', conv_id, '.pdf') WHEN 1 THEN concat('_b/.c/', conv_id, '.pdf')
                               WHEN 2 THEN concat('.', conv_id, '.pdf') WHEN 3 THEN concat('_', conv_id, '.pdf')
                               WHEN 4 THEN concat('k=v/empty %20+', conv_id, '.pdf') ELSE concat('d/', conv_id, '/x.y.pdf') END"""
    size = "IF(conv_id % 6 = 4, 0, size)"
    files = turns.selectExpr(f"{name} AS name", "1600000000 + conv_id AS modified", f"CAST(repeat('x', CAST({size} AS INT)) AS BINARY) AS content")
    for other in ("concat('a/', conv_id, '.PDF')", "concat('a/', conv_id, '.pdf.txt')", "concat('d/', conv_id, '/.pdf')", "concat('d/', conv_id, '/pdf')"):
        files = files.unionByName(turns.selectExpr(f"{other} AS name", "0 AS modified", "X'2E' AS content").withColumn("modified", F.col("modified").cast("long")))
    written(files, folder)
    return folder


def written_parts(parts: DataFrame, folder: str) -> None:
    """Write `parts` (name, start, content) to their places in files under a folder that all tasks share. Parts of one
    file come from any task in any order; a part that is written again changes nothing."""

    def write(batches):
        import os

        base = local_path(folder)
        os.makedirs(base, exist_ok=True)
        for batch in batches:
            targets = {}
            try:
                for name, start, content in zip(*(batch.column(each).to_pylist() for each in ("name", "start", "content"))):
                    if name not in targets:
                        targets[name] = os.open(os.path.join(base, name), os.O_WRONLY | os.O_CREAT, 0o644)
                    while content:
                        done = os.pwrite(targets[name], content, start)
                        start, content = start + done, content[done:]
            finally:
                for target in targets.values():
                    os.utime(target, (0, 0))
                    os.close(target)
            yield batch.select(["name"])

    parts.select("name", "start", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def role_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long file for each role of the conversations, with a page for each turn, as listed files.

    No task holds a file: turns are sorted over all tasks, sums of their sizes say where each begins."""
    folder = fresh_path(spark, "roles")
    order = ["conv_id", "turn", "text"]
    turns = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turns = stored(turns.orderBy("role", *order).withColumn("part", F.spark_partition_id()), "turns")
    size = F.octet_length("text").cast("long") + 1
    sums = turns.groupBy("role", "part").agg(F.sum(size).alias("bytes"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(before.partitionBy("role").orderBy("part")), F.lit(0))
    starts = stored(sums.select("role", "part", start.alias("start")), "starts")
    inside = F.coalesce(F.sum(size).over(before.partitionBy("role", "part").orderBy(*order)), F.lit(0))
    placed = turns.withColumn("inside", inside).join(F.broadcast(starts), ["role", "part"], "left")
    # a page begins with the form feed that parts it from the one before
    at = F.col("start") + F.col("inside")
    content = F.when(at > 0, F.concat(F.lit("\f"), "text")).otherwise(F.col("text")).cast("binary")
    written_parts(placed.select(F.concat("role", F.lit(".pdf")).alias("name"), F.greatest(at - 1, F.lit(0)).alias("start"), content.alias("content")), folder)
    return scan_files(spark, folder)
