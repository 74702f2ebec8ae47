from pyspark.sql import functions as F

from textledger.operators import pages


def test_many_pages_fold_in_order(spark):
    number = 3 * pages.PIECE_PAGES + 7
    table = spark.range(number).select(
        F.lit("f").alias("file"),
        (F.lit(number) - F.col("id")).cast("int").alias("page_num"),
        F.when(F.col("id") % 5 == 0, " \n").otherwise(F.concat(F.lit("p"), F.lit(number) - F.col("id"))).alias("page_text"),
    )
    row = pages.assemble_pages(table.repartition(8), "file").first()
    kept = [n for n in range(1, number + 1) if (number - n) % 5]
    assert row.text == "".join(f"--- Page {n} ---\np{n}\n\n" for n in kept)
    assert row.page_count == number


def test_array_and_table_agree_and_skip_failed_pages(spark):
    texts = ["one", " ", None, "four"]
    rows = spark.createDataFrame([("f", n + 1, text) for n, text in enumerate(texts)], "file string, page_num int, page_text string")
    folded = pages.assemble_pages(rows, "file", ocr=True).first()
    array = spark.createDataFrame([(texts,)], "pages array<string>").select(pages.assemble_array(F.col("pages"), ocr=True)).first()[0]
    assert folded.text == array == "--- Page 1 (OCR) ---\none\n\n--- Page 4 (OCR) ---\nfour\n\n"
    assert folded.page_count == 4


def test_file_of_blank_pages_has_empty_text(spark):
    rows = spark.createDataFrame([("f", 1, " ")], "file string, page_num int, page_text string")
    assert tuple(pages.assemble_pages(rows, "file").first()) == ("f", "", 1)
    assert tuple(pages.page_counts(rows, "file").first()) == ("f", 1)
