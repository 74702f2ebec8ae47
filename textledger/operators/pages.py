"""Page assembly: the labelled, non-blank pages of a document as one text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textledger.functions.text import labelled_page

# Pages folded into one piece before the pieces of a document meet.
PIECE_PAGES = 256


def assemble_array(pages: Column, ocr: bool = False) -> Column:
    """Assembled text of an array of page texts; the position is the page number. No shuffle."""
    labelled = F.transform(pages, lambda page, at: labelled_page(at + 1, page, ocr))
    return F.array_join(labelled, "")  # skips the NULLs of failed and blank pages


def assemble_pages(
    pages: DataFrame, file: str, ocr: bool = False, number: str = "page_num", text: str = "page_text", labelled: bool = True
) -> DataFrame:
    """One row per `file` from a table of pages: `file`, `text`, `page_count` (blank pages included). Without `labelled`
    pages follow one another as they are.

    Joining texts in order is associative, so runs of neighbouring pages are folded first, spread over
    the cluster by (file, run). A document with very many pages therefore costs its last task a few long
    pieces instead of every page; what remains there is the output value itself.
    """
    piece = F.floor((F.col(number) - 1) / PIECE_PAGES)
    shown = labelled_page(F.col(number), F.col(text), ocr) if labelled else F.col(text)
    folded = pages.groupBy(file, piece.alias("piece")).agg(
        _in_order(F.col(number), shown).alias("text"),
        F.count("*").alias("pages"),
    )
    return folded.groupBy(file).agg(
        _in_order(F.col("piece"), F.col("text")).alias("text"),
        F.sum("pages").cast("int").alias("page_count"),
    )


def _in_order(position: Column, text: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("position"), text.alias("text"))))
    return F.array_join(ordered["text"], "")


def page_counts(pages: DataFrame, file: str) -> DataFrame:
    """Pages per `file`, blank ones included; reads no text."""
    return pages.groupBy(file).agg(F.count("*").cast("int").alias("page_count"))
