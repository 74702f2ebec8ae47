"""The extraction cascade: direct text, else alternative text, else OCR, else an error row.

Its conditions are kept small on purpose: when a query filters on an outcome, the optimizer copies them
into the filter.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textledger import formats
from textledger.functions.text import is_short, is_substantial, trimmed_bytes

OUTCOME = ["extraction_method", "extracted_text", "page_count", "success", "error_message"]

_ROUTES = {"direct_text", "direct_pages", "direct_error", "alt_text", "ocr_text", "ocr_pages", "ocr_error"}


def direct_choice(direct: Column, alternative: Column) -> Column:
    """Direct text, or the alternative one if the former is short and the latter strictly longer (trimmed)."""
    longer = trimmed_bytes(alternative) > trimmed_bytes(direct)
    return F.when(is_short(direct) & longer, alternative).otherwise(direct)


def stands_alone(direct: Column, alternative: Column) -> Column:
    """The choice of the two has more than 50 trimmed bytes, so no OCR is needed; never NULL.

    Exactly 50 bytes of direct text are neither short nor enough.
    """
    stands = is_substantial(direct) | (is_short(direct) & is_substantial(alternative))
    return F.coalesce(stands, F.lit(False))


def cascade(candidates: DataFrame, text_only: bool = False, ocr_only: bool = False) -> DataFrame:
    """Decide method, text, page count, success and message of every candidate row.

    Candidates hold `direct_text`, `direct_pages`, `direct_error`, `alt_text`, `ocr_text`, `ocr_pages` and
    `ocr_error`; a text is NULL when its route failed or was not taken. All other columns pass through.
    """
    nothing = F.lit(None).cast("string")
    direct = nothing if ocr_only else F.col("direct_text")
    ocr = nothing if text_only else F.col("ocr_text")
    ocr_error = F.lit(formats.OCR_DISABLED) if text_only else F.coalesce("ocr_error", F.lit(""))
    if ocr_only:
        stands = F.lit(False)
        message = F.concat(F.lit(formats.OCR_ONLY_FAILED), ocr_error)
    else:
        stands = stands_alone(direct, F.col("alt_text"))
        direct_error = F.coalesce("direct_error", F.lit(""))
        message = F.concat(F.lit(formats.DIRECT_PART), direct_error, F.lit(formats.OCR_PART), ocr_error)

    passed = [name for name in candidates.columns if name not in _ROUTES]
    decided = candidates.withColumn("stands", stands)
    taken = F.when(F.col("stands"), formats.DIRECT).when(ocr.isNotNull(), formats.OCR)

    def by_route(of_ocr: Column, of_direct: Column, of_error: Column) -> Column:
        return (
            F.when(~F.col("stands") & ocr.isNotNull(), of_ocr).when(direct.isNotNull(), of_direct).otherwise(of_error)
        )

    failed = direct.isNull() & ocr.isNull()
    return decided.select(
        *passed,
        taken.when(direct.isNotNull(), formats.DIRECT_PARTIAL).otherwise(formats.ERROR).alias("extraction_method"),
        by_route(ocr, direct if ocr_only else direct_choice(direct, F.col("alt_text")), F.lit("")).alias(
            "extracted_text"
        ),
        by_route(F.col("ocr_pages"), F.col("direct_pages"), F.lit(0)).cast("int").alias("page_count"),
        (~failed).alias("success"),
        F.when(failed, message).alias("error_message"),
    )
