"""Column expressions over extracted text. Lengths are UTF-8 bytes, blanks are Unicode white space."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textledger import formats


_PREFIX_CHARS = 256


def _blanks() -> Column:
    return F.lit(formats.WHITE_SPACE)


def trimmed_bytes(text: Column) -> Column:
    """Bytes left after trimming white space from both ends; NULL for NULL."""
    return F.octet_length(F.btrim(text, _blanks()))


def _prefix_bytes(text: Column) -> Column:
    # Never more than `trimmed_bytes(text)`; settles most comparisons with a small number without a
    # walk through the whole text.
    return trimmed_bytes(F.substring(text, 1, _PREFIX_CHARS))


def is_substantial(text: Column) -> Column:
    """The text stands on its own: more than 50 trimmed bytes."""
    enough = formats.SUBSTANTIAL_BYTES
    return (_prefix_bytes(text) > enough) | (trimmed_bytes(text) > enough)


def is_short(text: Column) -> Column:
    """The alternative extractor is tried: under 50 trimmed bytes of direct text."""
    enough = formats.SUBSTANTIAL_BYTES
    return (_prefix_bytes(text) < enough) & (trimmed_bytes(text) < enough)


def is_blank(text: Column) -> Column:
    """Nothing but white space. Only the leading blanks are read."""
    return F.octet_length(F.ltrim(text, _blanks())) == 0


def page_label(number: Column, ocr: bool = False) -> Column:
    head, tail = (formats.OCR_PAGE_LABEL if ocr else formats.PAGE_LABEL).split("%d")
    return F.concat(F.lit(head), number.cast("string"), F.lit(tail))


def labelled_page(number: Column, text: Column, ocr: bool = False) -> Column:
    """One page as it appears in assembled text; NULL for a failed (NULL) or blank page."""
    return F.when(~is_blank(text), F.concat(page_label(number, ocr), text, F.lit(formats.PAGE_END)))


def preview(text: Column) -> Column:
    return F.substring(text, 1, formats.PREVIEW_CHARS)


def shown_time(timestamp: Column) -> Column:
    """A zone-less timestamp as `YYYY-MM-DD HH:MM:SS`.

    By cast: `date_format` would go through the session's zone, which lacks an hour in spring.
    """
    return F.left(timestamp.cast("string"), F.lit(19))


def json_time(timestamp: Column) -> Column:
    """A zone-less UTC timestamp as RFC 3339."""
    return F.concat(F.translate(shown_time(timestamp), " ", "T"), F.lit("Z"))


def like_regex(query: str) -> str:
    """Regular expression for `LIKE '%query%'`; empty if the pattern has no fixed part.

    `_` is any one character and `%` any run of them, line ends included; a backslash is itself; only
    ASCII letters ignore case. The pieces between `%` have a fixed length, so the first place where
    each one fits is always good enough: atomic groups forbid going back and keep the match linear.
    """

    def piece(chars: str) -> str:
        return re.sub(r"[^\w]|_", lambda m: "." if m[0] == "_" else "\\" + m[0], chars, flags=re.ASCII)

    pieces = [piece(part) for part in query.split("%") if part]
    if len(pieces) < 2:
        return "(?is)" + pieces[0] if pieces else ""
    return "(?is)\\A" + "".join(f"(?>.*?{part})" for part in pieces)


def contains_like(text: Column, query: str) -> Column:
    """`text LIKE '%query%'`, ASCII-only case-insensitive; an empty query takes every non-NULL text."""
    regex = like_regex(query)
    return text.rlike(regex) if regex else text.isNotNull()
