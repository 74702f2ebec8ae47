"""What several operators share: words, folds, vocabularies of bounded size and Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = r"[\x20\x09-\x0D]+"

#: Words of a vocabulary that every task may hold; the others are joined.
HEAD_WORDS = 1_000_000

#: Words that a task counts before it passes its counts on.
COUNTED_WORDS = 400_000


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """For sessions over long documents: Arrow batches of 1,000 rows, not 10,000, in the JVM and in Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with only the columns `used` and, as one column, all others, so that no name can clash with a name that is
    made up on the way; and a function that brings the columns of `docs` back in their order."""
    others = [name for name in docs.columns if name not in used]
    packed = [F.struct(*[docs[f"`{name}`"].alias(f"c{at}") for at, name in enumerate(others)]).alias("others")] if others else []
    place = {name: F.col(f"others.c{at}") for at, name in enumerate(others)}

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[place.get(name, F.col(f"`{name}`")).alias(name) for name in docs.columns])

    return docs.select(*used, *packed), restored


def words(text: Column) -> Column:
    """The runs of characters other than U+0020 and U+0009 to U+000D; none where the text is NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), lambda word: word != "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with the value evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches: few rows, and of few bytes where a row is not larger by itself, so that few texts are held as
    words at a time."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := sys.platform == "linux" and getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, after which free memory goes back: a worker waits for its next task while the JVM needs its own most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, NULL as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def ascii_words(text: bytes) -> list[bytes]:
    """Words as above; splitting bytes looks at the ASCII white space only."""
    return text.split()


def counted(docs: DataFrame, tokens: Callable[[bytes], list]) -> DataFrame:
    """word (binary), n: how often each token of `docs.text` occurs, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                seen.update(tokens(text))
                if len(seen) > COUNTED_WORDS:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    parts = docs.select("text").mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def head_count(counts: DataFrame, bound: int = HEAD_WORDS) -> int:
    """The least count such that at most `bound` words have it or more, to an eighth of a power of two.

    Only sums over at most a few hundred steps of counts reach the driver."""
    step = F.floor(F.log2(F.col("n")) * 8)
    sums = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for row in sorted(sums, key=lambda row: -row.step):
        total += row.words
        if total > bound:
            break
        least = row.least
    return least


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the elements of slices that begin at `starts`, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
