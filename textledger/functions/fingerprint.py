"""SHA-256 fingerprints: of files that tasks open, or of content in a table with the columns of the `binaryFile` source."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textledger import formats


#: Bytes of a file that pass through the hash at a time.
PIECE_BYTES = 8 * 1024 * 1024


def _big_endian(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def content_edges(content: Column) -> Column:
    """First and last KB of the content. They never overlap: up to 2 KB, the second part is what follows the first."""
    edge = formats.FINGERPRINT_BYTES
    size = F.octet_length(content)
    tail = F.substring(content, F.greatest(F.lit(edge + 1), size - (edge - 1)), F.lit(edge))
    return F.concat(F.substring(content, 1, edge), F.when(size > edge, tail).otherwise(F.lit(b"")))


def file_fingerprint(path: Column, length: Column, modified: Column, full: bool = False) -> Column:
    """struct<file_hash, problem>: the fingerprint of a file that the task opens itself; its bytes are no value of a row.

    The full one passes the file through the hash piece by piece, whatever its size; the fast one reads the two ends. A
    file that cannot be opened or read has no hash, but the reason as `problem`. `modified` is in seconds.
    """
    edge, piece = formats.FINGERPRINT_BYTES, PIECE_BYTES

    def hashed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import hashlib

        from textledger.sources.stores import open_file, read_range

        def one(uri, size, seconds):
            state = hashlib.sha256()
            try:
                with open_file(uri) as source:
                    if full:
                        while part := source.read(piece):
                            state.update(part)
                    else:
                        state.update(size.to_bytes(8, "big"))
                        if seconds is not None and seconds >= 0:
                            state.update(seconds.to_bytes(8, "big"))
                        state.update(read_range(source, 0, min(edge, size)))
                        if size > edge:
                            start = max(edge, size - edge)
                            state.update(read_range(source, start, size - start))
            except OSError as caught:
                return {"file_hash": None, "problem": str(caught).encode("utf-8", "replace").decode()}
            return {"file_hash": state.hexdigest(), "problem": None}

        kind = pa.struct([("file_hash", pa.string()), ("problem", pa.string())])
        for columns in batches:
            yield pa.array([one(*row) for row in zip(*(column.to_pylist() for column in columns))], kind)

    # a file may change between two calls
    udf = F.arrow_udf(hashed, "struct<file_hash: string, problem: string>").asNondeterministic()
    return udf(path, length, modified)


def fast_fingerprint() -> Column:
    """Hash of size, modification second, first KB and last KB, over `length`, `modificationTime`, `content`.

    Size and time are 8-byte big-endian; a time that is missing or before 1970 is left out.
    """
    seconds = F.unix_seconds("modificationTime")
    return F.sha2(
        F.concat(
            _big_endian(F.col("length")),
            F.when(seconds >= 0, _big_endian(seconds)).otherwise(F.lit(b"")),
            content_edges(F.col("content")),
        ),
        256,
    )


def full_fingerprint() -> Column:
    """Hash of all bytes of `content`."""
    return F.sha2("content", 256)


def fingerprint(full: bool = False) -> Column:
    """The fingerprint a run stores."""
    return full_fingerprint() if full else fast_fingerprint()
