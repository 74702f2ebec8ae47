import hashlib
import os
import struct
from datetime import datetime, timezone

from pyspark.sql import functions as F

from textledger.functions.fingerprint import fast_fingerprint, file_fingerprint, full_fingerprint
from textledger.sources.files import scan_files


def expected(content, seconds):
    state = hashlib.sha256(struct.pack(">q", len(content)))
    if seconds is not None and seconds >= 0:
        state.update(struct.pack(">q", int(seconds)))
    state.update(content[:1024])
    if len(content) > 1024:
        state.update(content[max(1024, len(content) - 1024) :])
    return state.hexdigest()


def test_fingerprints_at_all_borders(spark):
    sizes = [0, 1, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 5000]
    times = [1700000000.0, 1700000000.75, 0.0, -5.0, None]
    cases = []
    for size in sizes:
        content = bytes(n * 7 % 251 for n in range(size))
        for seconds in times:
            cases.append((content, seconds))
    rows = [
        (bytearray(content), None if s is None else datetime.fromtimestamp(s, timezone.utc), len(content), expected(content, s), hashlib.sha256(content).hexdigest())
        for content, s in cases
    ]
    table = spark.createDataFrame(rows, "content binary, modificationTime timestamp, length long, fast string, full string")
    got = table.select("fast", "full", fast_fingerprint().alias("got_fast"), full_fingerprint().alias("got_full"))
    assert got.where((F.col("fast") != F.col("got_fast")) | F.col("got_fast").isNull()).count() == 0
    assert got.where((F.col("full") != F.col("got_full")) | F.col("got_full").isNull()).count() == 0


def test_missing_content_has_no_fingerprint(spark):
    row = spark.createDataFrame([(None, None, 5)], "content binary, modificationTime timestamp, length long")
    assert tuple(row.select(fast_fingerprint(), full_fingerprint()).first()) == (None, None)


def hashes(frame, full):
    seconds = F.unix_seconds("modificationTime")
    return frame.select("path", file_fingerprint(F.col("path"), F.col("length"), seconds, full).alias("h")).select("path", "h.*").collect()


def test_files_have_the_fingerprints_of_their_content(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("textledger.functions.fingerprint.PIECE_BYTES", 1000)
    for size in [0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 100_000]:
        path = tmp_path / f"a b%20[{size}].pdf"
        path.write_bytes(bytes(n * 7 % 251 for n in range(size)))
        os.utime(path, (1_700_000_000 - size * 20_000, 1_700_000_000 - size * 20_000))  # some before 1970
    files = scan_files(spark, str(tmp_path))
    assert files.count() == 9
    for row in hashes(files, False):
        name = row.path.removeprefix("file:")
        assert row.file_hash == expected(open(name, "rb").read(), os.stat(name).st_mtime) and row.problem is None
    for row in hashes(files, True):
        assert row.file_hash == hashlib.sha256(open(row.path.removeprefix("file:"), "rb").read()).hexdigest()


def test_a_file_of_any_size_has_a_hash(spark, tmp_path):
    with open(tmp_path / "sparse.pdf", "wb") as file:
        file.truncate(1 << 30)
    files = scan_files(spark, str(tmp_path))
    state = hashlib.sha256()
    for _ in range(1 << 10):
        state.update(bytes(1 << 20))
    assert hashes(files, True)[0].file_hash == state.hexdigest()
    edges = hashlib.sha256(struct.pack(">qq", 1 << 30, int(os.stat(tmp_path / "sparse.pdf").st_mtime)) + bytes(2048))
    assert hashes(files, False)[0].file_hash == edges.hexdigest()


def test_the_fast_fingerprint_reads_two_ends(tmp_path, monkeypatch):
    from textledger.sources import stores

    (tmp_path / "a").write_bytes(bytes(1_000_000))
    read = []

    class Counting:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def read(self, size=-1):
            read.append(size)
            return self.file.read(size)

    with open(tmp_path / "a", "rb", buffering=0) as file:
        assert len(stores.read_range(Counting(file), 999_000, 1024)) == 1000
    assert sum(read) <= 1024 + 24


def test_files_that_cannot_be_read_have_a_problem(spark, tmp_path):
    gone = spark.createDataFrame([(f"file:{tmp_path}/a b%20[1].pdf", 1, None), (f"file:{tmp_path}", 1, None)], "path string, length long, modificationTime timestamp")
    for full in (False, True):
        rows = {row.path: row for row in hashes(gone, full)}
        assert all(row.file_hash is None for row in rows.values())
        assert "No such file" in rows[f"file:{tmp_path}/a b%20[1].pdf"].problem and "directory" in rows[f"file:{tmp_path}"].problem
