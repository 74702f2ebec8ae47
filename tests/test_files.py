import os

import pytest
from pyspark.sql import functions as F

from textledger.sources import files as source
from textledger.sources.files import has_suffix, scan_files, spread

SIZES = {
    "b.pdf": 10, "c.pdf": 1024, "sub/deep/g.pdf": 3, "k=v/h.pdf": 4, "sp ace%20+.pdf": 5, "q[1]{a}*.pdf": 6, "_i.pdf": 7, ".j.pdf": 7,
    ".dir/x.pdf": 8, "_dir/.e/y.pdf": 9, "empty.pdf": 0, "sub/a+%41 b.pdf": 0, "..pdf": 2,
}


@pytest.fixture
def folder(tmp_path):
    for name, size in {**SIZES, "X.PDF": 7, ".pdf": 7, "n.txt": 7, "pdf": 7, "sub/.pdf": 7, "a.pdf.gz": 7}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "folder.pdf").mkdir()
    return tmp_path


def listed(frame, folder):
    return {row.path.removeprefix(f"file:{folder}/"): row.length for row in frame.select("path", "length").collect()}


def test_every_name_at_every_depth(spark, folder):
    assert listed(scan_files(spark, str(folder)), folder) == SIZES


def test_suffix():
    names = ["a.pdf", ".a.pdf", "_a.pdf", "..pdf", ".pdf", "a.PDF", "pdf", "a.pdf.gz", "x/.pdf", "x.pdf/a"]
    assert [has_suffix(name, "pdf") for name in names] == [True] * 4 + [False] * 6


def test_several_folders_and_folders_inside_others(spark, folder):
    both = scan_files(spark, [str(folder / "sub"), str(folder / "k=v"), f"{folder}/sub/deep/"])
    assert sorted(row.path for row in both.collect()) == sorted(f"file:{folder}/{name}" for name in SIZES if name.startswith(("sub/", "k=v/")))


def test_a_file_named_itself(spark, folder):
    assert listed(scan_files(spark, str(folder / "b.pdf")), folder) == {"b.pdf": 10}


def test_times(spark, folder):
    os.utime(folder / "empty.pdf", ns=(0, 1_600_000_000_123_456_789))
    os.utime(folder / "b.pdf", (-5, -5))
    rows = scan_files(spark, str(folder)).select("path", F.unix_micros("modificationTime").alias("micros")).collect()
    micros = {os.path.basename(row.path): row.micros for row in rows}
    assert micros["empty.pdf"] == 1_600_000_000_123_456 and micros["b.pdf"] == -5_000_000


def test_links(spark, folder):
    (folder / "loop").symlink_to(folder)
    (folder / "link.pdf").symlink_to(folder / "c.pdf")
    (folder / "gone.pdf").symlink_to(folder / "nowhere")
    assert listed(scan_files(spark, str(folder)), folder) == {**SIZES, "link.pdf": 1024}


def test_no_files(spark, tmp_path):
    assert scan_files(spark, str(tmp_path)).count() == 0
    assert scan_files(spark, []).count() == 0


def test_missing_folder_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="PATH_NOT_FOUND"):
        scan_files(spark, str(tmp_path / "none"))


def test_large_folders_pass_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "ENTRIES", 3)
    for at in range(20):
        (tmp_path / f"{at}.pdf").write_bytes(b"x")
    assert scan_files(spark, str(tmp_path)).count() == 20


def test_files_go_to_all_cores(spark, folder):
    assert spread(scan_files(spark, str(folder))).rdd.getNumPartitions() == min(len(SIZES), spark.sparkContext.defaultParallelism)
