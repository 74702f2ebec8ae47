"""Document files as rows: path, modificationTime, length. Bytes stay in their files until a task opens them."""

import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textledger.schema import FILES
from textledger.sources import stores
from textledger.sources.shared import fresh_path

LISTING = T.StructType([field for field in FILES.fields if field.name != "content"])

_FOUND = "path string, is_folder boolean, length long, modified long"

#: Entries that a task passes on at a time.
ENTRIES = 10_000

# What a task opens: about so many bytes, where opening a file counts as so many.
TASK_BYTES, OPEN_BYTES = 128 * 1024 * 1024, 1024 * 1024


def has_suffix(path: str, suffix: str) -> bool:
    """The name ends in `.suffix` (case counts) and has something before that."""
    name = path.rsplit("/", 1)[-1]
    return name.endswith(f".{suffix}") and len(name) > len(suffix) + 1


def _rows(found: Iterator[stores.Entry], suffix: str) -> Iterator[pa.RecordBatch]:
    kept = (entry for entry in found if entry.is_folder or has_suffix(entry.path, suffix))
    while rows := list(islice(kept, ENTRIES)):
        path, is_folder, length, modified = zip(*rows)
        names = pa.array([each.encode("utf-8", "replace").decode() for each in path], pa.string())
        yield pa.record_batch(
            [names, pa.array(is_folder), pa.array(length, pa.int64()), pa.array(modified, pa.int64())],
            ["path", "is_folder", "length", "modified"],
        )


def _resolved(spark: SparkSession, folder: str) -> str:
    """The URI of a folder, with mount points of Spark's own file systems replaced by what they stand for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(f"PATH_NOT_FOUND: {folder}")
    return files.resolvePath(path).toString()


def separate(folders: list[str]) -> list[str]:
    """Folders without those inside another one, so that each file is listed once."""
    bare = sorted({each.rstrip("/") for each in folders})
    return [each for each in bare if not any(each.startswith(f"{other}/") for other in bare)]


def scan_files(spark: SparkSession, folder: str | list[str], suffix: str = "pdf") -> DataFrame:
    """path, modificationTime, length of all files under `folder` whose name ends in `.suffix` (case counts), at any depth.

    Folders are rows: tasks list those of one level, what they find is stored, and its folders are the next level, until
    there are none. So the driver holds no names, whatever the tree. Names may begin with anything, empty files are files,
    links to files count as files and links to folders are not followed. A folder that cannot be listed fails the job.
    """
    folders = separate([_resolved(spark, each) for each in ([folder] if isinstance(folder, str) else folder)])
    target = fresh_path(spark, "listing")

    def list_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(map(stores.root, batch.column("path").to_pylist()), suffix)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _rows(stores.entries(path), suffix)

    frontier, listed, level = spark.createDataFrame([(each,) for each in folders], "path string"), list_roots, 0
    width = 4 * spark.sparkContext.defaultParallelism
    number = len(folders)
    while number:
        rows = frontier.select("path").repartition(min(number, width), "path").mapInArrow(listed, _FOUND)
        rows.write.parquet(f"{target}/level={level}")
        found = spark.read.schema(_FOUND).parquet(f"{target}/level={level}")
        frontier, listed, level = found.where("is_folder"), list_folders, level + 1
        number = frontier.count()
    if not folders:
        return spark.createDataFrame([], LISTING)
    files = spark.read.schema(f"{_FOUND}, level int").parquet(target).where("NOT is_folder")
    return files.select("path", F.timestamp_micros("modified").alias("modificationTime"), "length")


def spread(files: DataFrame, *keys: str, weight: str = "length") -> DataFrame:
    """`files` (a stored table) dealt out to tasks that open them: by bytes and number of files, to all cores at least."""
    number, size = files.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    parallel = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil((size + number * OPEN_BYTES) / TASK_BYTES), min(number, parallel), 1)
    return files.repartition(tasks, *(keys or ("path",)))
