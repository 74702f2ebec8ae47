"""The stored ledger: Parquet folders that never change, and a log that says which of them count.

A run writes its rows under `batch_id=N/<some name>`, where nobody looks, and then creates one empty file in `_log`, whose
name holds a number, the batch and the folder. That file is the commit: it is there or not, so a reader sees a batch as it was
or as it is, whatever happens to the writer. Of several commits of one batch the last one counts. A reader takes one
listing of the log as its snapshot; folders that a later commit leaves behind stay until `vacuum`.

A new batch reserves its number by an exclusively created file, so writers that run at once get numbers of their own.
"""

import re
import threading
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textledger import formats
from textledger.operators.queries import summary_counts
from textledger.operators.versions import one_per_key, replaced_keys, without_replaced
from textledger.schema import KEY, LEDGER, VERSIONS
from textledger.sources import shared

LOG = "_log"
_COMMIT = re.compile(r"commit-(\d+)-batch-(\d+)-([0-9a-f]+)")
_RESERVED = re.compile(r"reserved-(\d+)")

_reserving = threading.Lock()


def _path(spark: SparkSession, *parts: str):
    """A path for the file system's calls, and that file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _log(spark: SparkSession, path: str) -> list[str]:
    """Names of the log's files, by one listing."""
    folder, files = _path(spark, path, LOG)
    return [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []


def _create(spark: SparkSession, *parts: str) -> bool:
    """Create an empty file; False if there is one already."""
    file, files = _path(spark, *parts)
    try:
        return files.createNewFile(file)
    except Py4JJavaError:
        if files.exists(file):  # another writer was first
            return False
        raise


def _matches(pattern: re.Pattern, names: list[str]) -> list[tuple[str, ...]]:
    return [found.groups() for found in map(pattern.fullmatch, names) if found]


def _reserve(spark: SparkSession, path: str) -> int:
    """The next free batch number. File systems with an exclusive create keep drivers apart, the lock threads of one."""
    with _reserving:
        while True:
            names = _log(spark, path)
            taken = [int(number) for number, in _matches(_RESERVED, names)] + [int(batch) for _, batch, _ in _matches(_COMMIT, names)]
            number = max(taken, default=0) + 1
            if _create(spark, path, LOG, f"reserved-{number}"):
                return number


def _commit(spark: SparkSession, path: str, batch_id: int, name: str) -> None:
    """From here on the rows in `batch_id=N/name` are the batch."""
    number = max((int(number) for number, _, _ in _matches(_COMMIT, _log(spark, path))), default=0) + 1
    if not _create(spark, path, LOG, f"commit-{number:012d}-batch-{batch_id}-{name}"):
        raise OSError(f"cannot commit batch {batch_id}")


def snapshot(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each batch that counts, by one listing of the log; empty if there is no ledger yet.

    Writers of one batch at the same time may commit under one number; then the name decides, for every reader alike."""
    last: dict[int, tuple[int, str]] = {}
    for number, batch, name in _matches(_COMMIT, _log(spark, path)):
        last[int(batch)] = max(last.get(int(batch), (0, "")), (int(number), name))
    return {batch: f"{path}/batch_id={batch}/{name}" for batch, (_, name) in sorted(last.items())}


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Finished batches of the ledger, ascending; empty if there is no ledger yet. Reads no data."""
    return list(snapshot(spark, path))


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete rows that no commit, or only an earlier commit of their batch, names. No run and no reader may be at work."""
    kept = {folder.rsplit("/", 1)[-1] for folder in snapshot(spark, path).values()}
    root, files = _path(spark, path)
    for batch in files.listStatus(root) if files.exists(root) else []:
        if batch.getPath().getName().startswith("batch_id="):
            for part in files.listStatus(batch.getPath()):
                if part.getPath().getName() not in kept:
                    files.delete(part.getPath(), True)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of finished batches, with `batch_id`; no rows if there is no ledger yet."""
    return _rows(spark, path, snapshot(spark, path))


def _rows(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).option("basePath", path).parquet(*folders.values())


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The current row of every (file_path, file_hash), texts included.

    Which rows were replaced is found from keys alone, as places in files. These go to the tasks as bits, one for each row of
    a file, so that the scan of the texts leaves out what was replaced and no text is shuffled, however many rows that is. Only
    where bits of all rows are too many to be sent (`BROADCAST_BYTES`) rows are joined with the replaced keys.
    """
    folders = snapshot(spark, path)
    versions = _rows(spark, path, folders)
    if len(folders) < 2:  # nothing can have been replaced
        return versions.drop("batch_id")
    replaced = replaced_keys(versions)
    if versions.count() > 8 * shared.BROADCAST_BYTES:  # from the files' footers
        replaced, number = shared.stored_for_join(replaced, "replaced")
        return (without_replaced(versions, replaced) if number else versions).drop("batch_id")
    return _without_places(versions, replaced).drop("batch_id")


def _without_places(versions: DataFrame, replaced: DataFrame) -> DataFrame:
    """`versions`, read from files, without the rows of earlier batches than `replaced` names."""
    place = {"part": F.col("_metadata.file_path"), "at": F.col("_metadata.row_index")}
    keys = versions.select(*KEY, "batch_id", *(column.alias(name) for name, column in place.items()))
    last = replaced.select(*(F.col(name).alias(f"last_{name}") for name in KEY), "last_batch")
    same = [F.col(name) == F.col(f"last_{name}") for name in KEY]
    gone = keys.join(last, [*same, F.col("batch_id") < F.col("last_batch")], "left_semi").select("part", "at")

    def bits(frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(int(frame["at"].max()) + 1, np.uint8)
        flags[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    table = gone.groupBy("part").applyInPandas(bits, "part string, bits binary").toArrow()
    if not table.num_rows:
        return versions
    found = dict(zip(table["part"].to_pylist(), (np.frombuffer(each, np.uint8) for each in table["bits"].to_pylist())))
    places = versions.sparkSession.sparkContext.broadcast(found)

    def is_current(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        nothing = np.zeros(1, np.uint8)
        for parts, at in batches:
            parts, at = parts.dictionary_encode(), at.to_numpy()
            kept = np.ones(len(at), bool)
            for number, part in enumerate(parts.dictionary.to_pylist()):
                flags, own = places.value.get(part, nothing), parts.indices.to_numpy() == number
                byte = np.minimum(at[own] >> 3, len(flags) - 1)
                kept[own] = ((flags[byte] >> (at[own] & 7)) & 1 == 0) | (byte != at[own] >> 3)
            yield pa.array(kept)

    rows = versions.select("*", *(column.alias(f"_{name}") for name, column in place.items()))
    return rows.where(F.arrow_udf(is_current, "boolean")("_part", "_at")).select(*versions.columns)


def load_time(moment: datetime | None = None) -> Column:
    """UTC load time of a batch in whole seconds, one literal for all its rows."""
    moment = moment or datetime.now(timezone.utc)
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def conform(rows: DataFrame) -> DataFrame:
    """`rows` in the ledger's columns and types; a missing required value or unknown method fails the job."""

    def checked(field):
        value = F.col(field.name).cast(field.dataType)
        faults = []
        if not field.nullable:
            faults.append((value.isNull(), f"{field.name} is NULL"))
        if field.name == "extraction_method":
            faults.append((~value.isin(*formats.METHODS), "unknown extraction_method"))
        for fault, message in faults:
            value = F.when(fault, F.raise_error(F.lit(message)).cast(field.dataType)).otherwise(value)
        return value.alias(field.name)

    return rows.select(*[checked(field) for field in LEDGER.fields])


def write_batch(
    rows: DataFrame,
    path: str,
    batch_id: int | None = None,
    loaded_at: datetime | None = None,
    sequence: str | None = None,
    unique: bool = False,
) -> dict[str, int]:
    """Upsert `rows` as one batch; returns processed, successful and failed counts of what was written.

    Rows get the load time as `timestamp`. The batch is the next one, or `batch_id`, whose old rows the commit
    replaces as a whole. `sequence` orders several rows of one key (see
    `one_per_key`); without it keys must be unique, which is verified on the written keys, before the batch
    counts, unless the caller vouches for it with `unique`. A batch that fails leaves nothing behind that is read.
    """
    spark = rows.sparkSession
    if sequence is not None:
        rows = one_per_key(rows, sequence)
    batch_id = _reserve(spark, path) if batch_id is None else batch_id
    name = uuid.uuid4().hex
    folder = f"{path}/batch_id={batch_id}/{name}"
    counts = Observation()
    batch = conform(rows.withColumn("timestamp", load_time(loaded_at)))
    # Texts of all sizes come from very many small inputs: even them out into files of sensible size.
    # Counting comes after that shuffle, in the tasks that write, so that a repeated map task adds nothing.
    counted = batch.hint("rebalance", "file_path").observe(counts, *summary_counts())
    try:
        counted.write.mode("append").parquet(folder)
        # On what was written: rows may be costly, and are made once.
        if not unique and sequence is None and not _repeated_keys(spark.read.schema(LEDGER).parquet(folder)).isEmpty():
            raise ValueError("a batch holds several rows of one key; name the column that orders them as sequence")
    except BaseException:
        half, files = _path(spark, folder)
        files.delete(half, True)
        raise
    _commit(spark, path, batch_id, name)
    return counts.get


def _repeated_keys(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("file_hash").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the current versions of a ledger as the first batch of a new one, load times kept."""
    rows = conform(read_ledger(spark, path))
    if batch_ids(spark, new_path):
        raise FileExistsError(f"{new_path} exists")
    name = uuid.uuid4().hex
    rows.hint("rebalance", "file_path").write.parquet(f"{new_path}/batch_id=1/{name}")
    _commit(spark, new_path, 1, name)


DROPPED = "path string, problem string, timestamp timestamp_ntz"


def write_dropped(files: DataFrame, path: str, loaded_at: datetime | None = None) -> None:
    """Keep files (path, problem) that a run had to leave out beside the ledger."""
    files.withColumn("timestamp", load_time(loaded_at)).write.mode("append").parquet(f"{path}/_dropped/rows")


def read_dropped(spark: SparkSession, path: str) -> DataFrame:
    """path, problem, timestamp of the files that runs left out because they could not be read."""
    folder, files = _path(spark, path, "_dropped", "rows")
    return spark.read.schema(DROPPED).parquet(f"{path}/_dropped/rows") if files.exists(folder) else spark.createDataFrame([], DROPPED)
