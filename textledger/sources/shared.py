"""Shared storage for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

# What may be broadcast: measured bytes of all values plus an allowance per row.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written as a table in the shared folder and read back: lineage ends, executors may come and go."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes, whatever its type."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | MapType | StructType):
            size = F.aggregate(value, F.lit(0).cast("long"), lambda total, each: total + value_bytes(each, kind.elementType) + 8)
        else:
            size = F.size(value).cast("long") * 8
    elif isinstance(kind, MapType):
        pairs = StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)])
        size = value_bytes(F.map_entries(value), ArrayType(pairs))
    elif isinstance(kind, StructType):
        size = sum((value_bytes(value[field.name], field.dataType) for field in kind), F.lit(0).cast("long"))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(F.greatest(size, F.lit(0).cast("long")), F.lit(0).cast("long"))


def stored_for_join(rows: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, int]:
    """`rows` stored and counted; marked for broadcast if their measured size is at most `most` (`BROADCAST_BYTES`)."""
    table = stored(rows, name)
    row_bytes = sum((value_bytes(F.col(f"`{field.name}`"), field.dataType) for field in table.schema), F.lit(ROW_BYTES).cast("long"))
    number, size = table.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return (F.broadcast(table) if size <= (BROADCAST_BYTES if most is None else most) else table), number
