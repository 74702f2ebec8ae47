"""The ledger table: one row per version of a document file."""

from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_hash", T.StringType(), True),
        T.StructField("file_size", T.LongType(), True),
        T.StructField("extraction_method", T.StringType(), False),
        T.StructField("extracted_text", T.StringType(), True),
        T.StructField("page_count", T.IntegerType(), True),
        T.StructField("processing_time_seconds", T.DoubleType(), True),
        T.StructField("timestamp", T.TimestampNTZType(), True),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("error_message", T.StringType(), True),
    ]
)

# Partition column of the stored ledger; grows with every run, so it also orders the versions of one key.
BATCH_ID = T.StructField("batch_id", T.LongType(), False)

VERSIONS = T.StructType(LEDGER.fields + [BATCH_ID])

KEY = ["file_path", "file_hash"]

# Shape of the `binaryFile` source, and of every input to an extraction run.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), True),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)
