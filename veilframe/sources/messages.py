"""The message stream between the stages, as files of JSON or Parquet.

Any streaming source with the same columns, such as a parsed Kafka topic, can
take the place of `read_message_stream`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from veilframe.schemas import MESSAGE

JOB_BUCKETS = 64
# the message table as it is stored, partitioned by job_bucket
STORED = StructType([*MESSAGE.fields, StructField("job_bucket", IntegerType())])
# the same, partitioned by when messages came, then by job_bucket
STORED_BY_ARRIVAL = StructType([*MESSAGE.fields, StructField("arrival", IntegerType()), StructField("job_bucket", IntegerType())])
ARRIVAL_SECONDS = 3600


def read_message_stream(
    spark: SparkSession, path: str, fmt: str = "json", schema: StructType = MESSAGE, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Messages as a stream; rows without a job are skipped.

    A batch takes `max_files` files, or files of `max_bytes` in all.  Where a table has
    many small files, bytes keep the number of batches to what its rows need.
    """
    if max_files is not None and max_bytes is not None:
        raise ValueError("a batch is bounded by files or by bytes")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path).filter(F.col("job_id").isNotNull())


def read_messages(spark: SparkSession, path: str, fmt: str = "json", schema: StructType = MESSAGE) -> DataFrame:
    """The same table as a batch."""
    return spark.read.schema(schema).format(fmt).load(path).filter(F.col("job_id").isNotNull())


def text_messages(chunks: DataFrame) -> DataFrame:
    """store_text messages from chunks that carry their job's options."""
    return chunks.select(
        "job_id",
        F.lit("processor").alias("service"),
        F.lit("store_text").alias("action"),
        "chunk_idx",
        "total_chunks",
        "text",
        F.array_join("methods", ",").alias("methods"),
        F.array_join("countries", ",").alias("countries"),
        "transform_method",
    )


def as_messages(df: DataFrame) -> DataFrame:
    """Exactly the columns of a message; those that are not there are NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE]
    )


def with_job_bucket(messages: DataFrame, buckets: int = JOB_BUCKETS) -> DataFrame:
    """Add `job_bucket`, the partition a job's messages are stored in."""
    return messages.withColumn("job_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))


def with_arrival(messages: DataFrame, came: Column | None = None, seconds: int = ARRIVAL_SECONDS) -> DataFrame:
    """Add `arrival`, the number of the hour a message came in; by the clock, if no time is given."""
    at = F.current_timestamp() if came is None else came
    return messages.withColumn("arrival", F.floor(F.unix_seconds(at.cast("timestamp")) / seconds).cast("int"))
