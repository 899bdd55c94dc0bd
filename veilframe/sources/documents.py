"""Reading documents, spans and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import decode_utf8
from veilframe.schemas import RESPONSES, SPANS


def read_text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, size in bytes, text.

    Bad UTF-8 is replaced, line ends become LF.  Spark's file index leaves out
    files of zero bytes; they hold no text and have no row here.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", F.col("length").alias("file_size"), decode_utf8(F.col("content")).alias("text"))


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, rows_per_task: int | None = None
) -> DataFrame:
    """A table of documents, dealt out if it comes in fewer splits than cores.

    Searching text costs far more than moving it once.  A large table has more
    splits than cores and is read in place, without a shuffle.

    Splits go by bytes.  Of a table of short rows that grow by what is made of them, a
    split holds too many: `rows_per_task` says how many, and such a table is dealt out, too.
    """
    docs = spark.read.format(fmt).load(path)
    if columns is not None:
        docs = docs.select(*columns)
    least = spark.sparkContext.defaultParallelism
    if rows_per_task is not None:
        least = max(least, -(-docs.count() // rows_per_task))
    return docs.repartition(least) if docs.rdd.getNumPartitions() < least else docs


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_entity_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Spans written by a tagger: document, chunk, label, start, end, score."""
    return _read(spark, path, fmt, SPANS)


def read_model_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw answers of a language model, one per chunk."""
    return _read(spark, path, fmt, RESPONSES)
