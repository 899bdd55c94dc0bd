"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a batch of results."""
    results.write.mode(mode).format(fmt).save(path)


def write_result_stream(
    results: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False, partition_by: str | None = None
) -> StreamingQuery:
    """Append a stream of results to files, each row once.

    `once` works off what is there and stops.
    """
    writer = results.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
