"""State of jobs from their chunk messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import ML_METHODS, REGEX_METHODS
from veilframe.operators.routing import asks_for

# service that stores a chunk's text, and the two that report on it
TEXT_SERVICE, REGEX_SERVICE, ML_SERVICE = "processor", "regex", "ml"


def services_needed(methods: Column) -> Column:
    """How many services must report on each chunk of a job: the text always."""
    return (
        F.lit(1)
        + asks_for(methods, REGEX_METHODS).cast("int")
        + asks_for(methods, ML_METHODS).cast("int")
    )


def counts_for_readiness(methods: Column) -> Column:
    """Whether a message is one that its job waits for."""
    return (
        (F.col("service") == TEXT_SERVICE)
        | ((F.col("service") == REGEX_SERVICE) & asks_for(methods, REGEX_METHODS))
        | ((F.col("service") == ML_SERVICE) & asks_for(methods, ML_METHODS))
    )


def needed_messages(messages: DataFrame) -> DataFrame:
    """Messages that count for readiness, with `needed`, the services per chunk."""
    methods = F.split("methods", ",")
    return messages.filter(counts_for_readiness(methods)).withColumn("needed", services_needed(methods))


def latest_chunk_result(messages: DataFrame) -> DataFrame:
    """The last message of each (job, service, chunk); repeats fold before the shuffle."""
    rest = [c for c in messages.columns if c not in ("job_id", "service", "chunk_idx")]
    last = F.max_by(F.struct(*rest), "seq").alias("_last")
    return (
        messages.groupBy("job_id", "service", "chunk_idx")
        .agg(last)
        .select("job_id", "service", "chunk_idx", "_last.*")
        .select(*messages.columns)
    )


def job_state(messages: DataFrame) -> DataFrame:
    """Per job: reports in, reports expected, and whether it is complete.

    Repeated messages are folded on (job, service, chunk) first, so a job with
    very many messages is spread over tasks.
    """
    distinct = (
        needed_messages(messages)
        .groupBy("job_id", "service", "chunk_idx")
        .agg(F.max("total_chunks").alias("total_chunks"), F.max("needed").alias("needed"))
    )
    return distinct.groupBy("job_id").agg(
        F.count("*").alias("reports"), F.max(F.col("total_chunks") * F.col("needed")).alias("expected")
    ).withColumn("complete", F.col("reports") >= F.col("expected"))


def job_complete(messages: DataFrame) -> DataFrame:
    """Jobs whose text and needed reports are in for every chunk."""
    return job_state(messages).filter("complete").select("job_id")


def job_progress(chunk_status: DataFrame) -> DataFrame:
    """Progress per job from one row per sent chunk: job_id, chunk_idx,
    total_chunks, failed, ts.

    Sending makes up the first half of a job's progress.
    """
    per_chunk = chunk_status.groupBy("job_id", "chunk_idx").agg(
        F.max("total_chunks").alias("total_chunks"),
        F.max(F.col("failed").cast("int")).alias("failed"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    sent = per_chunk.groupBy("job_id").agg(
        F.sum(F.when(F.col("failed") == 0, 1).otherwise(0)).alias("processed_chunks"),
        F.max("total_chunks").alias("total_chunks"),
        F.max("failed").alias("failed"),
        F.min("first_ts").alias("start_time"),
        F.max("last_ts").alias("last_time"),
    )
    n, total = F.col("processed_chunks"), F.col("total_chunks")
    status = (
        F.when(F.col("failed") > 0, "failed").when(n >= total, "aggregating").otherwise("processing")
    )
    return sent.select(
        "job_id",
        "processed_chunks",
        "total_chunks",
        F.floor(n / total * 50).cast("int").alias("progress"),
        status.alias("status"),
        (F.unix_micros(F.col("last_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))).alias("_us"),
    ).withColumn("duration", F.col("_us") / 1e6).drop("_us")
