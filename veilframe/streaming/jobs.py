"""Stateful stages of the stream: when is a job complete, and what came of it.

The state holds counters only.  Texts and findings stay in the message table,
which the stream both reads and looks up, so a job with very many findings
never has to fit in one state row.  Where the table is partitioned by arrival, a
lookup reads the time that its jobs took, however old the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilframe.catalog import METHOD_RANK
from veilframe.operators.chunking import reassemble_chunks
from veilframe.operators.combine import dedup_findings, final_scores, verdicts
from veilframe.operators.jobs import latest_chunk_result, needed_messages
from veilframe.operators.steps import spread
from veilframe.operators.transform import transform_data, transform_report
from veilframe.schemas import FINDING_FIELDS
from veilframe.sources.messages import JOB_BUCKETS, STORED, STORED_BY_ARRIVAL, with_job_bucket
from veilframe.streaming.state import rocksdb


def completion_events(messages: DataFrame, timeout: str) -> DataFrame:
    """Reports in and reports expected per job, as a stream.

    Repeated messages are dropped on (job, service, chunk), which spreads a
    large job over tasks; the counts are combined before the shuffle.  State is
    let go once `timeout` has passed since the job was submitted.

    In update mode a job's row turns complete exactly once.  In append mode its
    row comes out when the job has timed out.
    """
    keyed = needed_messages(messages).withWatermark("submitted_ts", timeout)
    distinct = keyed.dropDuplicatesWithinWatermark(["job_id", "service", "chunk_idx"])
    return distinct.groupBy("job_id", "submitted_ts").agg(
        F.count("*").alias("reports"),
        F.max(F.col("total_chunks") * F.col("needed")).alias("expected"),
    )


def stream_expire_jobs(messages: DataFrame, timeout: str) -> DataFrame:
    """Jobs that timed out before all reports were in (append mode)."""
    late = completion_events(messages, timeout).filter(F.col("reports") < F.col("expected"))
    return late.select("job_id", "reports", "expected", F.lit("incomplete").alias("status"))


def job_findings(messages: DataFrame) -> DataFrame:
    """Findings of result messages as rows keyed by job."""
    rank = F.when(F.col("service") == "regex", METHOD_RANK["regex"]).otherwise(METHOD_RANK["llm_semantic"])
    results = messages.filter(F.col("action") == "results").withColumn("method_rank", rank)
    return spread(results, "pii_matches", ["job_id", "chunk_idx", "method_rank"], "ord", "f").select(
        "job_id", "chunk_idx", "method_rank", "ord", *[F.col(f"f.{name}").alias(name) for name in FINDING_FIELDS]
    )


def job_quantum(messages: DataFrame) -> DataFrame:
    """The classifier's result of each job's first chunk."""
    first = messages.filter((F.col("action") == "results") & (F.col("chunk_idx") == 0) & F.col("quantum").isNotNull())
    return first.select("job_id", F.col("quantum").alias("quantum_analysis"))


def stored_messages(
    spark: SparkSession, store: str, complete: DataFrame, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """Messages of complete jobs (job_id, job_bucket), from the partitions that can hold them.

    With `first_arrival` and `last_arrival` these are the buckets of the jobs in the
    hours from the first message to the last; the list that the driver gets has one
    entry per partition to be read.
    """
    by_arrival = "first_arrival" in complete.columns
    if schema is None:
        schema = STORED_BY_ARRIVAL if by_arrival else STORED
    stored = spark.read.schema(schema).format(fmt).load(store)
    if by_arrival:
        hours = complete.select("job_bucket", F.explode(F.sequence("first_arrival", "last_arrival")).alias("arrival")).distinct()
        buckets: dict[tuple[int, ...], list[int]] = {}  # hours that need the same buckets are asked for together
        for row in hours.groupBy("arrival").agg(F.sort_array(F.collect_list("job_bucket")).alias("buckets")).collect():
            buckets.setdefault(tuple(row["buckets"]), []).append(row["arrival"])
        wanted = [F.col("arrival").isin(at) & F.col("job_bucket").isin(list(which)) for which, at in buckets.items()]
        stored = stored.filter(reduce(Column.__or__, wanted, F.lit(False)))
    return stored.join(complete.select("job_bucket", "job_id"), ["job_bucket", "job_id"], "left_semi")


def stream_complete_jobs(
    spark: SparkSession,
    events: DataFrame,
    store: str,
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    overlap: int = 0,
    chunk_size: int | None = None,
    salt: str | None = None,
    nonce: str | None = None,
    buckets: int = JOB_BUCKETS,
    once: bool = False,
) -> StreamingQuery:
    """Write the combined result of every job when it becomes complete.

    `events` comes from `track_jobs` or `completion_events` over the message table at
    `store`, so whatever made a job complete is already in that table.  The table is
    partitioned by `job_bucket`, and for `track_jobs` by `arrival` above it; the lookup
    reads only the partitions of the jobs that completed in this batch.  Output goes
    to one folder per batch and is overwritten if the batch runs again: findings,
    scores, the rewritten texts of the jobs that asked for them if `salt` is given, and
    the jobs whose time was over.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        span = [c for c in ("first_arrival", "last_arrival") if c in batch.columns]
        # The state must be advanced once, however many tables are written.
        batch = batch.persist()
        try:
            if span:
                late = batch.filter(F.col("status") == "incomplete").select("job_id", "reports", "expected", "status")
                if not late.isEmpty():
                    late.write.mode("overwrite").parquet(f"{out}/incomplete/batch={batch_id}")
            done = F.col("status") == "complete" if span else F.col("reports") >= F.col("expected")
            complete = with_job_bucket(batch.filter(done).select("job_id", *span), buckets)
            if complete.isEmpty():
                return
            mine = stored_messages(spark, store, complete, fmt)
            reports = latest_chunk_result(mine.filter(F.col("action") == "results").drop("text"))
            unique = dedup_findings(job_findings(reports), "job_id")
            # The rest reads the written table, so the merge runs once.
            written = f"{out}/findings/batch={batch_id}"
            unique.write.mode("overwrite").parquet(written)
            unique = spark.read.schema(unique.schema).parquet(written)
            scores = final_scores(unique, job_quantum(reports), "job_id")
            scores.write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")
            if salt is not None:
                rewritten = _rewrite(mine.drop("pii_matches", "quantum"), unique, chunk_size, overlap, salt, nonce)
                rewritten.write.mode("overwrite").parquet(f"{out}/texts/batch={batch_id}")
        finally:
            batch.unpersist()

    if salt is not None and (nonce is None or chunk_size is None):
        raise ValueError("rewriting needs nonce and chunk_size")
    writer = events.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if "first_arrival" not in events.columns:
        return writer.start()
    with rocksdb(spark):
        return writer.start()


def _rewrite(
    messages: DataFrame, unique: DataFrame, chunk_size: int, overlap: int, salt: str, nonce: str
) -> DataFrame:
    """Texts of the jobs that asked for a transformation, with their reports."""
    asked = latest_chunk_result(
        messages.filter((F.col("action") == "store_text") & F.col("transform_method").isNotNull())
    )
    method = asked.filter(F.col("chunk_idx") == 0).select("job_id", "transform_method")
    texts = reassemble_chunks(asked, chunk_size, overlap, "job_id")
    docs = verdicts(texts.join(method, "job_id"), unique, key="job_id")
    return stream_transform(docs, salt, nonce)


def stream_transform(jobs: DataFrame, salt: str, nonce: str) -> DataFrame:
    """Rewrite and report on rows of job_id, text, pii_matches and
    transform_method; works on batches and streams."""
    method = F.col("transform_method")
    done = transform_report(transform_data(jobs, salt, method, nonce, "job_id"), method)
    return done.select("job_id", "transform_method", "transformed_text", "transformation_report")
