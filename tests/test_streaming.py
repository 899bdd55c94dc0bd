"""Streams in several batches, out of order and with repeats, equal batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilframe.operators.chunking import chunk_documents
from veilframe.operators.combine import dedup_findings, final_scores
from veilframe.operators.jobs import job_complete, job_progress, job_state, latest_chunk_result
from veilframe.sources.documents import read_documents, read_text_documents
from veilframe.sources.jobs import job_requests
from veilframe.sources.messages import STORED, as_messages, read_message_stream, text_messages, with_job_bucket
from veilframe.sources.results import write_result_stream, write_results
from veilframe.streaming.detect import stream_detect_ml, stream_detect_regex
from veilframe.streaming.jobs import completion_events, job_findings, stream_complete_jobs, stream_expire_jobs
from veilframe.sources.weights import Weights
from veilframe.workspace import workspace

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def messages(docs):
    texts = [f"mail u{i}@example.com, ssn {100 + i}-45-6789, " * (1 + i % 3) for i in range(12)]
    requests = docs(*texts).select(
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), "doc_id", "text", F.lit("transform").alias("endpoint"),
        F.lit("regex").alias("methods"), F.lit(None).cast("string").alias("countries"),
        F.when(F.col("doc_id") % 2 == 0, "mask").alias("transform_method"),
    )
    tasks = text_messages(chunk_documents(job_requests(requests), 40, 15))
    tasks = as_messages(tasks).withColumn("seq", F.lit(0).cast("long")).withColumn(
        "submitted_ts", F.lit(BASE) + F.expr("make_dt_interval(0, 0, cast(substring(job_id, 5) as int), 0)")
    )
    reports = as_messages(stream_detect_regex(tasks)).withColumn("seq", F.lit(2).cast("long"))
    stale = reports.withColumn("seq", F.lit(1).cast("long")).withColumn("pii_matches", F.slice("pii_matches", 1, 0))
    gap = (F.col("job_id") == "job-5") & (F.col("chunk_idx") == 0)
    return tasks.unionByName(reports.filter(~gap)).unionByName(stale.filter(~gap))


@pytest.mark.parametrize("per_batch", [1, 3, None])
def test_jobs_complete_once(spark, messages, per_batch):
    base = workspace(spark, "jobs")
    store = f"{base}/store"
    # every file holds parts of many jobs
    with_job_bucket(messages, 2).repartition(3, F.xxhash64("service", "chunk_idx", "job_id")).write.partitionBy("job_bucket").parquet(store)
    stream = read_message_stream(spark, store, "parquet", STORED, per_batch)
    stream_complete_jobs(
        spark, completion_events(stream, "7 days"), store, f"{base}/out", f"{base}/check",
        chunk_size=40, overlap=15, salt="s", nonce="n", buckets=2, once=True,
    ).awaitTermination()
    done = {r["job_id"] for r in job_complete(messages).collect()}
    assert done == {f"job-{i}" for i in range(12)} - {"job-5"}
    texts = spark.read.parquet(f"{base}/out/texts").collect()
    assert sorted(r["job_id"] for r in texts) == sorted(done)
    latest = latest_chunk_result(messages.join(job_complete(messages), "job_id"))
    want = dedup_findings(job_findings(latest), "job_id")
    got = spark.read.parquet(f"{base}/out/findings").drop("batch")
    assert got.count() == want.count() > 0 and got.select(*want.columns).exceptAll(want).count() == 0
    scores = {(r["job_id"], r["method"]): r["score"] for r in spark.read.parquet(f"{base}/out/scores").collect()}
    assert scores == {(r["job_id"], r["method"]): r["score"] for r in final_scores(want, key="job_id").collect()}
    masked = {r["job_id"]: r for r in texts}
    assert masked["job-2"]["transformed_text"].count("*") > 0 and "@" not in masked["job-2"]["transformed_text"]
    assert masked["job-1"]["transform_method"] == "pseudonymize" and "[email_" in masked["job-1"]["transformed_text"]


def test_timed_out_jobs(spark, messages):
    base = workspace(spark, "late")
    write_results(messages, f"{base}/in")
    late = stream_expire_jobs(read_message_stream(spark, f"{base}/in", "parquet"), "2 minutes")
    write_result_stream(late, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    rows = spark.read.parquet(f"{base}/out").collect()
    assert [(r["job_id"], r["status"]) for r in rows] == [("job-5", "incomplete")]
    assert rows[0]["reports"] == rows[0]["expected"] - 1


def test_stateless_stages(spark, messages):
    base = workspace(spark, "tasks")
    tasks = messages.filter("action = 'store_text'")
    write_results(tasks.repartition(3), f"{base}/in", "json")
    found = stream_detect_regex(read_message_stream(spark, f"{base}/in", max_files=1))
    write_result_stream(found, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    got = as_messages(spark.read.parquet(f"{base}/out")).select("job_id", "chunk_idx", "pii_matches")
    want = stream_detect_regex(tasks).select("job_id", "chunk_idx", "pii_matches")
    assert got.count() == tasks.count() and got.exceptAll(want).count() == 0
    ml = tasks.withColumn("methods", F.lit("quantum_classification,ner")).withColumn("embedding", F.array(F.lit(0.5)))
    rows = stream_detect_ml(ml, Weights.initial()).collect()
    assert len(rows) == tasks.count() and all(r["quantum"]["pii_probability"] > 0 and r["service"] == "ml" for r in rows)


def test_state_counts_only_what_is_needed(spark):
    rows = [
        ("a", "processor", 0, 2, "regex"), ("a", "processor", 1, 2, "regex"), ("a", "ml", 0, 2, "regex"), ("a", "ml", 1, 2, "regex"),
        ("a", "regex", 0, 2, "regex"), ("b", "processor", 0, 1, "ner"), ("b", "ml", 0, 1, "ner"), ("b", "ml", 0, 1, "ner"),
        ("c", "processor", 0, 1, "shoe_size"),
    ]
    df = spark.createDataFrame(rows, "job_id string, service string, chunk_idx int, total_chunks int, methods string")
    state = {r["job_id"]: (r["reports"], r["expected"], r["complete"]) for r in job_state(df).collect()}
    assert state == {"a": (3, 4, False), "b": (2, 2, True), "c": (1, 1, True)}


def test_progress(spark):
    rows = [("a", 0, 3, False, BASE), ("a", 1, 3, False, BASE + dt.timedelta(seconds=2)), ("b", 0, 1, False, BASE), ("c", 0, 2, True, BASE)]
    df = spark.createDataFrame(rows, "job_id string, chunk_idx int, total_chunks int, failed boolean, ts timestamp")
    got = {r["job_id"]: (r["progress"], r["status"], r["duration"]) for r in job_progress(df).collect()}
    assert got == {"a": (33, "processing", 2.0), "b": (50, "aggregating", 0.0), "c": (0, "failed", 0.0)}


def test_requests(spark):
    rows = [("detect", None, None, None), ("transform", None, None, None), ("form", None, "US", "mask"), ("transform", "a, b", "", "mask")]
    df = spark.createDataFrame(rows, "endpoint string, methods string, countries string, transform_method string")
    got = job_requests(df).collect()
    assert [len(r["methods"]) for r in got] == [6, 2, 1, 2]
    assert got[3]["methods"] == ["a", " b"] and got[3]["countries"] == [""]
    assert [r["transform_method"] for r in got] == [None, "pseudonymize", None, "mask"]


def test_files_as_documents(spark, tmp_path):
    samples = {"a.txt": b"one\r\ntwo\rthree\n", "b.txt": b"x\xff\xfe y \xe2\x82", "c.txt": b"", "d.bin": b"no"}
    for name, content in samples.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_text_documents(spark, str(tmp_path), "*.txt").collect()}
    assert set(rows) == {"a.txt", "b.txt"}
    for name in ("a.txt", "b.txt"):
        want = samples[name].decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        assert rows[name]["text"] == want and rows[name]["file_size"] == len(samples[name])


def test_small_tables_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert read_documents(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
