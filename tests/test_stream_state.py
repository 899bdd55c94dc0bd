"""State by job: one event each, timers without messages, lookups that do not grow."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from contract.fixtures import Tables
from contract.queries import QUERIES, _store, all_messages, all_findings
from test_streaming import BASE, messages  # noqa: F401
from veilframe.operators.combine import dedup_findings, final_scores
from veilframe.operators.jobs import job_complete, job_progress, latest_chunk_result
from veilframe.sources.messages import STORED_BY_ARRIVAL, read_message_stream, with_arrival, with_job_bucket
from veilframe.streaming.jobs import job_findings, stored_messages, stream_complete_jobs
from veilframe.streaming.state import BLOCK, JobTracker, ProgressTracker, rocksdb, stream_job_progress, stream_latest_results, track_jobs, write_updates
from veilframe.workspace import workspace

DAY = 24 * 3600 * 1000


def store(messages, path, files=3):  # noqa: F811
    """A message table by arrival; reports come an hour after the texts, repeats two."""
    came = F.col("submitted_ts") + F.expr("make_dt_interval(0, cast(seq as int))")
    placed = with_job_bucket(with_arrival(messages, came), 2)
    placed.repartition(files, F.xxhash64("service", "chunk_idx", "job_id")).write.partitionBy("arrival", "job_bucket").parquet(path)


def arrived(spark, path, per_batch=None):
    return read_message_stream(spark, path, "parquet", STORED_BY_ARRIVAL, per_batch)


@pytest.mark.parametrize("per_batch", [2, None])
def test_jobs_complete_once(spark, messages, per_batch):  # noqa: F811
    base = workspace(spark, "tracked")
    store(messages, f"{base}/store")
    query = stream_complete_jobs(
        spark, track_jobs(arrived(spark, f"{base}/store", per_batch), None), f"{base}/store", f"{base}/out", f"{base}/check",
        chunk_size=40, overlap=15, salt="s", nonce="n", buckets=2, once=True,
    )
    query.awaitTermination()
    done = {r["job_id"] for r in job_complete(messages).collect()}
    texts = spark.read.parquet(f"{base}/out/texts").collect()
    assert sorted(r["job_id"] for r in texts) == sorted(done) == sorted({f"job-{i}" for i in range(12)} - {"job-5"})
    if per_batch is None:  # a job is told of when its reports are in; findings that come later are not waited for
        want = dedup_findings(job_findings(latest_chunk_result(messages.join(job_complete(messages), "job_id"))), "job_id")
        got = spark.read.parquet(f"{base}/out/findings").drop("batch")
        assert got.count() == want.count() > 0 and got.select(*want.columns).exceptAll(want).count() == 0
        scores = {(r["job_id"], r["method"]): r["score"] for r in spark.read.parquet(f"{base}/out/scores").collect()}
        assert scores == {(r["job_id"], r["method"]): r["score"] for r in final_scores(want, key="job_id").collect()}


def test_a_job_expires_on_an_idle_stream(spark, messages):  # noqa: F811
    base = workspace(spark, "idle")
    store(messages, f"{base}/store", 1)
    events = track_jobs(arrived(spark, f"{base}/store"), 4000, DAY)
    query = write_updates(events, f"{base}/out", f"{base}/check")
    try:
        found, end = {}, time.time() + 90
        while time.time() < end and "job-5" not in found:  # no message comes meanwhile
            time.sleep(1)
            try:
                rows = spark.read.parquet(f"{base}/out").collect()
            except Exception:
                continue  # nothing written yet
            found = {r["job_id"]: r for r in rows}
            assert len(found) == len(rows)
        assert found["job-5"]["status"] == "incomplete" and found["job-5"]["reports"] == found["job-5"]["expected"] - 1
        assert {j for j, r in found.items() if r["status"] == "complete"} == {f"job-{i}" for i in range(12)} - {"job-5"}
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12 * 4  # marks only, no reports
    finally:
        query.stop()


def test_lookups_do_not_grow_with_the_table(spark, messages):  # noqa: F811
    base = workspace(spark, "history")
    jobs = spark.createDataFrame([(f"job-{i}",) for i in range(12)], "job_id string")
    first = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    complete = with_job_bucket(jobs, 2).withColumns({"first_arrival": F.lit(first), "last_arrival": F.lit(first + 2)})
    read = []
    for age in (0, 400, 800):  # hours of history, each with as many messages again
        older = messages.withColumns({
            "job_id": F.concat(F.lit(f"old-{age}-"), "job_id"), "submitted_ts": F.col("submitted_ts") - F.expr(f"make_dt_interval(0, {age + 100})"),
        })
        for part in [messages, older] if age == 0 else [older]:
            placed = with_job_bucket(with_arrival(part, F.col("submitted_ts") + F.expr("make_dt_interval(0, cast(seq as int))")), 2)
            placed.coalesce(1).write.mode("append").partitionBy("arrival", "job_bucket").parquet(f"{base}/store")
        found = stored_messages(spark, f"{base}/store", complete)
        spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # else the plan's text is cut
        plan = found._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        hours = {int(h) for part in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan) for h in re.findall(r"(?<!#)\b\d{6}\b", part)}
        assert hours == {first, first + 1, first + 2}  # the only ones that the scan lists
        read.append(found.count())
    assert read == [messages.count()] * 3


def test_progress_in_any_order(spark):
    rng = random.Random(2)
    rows = [(j, c, 4 + j, rng.random() < 0.05, BASE + dt.timedelta(seconds=rng.randint(0, 900))) for j in range(8) for c in range(4 + j - j % 2) for _ in range(2)]
    schema = "job_id long, chunk_idx int, total_chunks int, failed boolean, ts timestamp"
    want = {tuple(r) for r in job_progress(spark.createDataFrame(rows, schema)).select(
        "job_id", "processed_chunks", "total_chunks", "progress", "status", "duration").collect()}
    for seed in (1, 2):
        base = workspace(spark, "progress")
        shuffled = random.Random(seed).sample(rows, len(rows))
        for i in range(0, len(shuffled), 40):
            spark.createDataFrame(shuffled[i : i + 40], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        write_updates(stream_job_progress(stream, None), f"{base}/out", f"{base}/check", once=True).awaitTermination()
        updates = spark.read.parquet(f"{base}/out")
        assert updates.select("batch").distinct().count() > 1
        last = {}
        for r in sorted(updates.collect(), key=lambda r: r["batch"]):
            last[r["job_id"]] = tuple(r[c] for c in ("job_id", "processed_chunks", "total_chunks", "progress", "status", "duration"))
        assert set(last.values()) == want


def test_latest_results_in_any_order(spark, messages):  # noqa: F811
    base = workspace(spark, "latest")
    messages = messages.filter("action = 'results'").cache()
    want = latest_chunk_result(messages)
    messages.orderBy(F.desc("seq")).coalesce(1).write.option("maxRecordsPerFile", 9).parquet(f"{base}/in")
    stream = read_message_stream(spark, f"{base}/in", "parquet", messages.schema, 1)
    write_updates(stream_latest_results(stream, "7 days"), f"{base}/out", f"{base}/check", once=True).awaitTermination()
    updates = spark.read.parquet(f"{base}/out")
    keys = ["job_id", "service", "chunk_idx"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct("seq", "pii_matches"), "batch").alias("l")).select(*keys, "l.*")
    assert last.exceptAll(want.select(*keys, "seq", "pii_matches")).count() == 0 and last.count() == want.count()


def test_the_session_keeps_its_own_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


class Store:
    """A state store in memory that counts the calls to it."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def state(self, name, *_):
        store = self

        class State:
            def _called(self, key, value=None, act=dict.get):
                store.calls += 1
                return act(store.values, (name, key)) if value is None else store.values.__setitem__((name, key), value)

            def get(self):
                return self._called(None)

            def exists(self):
                return self._called(None) is not None

            def update(self, value):
                self._called(None, value)

            def getValue(self, key):
                return self._called(key)

            def updateValue(self, key, value):
                self._called(key, value)

            def clear(self):
                store.calls += 1
                for at in [k for k in store.values if k[0] == name]:
                    del store.values[at]

        return State()

    getMapState = getValueState = state


def test_calls_to_the_store_go_by_jobs(monkeypatch):
    """Two batches of a job with 6,000 chunks, repeated, out of order and one without a number."""
    monkeypatch.setattr("veilframe.streaming.state.MAX_BLOCKS", 3)  # blocks go to the store within a batch, too
    chunks = [*range(6000), None]
    parts = [[c for c in chunks if (c or 0) % 2 == k] for k in (0, 1)]
    store, tracker = Store(), JobTracker(None, None)
    tracker.init(store)
    told = []
    for part in parts:
        rows = [Row(service=s, chunk_idx=c, total_chunks=6001, needed=2, arrival=7) for c in part for s in ("regex", "processor")] * 2
        told.append(list(tracker.handleInputRows(("j",), iter(rows), None)))
    assert told[0] == [] and [tuple(r)[:4] for r in told[1]] == [("j", "complete", 12002, 12002)]
    assert store.calls < 60 and list(tracker.handleInputRows(("j",), iter(rows), None)) == []

    store, tracker = Store(), ProgressTracker(None)
    tracker.init(store)
    for part in parts:
        rows = [Row(chunk_idx=c, total_chunks=6001, failed=f, at_us=u) for c in part for f, u in ((False, 5), (None, None), (c == BLOCK + 1, 2_000_005))]
        (last,) = tracker.handleInputRows((1,), iter(rows), None)
    assert last == Row(job_id=1, processed_chunks=6000, total_chunks=6001, progress=49, status="failed", duration=2.0)
    assert store.calls < 40


def test_batches_go_by_bytes(spark, messages):  # noqa: F811
    base = workspace(spark, "bytes")
    store(messages, f"{base}/store", 8)
    events = track_jobs(read_message_stream(spark, f"{base}/store", "parquet", STORED_BY_ARRIVAL, max_bytes=1 << 20), None)
    write_updates(events, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    assert len(spark.read.parquet(f"{base}/store").inputFiles()) > 8 and done.select("batch").distinct().count() == 1
    assert {r.job_id for r in done.filter("status = 'complete'").collect()} == {f"job-{i}" for i in range(12)} - {"job-5"}
    with pytest.raises(ValueError):
        read_message_stream(spark, f"{base}/store", "parquet", STORED_BY_ARRIVAL, 1, max_bytes=1)


@pytest.fixture
def customers(spark, tmp_path, monkeypatch):
    spark.range(600).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr("contract.fixtures.CUSTOMERS_PER_TASK", 20)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were more
    yield Tables(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_messages_are_not_broadcast(customers):
    plan = all_messages(customers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_of_short_keys_are_dealt_out(spark, customers):
    assert customers.customers().rdd.getNumPartitions() == 30 and customers.customers().count() == 600
    assert all_findings(customers).rdd.getNumPartitions() >= 30


def test_a_bucket_of_the_store_is_written_by_many_tasks(spark, customers):
    path = _store(customers, workspace(spark, "spread"))
    files = spark.read.parquet(path).inputFiles()
    assert len([f for f in files if "job_bucket=0/" in f]) > 1


def test_state_of_expiring_jobs_is_on_disk(spark, customers, monkeypatch):
    seen = []
    monkeypatch.setattr("contract.queries.results.write_result_stream", lambda df, *_, **__: seen.append(spark.conf.get("spark.sql.streaming.stateStore.providerClass")) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["stream_expire_jobs"](spark, customers.sf_dir)
    assert "RocksDB" in seen[0]
