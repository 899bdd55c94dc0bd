"""The message log: every row once, also where a batch of either side fails and runs again."""

import glob
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilframe.schemas import MESSAGE
from veilframe.sources.message_log import Folder, LogStreamReader, LogWriter, Written, register_message_log
from veilframe.sources.messages import as_messages
from veilframe.workspace import workspace


@pytest.fixture
def base(spark):
    register_message_log(spark)
    path = workspace(spark, "log")
    rows = [(f"job-{i % 7}", "regex", i, float(i)) for i in range(60)]
    made = spark.createDataFrame(rows, "job_id string, service string, chunk_idx int, x double")
    finding = "array(named_struct('type', 'email', 'matches', array(job_id), 'detection_method', 'regex', 'confidence', x, " \
        "'location', named_struct('start', 1, 'end', 2), 'country', null, 'description', null))"
    full = as_messages(made.withColumn("pii_matches", F.expr(finding)).withColumn("submitted_ts", F.timestamp_seconds("chunk_idx")))
    for part in range(6):  # six files, one a batch
        full.filter(F.col("chunk_idx") % 6 == part).coalesce(1).write.parquet(f"{path}/in/{part}")
    return path


def source(spark, base, per_batch=1):
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_batch).parquet(f"{base}/in/*")


def fill(spark, base, stream=None, per_batch=1):
    writer = (source(spark, base, per_batch) if stream is None else stream).repartition(3, "chunk_idx").writeStream.format("message_log")
    writer.option("path", f"{base}/log").option("checkpointLocation", f"{base}/wcheck").trigger(availableNow=True).start().awaitTermination()


def everything(spark, base):
    return spark.read.parquet(*sorted(glob.glob(f"{base}/in/*")))


def same(a, b):
    key = lambda df: sorted(map(str, df.select(*MESSAGE.names).collect()))
    return key(a) == key(b)


def test_round_trip_with_nested_columns(spark, base):
    fill(spark, base)
    log = spark.read.format("message_log").option("path", f"{base}/log").load()
    assert log.schema == MESSAGE and same(log, everything(spark, base))
    assert Folder(f"{base}/log").batches() == list(range(6))
    query = spark.readStream.format("message_log").option("path", f"{base}/log").load().writeStream.format("parquet")
    query.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    assert same(spark.read.schema(MESSAGE).parquet(f"{base}/out"), everything(spark, base))


def test_a_reader_replays_a_failed_batch_and_keeps_its_step(spark, base):
    fill(spark, base)
    seen = []

    def run(fail_at):
        def write(batch, batch_id):
            rows = [r.chunk_idx for r in batch.collect()]
            if batch_id == fail_at:
                raise RuntimeError("lost")
            seen.append((batch_id, sorted(rows)))

        stream = spark.readStream.format("message_log").option("path", f"{base}/log").option("max_batches", 2).load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/check").start()
        try:
            query.awaitTermination(60) if fail_at is not None else [query.processAllAvailable(), query.stop()]
        finally:
            query.stop()

    with pytest.raises(StreamingQueryException):
        run(1)
    assert [i for i, _ in seen] == [0] and len(seen[0][1]) == 20
    run(None)  # batch 1 again from the checkpoint, then on by two
    assert [i for i, _ in seen] == [0, 1, 2] and [len(r) for _, r in seen] == [20, 20, 20]
    assert sorted(x for _, r in seen for x in r) == list(range(60))
    (at,) = [json.load(open(p)) for p in glob.glob(f"{base}/log/readers/*.json")]
    assert at == 6
    with pytest.raises(ValueError, match="stands before"):
        LogStreamReader(f"{base}/log", 1, "other").partitions({"next": 6}, {"next": 1})
    # more comes in while nobody reads; a query that starts again is held to its step as well
    for part in range(6, 11):
        everything(spark, base).limit(5).coalesce(1).write.parquet(f"{base}/in/{part}")
    fill(spark, base)
    run(None)
    assert [len(r) for _, r in seen[3:]] == [10, 10, 5]


def test_a_writer_that_runs_a_batch_again_does_not_double_it(spark, base):
    fill(spark, base, per_batch=2)
    last = max(glob.glob(f"{base}/wcheck/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    files = sorted(os.listdir(f"{base}/log/data"))
    os.remove(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc")
    os.remove(last)  # as if the query had been lost between the sink's commit and its own
    fill(spark, base, per_batch=2)
    log = spark.read.format("message_log").option("path", f"{base}/log").load()
    assert same(log, everything(spark, base)) and sorted(os.listdir(f"{base}/log/data")) == files


def test_a_failed_write_leaves_nothing_to_see(spark, base):
    @F.udf("string")
    def broken(service, chunk):
        if chunk == 40:
            raise ValueError("bad row")
        return service

    bad = source(spark, base).withColumn("service", broken("service", "chunk_idx"))
    with pytest.raises(StreamingQueryException):
        fill(spark, base, bad)
    got = spark.read.format("message_log").option("path", f"{base}/log").load()
    held = {r.chunk_idx for r in got.collect()}
    assert 40 not in held and len(held) % 10 == 0
    fill(spark, base)  # the same checkpoint, mended
    assert same(spark.read.format("message_log").option("path", f"{base}/log").load(), everything(spark, base))


def test_commit_and_abort_by_batch(spark, base):
    path, folder = f"{base}/small", Folder(f"{base}/small")
    writer = LogWriter(path)
    assert writer.write(iter(())) == Written(None) and not folder.exists(folder.at("data"))
    writer.commit([Written(None), None], 0)
    assert folder.batches() == [0] and LogStreamReader(path, None, "r").partitions({"next": 0}, {"next": 1}) == []
    assert LogStreamReader(f"{base}/none", None, "r").latestOffset() == {"next": 0}
    assert spark.read.format("message_log").option("path", f"{base}/none").load().count() == 0
    writer.abort([Written("gone.parquet"), None], 1)
    assert folder.batches() == [0]
