"""State kept by job, in the RocksDB store, with timers of its own.

What is kept is small: which reports are in, counts, times.  Texts and findings stay
in the message table.  A job with very many messages has bits of them in blocks in the
store, on disk, and never has to fit in one row.  The rows of a batch are folded before
they meet the store, so calls to it go by jobs and blocks, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilframe.operators.jobs import counts_for_readiness, services_needed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

JOB_EVENTS = "job_id string, status string, reports long, expected long, first_arrival int, last_arrival int"
PROGRESS = "job_id long, processed_chunks long, total_chunks int, progress int, status string, duration double"

#: Chunks are kept as bits, so many to an entry of the store: each call to the store is a round trip.
BLOCK = 4096
#: The block of messages without a chunk, beyond those of any int.
NO_CHUNK = 2**62
#: So many blocks are gathered before they go to the store.
MAX_BLOCKS = 10_000


def place(chunk_idx: int | None) -> tuple[int, int]:
    """A chunk's block and its bit in it."""
    return (NO_CHUNK, 1) if chunk_idx is None else (chunk_idx // BLOCK, 1 << chunk_idx % BLOCK)


def packed(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def unpacked(held: bytes) -> int:
    return int.from_bytes(held, "little")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class JobTracker(StatefulProcessor):
    """Tells once of each job: that it is complete, or that its time is over.

    A timer by the clock is set with a job's first message, so a job whose last
    messages never come is told of even if no other message comes either.  What is
    left of a job that was told of is a mark that keeps repeats from starting it
    anew; the mark has a time to live.
    """

    def __init__(self, timeout_ms: int | None, remember_ms: int | None):
        self.timeout_ms, self.remember_ms = timeout_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "service string, block long", "bits binary")
        self.figures = handle.getValueState("figures", "reports long, expected long, first int, last int, due long")
        self.told = handle.getValueState("told", "status string", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.told.exists():
            return
        held = self.figures.get()
        is_new = held is None
        if is_new:
            due = None
            if self.timeout_ms is not None:
                due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
                self.handle.registerTimer(due)
            held = (0, 0, None, None, due)
        reports, expected, first, last, due = held
        stored = not is_new  # whether there may be blocks of this job in the store
        blocks: dict[tuple, int] = {}
        for r in rows:
            first = r.arrival if first is None else min(first, r.arrival)
            last = r.arrival if last is None else max(last, r.arrival)
            if r.needed is None:  # a message that nobody waits for
                continue
            block, bit = place(r.chunk_idx)
            blocks[r.service, block] = blocks.get((r.service, block), 0) | bit
            expected = max(expected, (r.total_chunks or 0) * r.needed)
            if len(blocks) >= MAX_BLOCKS:
                reports += self._keep(self._news(blocks, stored))
                blocks, stored = {}, True
        news = self._news(blocks, stored)
        added = sum(n for _, n in news.values())
        figures = (reports + added, expected, first, last, due)
        if expected and reports + added >= expected:
            if due is not None:
                self.handle.deleteTimer(due)
            yield self._tell(key, "complete", figures, stored)
        else:
            self._keep(news)
            self.figures.update(figures)

    def _news(self, blocks: dict[tuple, int], stored: bool) -> dict[tuple, tuple[int, int]]:
        """The blocks that have changed, each with the number of places that are new in it."""
        news = {}
        for at, bits in blocks.items():
            held = self.seen.getValue(at) if stored else None
            before = 0 if held is None else unpacked(held[0])
            if bits | before != before:
                news[at] = (bits | before, (bits & ~before).bit_count())
        return news

    def _keep(self, news: dict[tuple, tuple[int, int]]) -> int:
        for at, (bits, _) in news.items():
            self.seen.updateValue(at, (packed(bits),))
        return sum(n for _, n in news.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        figures = self.figures.get()
        if figures is not None:
            yield self._tell(key, "incomplete", figures, True)

    def _tell(self, key, status: str, figures: tuple, stored: bool) -> Row:
        if stored:
            self.seen.clear()
            self.figures.clear()
        self.told.update((status,))
        reports, expected, first, last, _ = figures
        return Row(job_id=key[0], status=status, reports=reports, expected=expected, first_arrival=first, last_arrival=last)

    def close(self) -> None:
        pass


def _by_the_clock(ms: int | None) -> str:
    """Timers and times to live need batches without data, which a run that only works off what is there doesn't have."""
    return "None" if ms is None else "ProcessingTime"


def track_jobs(messages: DataFrame, timeout_ms: int | None, remember_ms: int | None = None) -> DataFrame:
    """One event per job, as a stream: complete or, `timeout_ms` after its first message, incomplete.

    None for runs that work off what is there and stop (`once`): no job expires, no mark
    is let go.  Timers keep a stream going, so such a run would never end with them.

    An event names the first and the last `arrival` of the job's messages, which is
    where the message table is to be searched for them.  Messages come in any order and
    any number of times.  Start the stream inside `rocksdb(spark)`.
    """
    methods = F.split("methods", ",")
    needed = F.when(counts_for_readiness(methods), services_needed(methods))
    small = messages.select("job_id", "service", "chunk_idx", "total_chunks", needed.alias("needed"), "arrival")
    tracker = JobTracker(timeout_ms, timeout_ms if remember_ms is None else remember_ms)
    return small.groupBy("job_id").transformWithState(tracker, JOB_EVENTS, "Update", _by_the_clock(timeout_ms))


class ProgressTracker(StatefulProcessor):
    """The progress of a job after each batch, from the status of its chunks in any order."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "block long", "seen binary, failed binary", self.keep_ms)
        self.figures = handle.getValueState(
            "figures", "processed long, total int, failed boolean, first_us long, last_us long", self.keep_ms
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.figures.get()
        stored = held is not None
        processed, total, any_failed, first, last = held if stored else (0, 0, False, None, None)
        blocks: dict[int, list[int]] = {}
        for r in rows:
            if r.failed is not None:  # else its outcome is not known yet
                block, bit = place(r.chunk_idx)
                bits = blocks.setdefault(block, [0, 0])
                bits[0] |= bit
                if r.failed:
                    bits[1] |= bit
                    any_failed = True
            if r.total_chunks is not None:
                total = max(total, r.total_chunks)
            if r.at_us is not None:
                first = r.at_us if first is None else min(first, r.at_us)
                last = r.at_us if last is None else max(last, r.at_us)
            if len(blocks) >= MAX_BLOCKS:
                processed += self._keep(blocks, stored)
                blocks, stored = {}, True
        processed += self._keep(blocks, stored)
        self.figures.update((processed, total, any_failed, first, last))
        status = "failed" if any_failed else "aggregating" if processed >= total else "processing"
        yield Row(
            job_id=key[0], processed_chunks=processed, total_chunks=total, progress=int(processed / total * 50) if total else None,
            status=status, duration=None if first is None else (last - first) / 1e6,
        )

    def _keep(self, blocks: dict[int, list[int]], stored: bool) -> int:
        """Store what is new; by how many chunks without a failure there are more now."""
        more = 0
        for block, (seen, failed) in blocks.items():
            held = self.chunks.getValue((block,)) if stored else None
            was_seen, was_failed = (0, 0) if held is None else map(unpacked, held)
            seen, failed = seen | was_seen, failed | was_failed
            if (seen, failed) != (was_seen, was_failed):
                self.chunks.updateValue((block,), (packed(seen), packed(failed)))
                more += (seen & ~failed).bit_count() - (was_seen & ~was_failed).bit_count()
        return more

    def close(self) -> None:
        pass


def stream_job_progress(chunk_status: DataFrame, keep_ms: int | None) -> DataFrame:
    """`job_progress` as a stream in update mode: a job's row comes anew with each batch that has news of it.

    Rows of job_id, chunk_idx, total_chunks, failed and ts may come late, twice and in
    any order; the last row of a job is what the batch form gives for all of them.
    State is let go `keep_ms` after it was last written; None, for runs that stop, keeps
    it.  Start inside `rocksdb(spark)`.
    """
    small = chunk_status.select(
        F.col("job_id").cast("long").alias("job_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), "total_chunks", "failed",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
    )
    return small.groupBy("job_id").transformWithState(ProgressTracker(keep_ms), PROGRESS, "Update", _by_the_clock(keep_ms))


def stream_latest_results(messages: DataFrame, delay: str) -> DataFrame:
    """`latest_chunk_result` as a stream in update mode: the message with the highest `seq` so far.

    The order of arrival does not matter.  Messages are folded before the shuffle, and
    state is let go once `delay` has passed since the job was submitted.
    """
    keys = ["job_id", "submitted_ts", "service", "chunk_idx"]
    rest = [c for c in messages.columns if c not in keys]
    timed = messages.withWatermark("submitted_ts", delay)
    last = timed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return last.select(*keys, "_last.*").select(*messages.columns)


def write_updates(updates: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each batch of updates to a folder of its own, overwritten if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    with rocksdb(updates.sparkSession):
        return writer.start()
