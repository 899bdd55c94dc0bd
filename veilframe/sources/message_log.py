"""Messages in a shared folder as a streaming source and sink, with offsets and commits.

    register_message_log(spark)
    df.writeStream.format("message_log").option("path", p).option("checkpointLocation", c).start()
    spark.readStream.format("message_log").schema(MESSAGE).option("path", p).option("max_batches", 4).load()

A log has one writer.  Its tasks put their rows into Parquet files under `data/`; a
batch is there once its list of files is, `batches/<batch id>.json`.  A batch that runs
again finds its list and leaves its own files unlisted, so nothing is doubled; a batch
that fails has no list, so nothing of it is seen.  Offsets are batch ids, and what a list
names never changes, so a reader that runs a batch again gets the same rows.

Only lists pass through the driver, rows never.  The folder is one that pyarrow opens:
a path that all machines share, or an address such as s3://, gs:// or hdfs://.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from veilframe.schemas import MESSAGE

FORMAT = "message_log"
BATCH_ROWS = 10_000


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; no file if it had no rows."""

    file: str | None


class Folder:
    """The files of one log."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(path)
        else:
            self.files, self.root = fs.LocalFileSystem(), path
        self.root = self.root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self.files.get_file_info(path).type != fs.FileType.NotFound

    def put(self, path: str, content) -> None:
        """Write a small file so that it is there whole or not at all."""
        folder, name = path.rsplit("/", 1)
        self.files.create_dir(folder, recursive=True)
        passing = f"{folder}/.{uuid.uuid4().hex}-{name}"
        with self.files.open_output_stream(passing) as out:
            out.write(json.dumps(content).encode())
        self.files.move(passing, path)

    def get(self, path: str):
        with self.files.open_input_stream(path) as file:
            return json.loads(file.read())

    def remove(self, names: Iterable[str]) -> None:
        for name in names:
            if self.exists(self.at("data", name)):
                self.files.delete_file(self.at("data", name))

    def list_of(self, batch: int) -> str:
        return self.at("batches", f"{batch:020d}.json")

    def batches(self) -> list[int]:
        """Ids of the batches that are there, ascending."""
        found = self.files.get_file_info(fs.FileSelector(self.at("batches"), allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if not f.base_name.startswith(".") and f.base_name.endswith(".json"))

    def splits(self, batches: Iterable[int]) -> list[InputPartition]:
        return [InputPartition(name) for b in batches for name in self.get(self.list_of(b))]

    def rows(self, split: InputPartition) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(self.at("data", split.value)) as file:
            yield from pq.ParquetFile(file).iter_batches(BATCH_ROWS)


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        # a reader without partitions would be asked for one that is None
        return folder.splits(folder.batches()) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.value is None else Folder(self.path).rows(partition)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {"next": id of the first batch not yet read}.

    Spark does not tell a Python source where a query stands when it asks how far to go,
    so the end of the last planned batch is kept in `readers/<reader>.json`: a query that
    starts again goes on from there by `max_batches`, too.  The row ranges come from
    Spark's own checkpoint; the file only limits the next step, and a name that is not
    the query's is an error before it could double a row.
    """

    def __init__(self, path: str, max_batches: int | None, reader: str):
        self.path, self.max_batches, self.reader = path, max_batches, reader

    def _place(self, folder: Folder) -> str:
        return folder.at("readers", f"{self.reader}.json")

    def _planned(self, folder: Folder, end: int) -> None:
        folder.put(self._place(folder), end)

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        there = folder.batches()
        end = there[-1] + 1 if there else 0
        if self.max_batches is not None:
            at = folder.get(self._place(folder)) if folder.exists(self._place(folder)) else 0
            some = [b for b in there if b >= at][: self.max_batches]
            end = some[-1] + 1 if some else at
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["next"] < start["next"]:
            raise ValueError(f"reader {self.reader!r} of {self.path} stands before this query; give the query a name of its own")
        folder = Folder(self.path)
        if end["next"] > start["next"]:
            self._planned(folder, end["next"])
        return folder.splits(b for b in folder.batches() if start["next"] <= b < end["next"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return Folder(self.path).rows(partition)

    def commit(self, end: dict) -> None:
        pass  # the log is kept; who owns it clears it


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, out, sink = Folder(self.path), f"{uuid.uuid4().hex}.parquet", None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    folder.files.create_dir(folder.at("data"), recursive=True)
                    sink = folder.files.open_output_stream(folder.at("data", name))
                    out = pq.ParquetWriter(sink, batch.schema)
                out.write_batch(batch)
        except BaseException:
            if sink is not None:
                sink.close()
                folder.remove([name])
            raise
        if out is None:
            return Written(None)
        out.close()
        sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        folder, names = Folder(self.path), _names(messages)
        if folder.exists(folder.list_of(batchId)):  # the batch was committed before the query could note it
            folder.remove(set(names) - set(folder.get(folder.list_of(batchId))))
        else:
            folder.put(folder.list_of(batchId), names)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).remove(_names(messages))


def _names(messages: list[Written | None]) -> list[str]:
    return sorted(m.file for m in messages if m is not None and m.file is not None)


class MessageLog(DataSource):
    """Options: `path`; for streams that read, `max_batches` of the log per batch (by default all
    that are there) and `reader`, a name that the query (its checkpoint) has for itself and keeps.

    Leave `max_batches` out in runs that work off what is there and stop: Spark asks a
    Python source once how far such a run goes.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return MESSAGE

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema: StructType) -> LogStreamReader:
        most = self.options.get("max_batches")
        if most is not None and int(most) < 1:
            raise ValueError("max_batches must be at least 1")
        return LogStreamReader(self.options["path"], None if most is None else int(most), self.options.get("reader", "default"))

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])


def register_message_log(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MessageLog)
