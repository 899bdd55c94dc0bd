"""Files read in splits give the chunks of files read whole."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from veilframe.operators.chunking import chunk_documents
from veilframe.sources.documents import read_text_documents
from veilframe.sources.long_files import read_chunks, read_lines


def samples():
    rng = random.Random(12)
    parts = [b"word ", "é日😀".encode(), b"\n", b"\r\n", b"\r", b"\xff\xfe", b"\xe2\x82", b"x" * 30, b"\n\n", b" ", b"\xed\xa0\x80", b"\xf0\x9f\x98"]
    for i in range(6):
        yield f"mixed-{i}.txt", b"".join(rng.choice(parts) for _ in range(2500)) + rng.choice([b"", b"\n", b"\r\n", b"\r"])
    yield "bom.txt", "﻿one\ntwo\n".encode()
    yield "bom-open.txt", "﻿one\r\ntwo\r".encode()
    yield "open.txt", b"no end"
    yield "one.txt", b"\n"
    yield "long-line.txt", b"0123456789" * 3000
    yield "exact.txt", b"abcdefg" * 10
    yield "empty.txt", b""


@pytest.fixture
def folder(tmp_path):
    for name, content in samples():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def normal(df):
    return sorted((r["path"].rsplit("/", 1)[1], r["file_size"], r["chunk_idx"], r["total_chunks"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("size, overlap", [(100, 20), (7, 3), (35, 35), (1000, 0), (10**6, 10), (16, 50)])
def test_chunks_equal_those_of_whole_files(spark, folder, small_splits, size, overlap):
    whole = chunk_documents(read_text_documents(spark, folder, "*.txt"), size, overlap)
    assert normal(read_chunks(spark, folder, "*.txt", size, overlap)) == normal(whole)


def test_lines_come_from_many_splits(spark, folder, small_splits):
    lines = read_lines(spark, folder, "mixed-*.txt")
    for r in lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("l"), F.max("total").alias("total")).collect():
        at = 0
        for line in r["l"]:
            assert line["start"] == at
            at += len(line["text"])
        assert at == r["total"]
    from veilframe.sources.long_files import _lines

    assert _lines(spark, folder, "mixed-*.txt").select("path", "block").distinct().count() > 30


@pytest.mark.parametrize("size, overlap", [(100, 20), (1000, 0), (10**6, 10)])
def test_a_folder_of_parts_is_one_text(spark, tmp_path, small_splits, size, overlap):
    rng = random.Random(5)
    for name in ("a", "b"):
        parts = ["".join(rng.choice(["word ", "é日😀", "\n", "\r\n", "\r", "\n\n"]) for _ in range(rng.choice([3, 900]))) + rng.choice(["\n", "\r\n"]) for _ in range(5)]
        parts[0] = "\ufeff" + parts[0]
        (tmp_path / "parts" / name).mkdir(parents=True)
        (tmp_path / "files").mkdir(exist_ok=True)
        for i, part in enumerate(parts):
            (tmp_path / "parts" / name / f"part-{i:05d}.txt").write_bytes(part.encode())
        (tmp_path / "files" / name).write_bytes("".join(parts).encode())
    whole = chunk_documents(read_text_documents(spark, str(tmp_path / "files")), size, overlap)
    assert normal(read_chunks(spark, str(tmp_path / "parts"), "*.txt", size, overlap, parts=True)) == normal(whole)


def dealt(df) -> list[tuple[str, str]]:
    """What each exchange deals its rows by, and the columns it moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [(by, given) for given, by in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(([^()]*), \d+\)", plan)]


def test_lines_move_to_their_split(spark, folder, small_splits):
    """No task gets the lines of a file, however large it is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [by for by, given in dealt(read_lines(spark, folder, "*.txt")) if re.search(r"\b(text|value)#", given)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and all("block#" in by for by in moved)


def test_a_language_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [(i, "en", f"text {i} " * 50) for i in range(2000)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr("contract.queries.workspace", lambda *_: str(tmp_path / "files"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were more
    try:
        rows = queries()["read_chunks"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "files" / "lang=en").glob("part-*.txt"))) > 1
    text = "".join(f"{t}\n" for _, _, t in texts)
    want = {n: hashlib.md5(text[max(n * 1000 - 100, 0) : (n + 1) * 1000].encode()).hexdigest() for n in range(-(-len(text) // 1000))}
    assert {r.chunk_idx: r.text_md5 for r in rows} == want and {(r.lang, r.total_chunks) for r in rows} == {("en", len(want))}


def test_wrong_size(spark, folder):
    with pytest.raises(ValueError):
        read_chunks(spark, folder, chunk_size=0)
