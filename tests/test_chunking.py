import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.text import natural_break
from veilframe.operators.chunking import chunk_at_breaks, chunk_documents, reassemble_chunks, single_chunk

RNG = random.Random(3)
TEXTS = ["", "a", "😀" * 25, "ab😀\n" * 13, "x" * 10, "x" * 20, "no break here " * 9] + [
    "".join(RNG.choice("ab .!?\n\té😀") for _ in range(RNG.randint(1, 90))) for _ in range(60)
]


def chunks_of(text, size, overlap):
    pieces = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    return [(pieces[i - 1][-overlap:] if i and overlap else "") + p for i, p in enumerate(pieces)]


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (7, 7), (5, 9), (1000, 100)])
def test_chunks_and_back(docs, size, overlap):
    df = docs(*TEXTS)
    chunks = chunk_documents(df, size, overlap)
    got = {}
    for r in chunks.orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["total_chunks"] == len(chunks_of(TEXTS[r["doc_id"]], size, overlap))
    assert [got[i] for i in range(len(TEXTS))] == [chunks_of(t, size, overlap) for t in TEXTS]
    back = reassemble_chunks(chunks, size, overlap).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == TEXTS


def test_single_chunk_counts_bytes(docs):
    rows = single_chunk(docs("é" * 5, "e" * 9, "e" * 10), 10).orderBy("doc_id").collect()
    assert [r["is_single"] for r in rows] == [False, True, False]


def break_of(text, position, window):
    marks = ".!?\n\r\t"
    for i in range(position, min(len(text), position + window)):
        if text[i] in marks:
            return i + 1
    for i in range(min(position, len(text)) - 1, max(0, position - window) - 1, -1):
        if text[i] in marks:
            return i + 1
    return position


def test_natural_break(docs):
    at = docs(*TEXTS).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("p"))
    rows = at.withColumn("b", natural_break(F.col("text"), F.col("p"), 6)).collect()
    assert all(r["b"] == break_of(r["text"], r["p"], 6) for r in rows) and len(rows) > 1000


def test_cuts_at_breaks(docs):
    size, window = 12, 6
    got = {}
    for r in chunk_at_breaks(docs(*TEXTS), size, window).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in enumerate(TEXTS):
        cuts = sorted({0, len(text)} | {break_of(text, p, window) for p in range(size, len(text), size)})
        assert got[i] == ([text[a:b] for a, b in zip(cuts, cuts[1:])] or [""])
    with pytest.raises(ValueError):
        chunk_at_breaks(docs("x"), 10, 6)


def test_null_text_has_no_chunks(docs):
    assert chunk_documents(docs(None, "x"), 5, 1).count() == 1


def test_many_width_changes_do_not_overflow(docs):
    text = "a😀" * 60000
    assert chunk_documents(docs(text), 100000, 1000).select("text").collect()[0][0] == text[:100000]
