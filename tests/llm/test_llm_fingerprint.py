import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import fingerprint
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows_per_stretch", [500, 7])
def test_whole_table(spark, monkeypatch, rows_per_stretch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_STRETCH", rows_per_stretch)
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    want = {}
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    rows = QUERIES["op8_fingerprints"](spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    by, text = {r.doc_id: r.fingerprint for r in rows}, dict(docs)
    assert len(set(by.values())) == len({tuple(sorted(t.split("\n"))) for t in text.values()})
    ids = [i for i, _ in docs]
    for r in rows:
        after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (by[after] != r.fingerprint or r.near_next == 1)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_order_insertion_and_deletion(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["é 😀"] * 3
    whole, part, rest = "\n".join(lines), "\n".join(lines[:15]), "\n".join(lines[15:])
    shuffled = "\n".join(rng.sample(lines, len(lines)))
    df = spark.createDataFrame([(whole, part, rest, shuffled, whole + "x")], "w string, p string, r string, s string, o string")
    v = df.select(*[fingerprint.hashes(F.col(c)).alias(c) for c in df.columns]).select(*[fingerprint.vector(F.col(c)).alias(c) for c in df.columns])
    row = v.select("w", "p", "s", "o", "r", fingerprint.insert(v.p, v.r).alias("both"), fingerprint.delete(v.w, v.r).alias("less"), fingerprint.delete(v.p, v.p).alias("none")).first()
    assert row.w == row.s == row.both and row.p == row.less and row.w != row.o and set(row.none) == {0}
    assert max(row.w[:8]) < 1 << 32


def test_likeness(spark):
    rng = random.Random(6)
    a = [f"{rng.random()} x{i} y z" for i in range(400)]
    b = [f"{rng.random()} u{i} y z" for i in range(400)]
    df = spark.createDataFrame([("\n".join(a), "\n".join(a[:200] + b[:200]), "\n".join(b), "")], "a string, half string, b string, e string")
    v = df.select(*[fingerprint.hashes(F.col(c)).alias(c) for c in df.columns]).select(*[fingerprint.signed(fingerprint.vector(F.col(c))).alias(c) for c in df.columns])
    near = fingerprint.likeness
    got = v.select(near(v.a, v.a).alias("aa"), near(v.a, v.half).alias("ah"), near(v.a, v.b).alias("ab"), near(v.a, v.e).alias("ae"), near(v.e, v.e).alias("ee")).first()
    assert got.aa == got.ee == 1 and got.ae == 0 and 0.2 < got.ah < 0.8 and got.ab < 0.4


def test_next_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_STRETCH", 2)
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3, 10**12, -5, *range(100, 130)]), f"t{i:03d}") for i in range(150)] + [(3, "t0")] * 5
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(((r.doc_id, r.text, r.next.text) for r in got), key=str) == sorted(want, key=str)


def test_edges(edge_rows, no_rows):
    rows = fingerprint.fingerprint_documents(edge_rows).collect()
    assert len(rows) == edge_rows.count()
    assert {r.fingerprint for r in rows if not r.text} == {"0" * (64 + 16 * 33)}
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 4)}) == 1
    follows = fingerprint.with_next(edge_rows, "doc_id", "text")
    assert follows.count() == edge_rows.count() and "row" in follows.columns
    assert fingerprint.fingerprint_documents(no_rows).count() == fingerprint.with_next(no_rows, "doc_id", "text").count() == 0
