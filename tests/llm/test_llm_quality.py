import math
import random
import re
from collections import Counter

import pytest

from veilframe.llm import quality
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    full = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(spark):
    rng = random.Random(9)
    parts = [*"ab \n\t\x0b\x0c\r#|é😀", "   ", "a a a a a a a a a ", "x\n", "one two three four five six seven eight "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "a " * 3000]
    rows = quality.judge_quality(spark.createDataFrame([(t,) for t in texts], "text string"), lang=None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == brute(r.text), r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_quality"](spark, SF).collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in rows} == {i: brute(t) for i, t in texts.items()}


def test_distance(spark):
    row = spark.sql("select array(1L, 1L, 2L) a, array(2L, 0L, 2L) b, array(0L, 0L, 0L) z, array(0L, 9L, 0L) c, array(3L, 0L, 0L) d")
    got = row.select(quality.js_distance(row.a, row.b).alias("ab"), quality.js_distance(row.a, row.z).alias("az"), quality.js_distance(row.c, row.d).alias("cd"), quality.js_distance(row.a, row.a).alias("aa")).first()
    p, q = [0.25, 0.25, 0.5], [0.5, 0.0, 0.5]
    want = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2
    assert got.ab == pytest.approx(math.sqrt(want)) and got.az is None and got.cd == pytest.approx(1) and got.aa == 0


def test_keeps_clean_documents_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.999 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_edges(edge_rows, no_rows):
    rows = quality.judge_quality(edge_rows).collect()
    assert len(rows) == edge_rows.count()
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == brute(r.text) and r.kept in (True, False)
    assert quality.judge_quality(no_rows).count() == 0
