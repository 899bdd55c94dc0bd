import random
from collections import Counter

import pytest

from check import compare, duck
from veilframe.llm import lines, mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_mixing", "op5_lines", "op9_warc"])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, duck(SF), SF, name) is None


def brute_lines(rows, size=3):
    blank = " \t\n\x0b\x0c\r"
    first, out = {}, []
    for doc_id, text in sorted(rows):
        full = [(i, x.strip(blank)) for i, x in enumerate((text or "").split("\n")) if x.strip(blank)]
        gone = set()
        for k in range(len(full) - size + 1):
            window = tuple(x for _, x in full[k : k + size])
            if first.setdefault(window, (doc_id, full[k][0])) != (doc_id, full[k][0]):
                gone.update(range(full[k][0], full[k + size - 1][0] + 1))
        out.append((doc_id, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(500, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == brute_lines(rows)
    assert {x for _, t in rows if t for x in t.split("\n")} - {""} <= {x for r in got if r.text for x in r.text.split("\n")} | {" a ", "a"}


def test_lines_edges(edge_rows, no_rows):
    done = lines.dedup_lines(edge_rows)
    assert sorted(done.columns) == sorted([*edge_rows.columns, "n_removed"])
    got = done.collect()
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 2)}
    assert len(got) == edge_rows.count() and by[6].text is None and by[7].text == "a\nb\nc\nd" and by[8].text == "x\ny"
    assert by[4].text == "" and by[3].text != "" and by[7]["a.b"] == "dot"
    assert lines.dedup_lines(no_rows).count() == 0


def test_rates_meet_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id < 4000, 'hot', if(id < 5500, 'b', null)) as source", "repeat('x', 9) as text")
    mixed = mixing.mix_sources(docs, {"hot": 1.0, "b": 1.0, None: 2.0})
    n = Counter(r.source for r in mixed.select("source").collect())
    assert abs(n["hot"] - 1500) < 150 and abs(n["b"] - 1500) < 150 and abs(n[None] - 3000) < 250
    assert Counter(r.source for r in mixing.mix_sources(docs, {"b": 1.0}, total=15000.0).select("source").collect()).keys() == {"b"}
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)
    again = mixing.mix_sources(docs, {"hot": 1.0, "b": 1.0, None: 2.0})
    assert sorted(r.shuffle_key for r in again.select("shuffle_key").collect()) == sorted(keys)


def test_many_sources_are_joined_with_salt(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 7) as source", "'text' as text")
    want = sorted((r.doc_id, r.copy) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 0)
    assert sorted((r.doc_id, r.copy) for r in mixing.mix_sources(docs).collect()) == want


def test_poisson_steps(spark):
    rates = spark.createDataFrame([(0.0,), (0.3,), (2.0,), (900.0,)], "rate double").selectExpr("struct(rate) as source_key", "rate")
    for r in mixing.poisson_steps(rates).collect():
        assert abs(r.steps[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(r.steps, r.steps[1:]))
        mean = sum(k * (c - p) for k, (p, c) in enumerate(zip([0.0, *r.steps], r.steps)))
        assert abs(mean - r.rate) < 1e-6


def test_steps_of_large_rates_are_few(spark):
    """A source of one character beside 100 TB has a rate of ten million."""
    rates = spark.createDataFrame([(4_999.0,), (5_001.0,), (1e7,), (1e9,)], "rate double").selectExpr("struct(rate) as source_key", "rate")
    for r in mixing.poisson_steps(rates).collect():
        assert len(r.steps) <= 24 * r.rate**0.5 + 200 + (r.rate if r.rate < 5000 else 0)
        assert abs(r.steps[-1] - 1) < 1e-4 and r.steps[0] < 1e-12
        mean = sum((r.least + k) * (c - p) for k, (p, c) in enumerate(zip([0.0, *r.steps], r.steps))) / r.steps[-1]
        assert abs(mean - r.rate) < 1e-3 * r.rate**0.5
        variance = sum((r.least + k - mean) ** 2 * (c - p) for k, (p, c) in enumerate(zip([0.0, *r.steps], r.steps))) / r.steps[-1]
        assert abs(variance / r.rate - 1) < 1e-3
    with pytest.raises(Exception, match="repeated over"):
        mixing.poisson_steps(rates.selectExpr("source_key", "rate * 2 as rate")).collect()


def test_a_document_of_many_copies(spark):
    docs = spark.createDataFrame([(1, "tiny", ""), (2, "big", "x" * 40_000)], "doc_id long, source string, text string")
    rows = mixing.mix_sources(docs, {"tiny": 1.0, "big": 1.0}).groupBy("doc_id").agg({"copy": "max", "*": "count"}).collect()
    tiny = next(r for r in rows if r.doc_id == 1)
    assert tiny["max(copy)"] == tiny["count(1)"] and abs(tiny["count(1)"] - 20_000) < 1000


def test_mixing_edges(edge_rows, no_rows):
    mixed = mixing.mix_sources(edge_rows, total=100_000_000.0)
    assert sorted(mixed.columns) == sorted([*edge_rows.columns, "copy", "shuffle_key"])
    assert mixed.count() > 0 and mixing.mix_sources(no_rows).count() == 0
