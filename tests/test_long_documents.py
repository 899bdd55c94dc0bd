"""Texts with very many values, spans and patterns: the same results, in time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from test_rewriting import NASTY, rewritten
from veilframe.catalog import PatternSpec
from veilframe.functions.literals import literal_index, present, required_literals
from veilframe.functions.patterns import pattern_findings
from veilframe.functions.replacing import replace_values
from veilframe.operators import spans, transform
from veilframe.operators.detection import docs_x_patterns, explain_patterns
from veilframe.operators.skew import fold_many_to_one
from veilframe.operators.transform import transform_data
from veilframe.plans.transform import transform_documents, transform_long_documents
from veilframe.schemas import SPANS


def one_by_one(text, values, tokens):
    for value, token in zip(values, tokens):
        text = text.replace(value, token) if value else text
    return text


# --- replacing ---------------------------------------------------------------
@pytest.mark.parametrize("alphabet", ["ab", "ab[]", "a*b", "e_fmail", "012 ", "é😀a"])
def test_one_walk_equals_one_by_one(alphabet):
    rng = random.Random(alphabet)
    made = [
        lambda v, i: "[t_" + format(hash((v, 1)) % 4096, "x") + "]", lambda v, i: f"[email_{i:03x}]", lambda v, i: "[email_ANONYMIZED]",
        lambda v, i: "*" * len(v), lambda v, i: v[::-1], lambda v, i: "",
    ]
    for n in range(600):
        values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 9))]
        token = made[n % len(made)]
        tokens = [token(v, i) for i, v in enumerate(values)]
        text = "".join(rng.choice(alphabet + " x") for _ in range(rng.randint(0, 60)))
        assert replace_values(text, values, tokens) == one_by_one(text, values, tokens), (text, values, tokens)


def test_fifty_thousand_values():
    values = [f"u{i * 7919 % 50_000}@example.com" for i in range(50_000)]
    tokens = [f"[email_{i:016x}]" for i in range(50_000)]
    text = ", ".join(values[::-1])
    begun = time.process_time()
    done = replace_values(text, values, tokens)
    assert time.process_time() - begun < 20
    assert done == ", ".join(tokens[::-1])


@pytest.mark.parametrize("method", ["pseudonymize", "anonymize", "tokenize", "mask"])
def test_rows_with_many_values(spark, method, monkeypatch):
    """Values that stand in tokens or at their edges too, with the rows of few values beside them."""
    monkeypatch.setattr(transform, "FEW_VALUES", 4)
    rows = [(i, text, [(type_, [v for v in values if v]), (type_ + "2", [v for v in values if v])]) for i, (values, type_, text) in enumerate(NASTY)]
    mails = [f"u{i}@e.fr" for i in range(200)]
    rows += [(50, " ".join(mails), [("email", mails), ("tail", ["u1", "@e.fr", "fr"])]), (51, None, [("t", ["a"] * 9)]), (52, "none", []), (53, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_matches array<struct<type:string,matches:array<string>>>")
    got = {r["doc_id"]: r["transformed_text"] for r in transform_data(df, "salt", method, "run").collect()}
    for i, text, found in rows:
        row = {"doc_id": i, "text": text, "pii_matches": [{"type": t, "matches": ms} for t, ms in found or []]}
        assert got[i] == (None if text is None else rewritten(row, method)[0])


def test_long_documents_are_rewritten_alike(docs):
    texts = ["card 4111 1111 1111 1111 " + " ".join(f"u{i}@example.com 555-{i:04d}" for i in range(n)) for n in (0, 3, 150)]
    for method in ("pseudonymize", "tokenize"):
        short = transform_documents(docs(*texts), "s", method, "run", chunk_size=400, overlap=40).collect()
        long = transform_long_documents(docs(*texts), "s", method, "run", chunk_size=400, overlap=40).collect()
        want = {r["doc_id"]: (r["transformed_text"], r["transformation_report"]) for r in short}
        assert {r["doc_id"]: (r["transformed_text"], r["transformation_report"]) for r in long} == want


# --- patterns ----------------------------------------------------------------
PATTERNS = {
    r"foo": {"foo"}, r"(?i)FOO\b": {"foo"}, r"ab?cd": {"cd"}, r"ab+cd": {"cd"}, r"(?:red|green)x": {"red", "green"}, r"(red|\d+)x": None, r"x(red)?yy": {"yy"},
    r"[a-z]+@acme\.com": {"@acme.com"}, r"\bkey\s*=\s*\d{3}": {"key"}, r"a{3}bc": {"bc"}, r"(abc){2,}": {"abc"}, r"(abc){0,2}d": None, r"(?=look)\w+": None,
    r"(?<!no)yes": {"yes"}, r"one|two|three": {"one", "two", "three"}, r"one|t\w+": None, r"\Qx.y\E": None, r"[[ab]c]dd": {"dd"}, r"[a&&b]cc": None, r"\p{L}{2}zz": {"zz"},
    r"(?x) a b": None, r"(?i:Kelvin)": {"kelvin"}, r"été": None, r"(?<n>tag)\d": {"tag"}, r"\x41bc": None, r"a.c": None, r"\d+": None, r"(?i)masſe": {"mas"}, r"a\-b\.c": {"a-b.c"},
    r"(?>atom)s?": {"atom"}, r"x*+yy": {"yy"}, r"": None, r"ab|": None, r"(?i)strasse|straße": {"strasse", "stra"},
}


def test_strings_that_hits_must_contain():
    assert {p: required_literals(p) for p in PATTERNS} == {p: s and frozenset(s) for p, s in PATTERNS.items()}


def test_index_runs_the_patterns_that_have_hits(spark, docs):
    """The same findings as running every pattern on every text."""
    rng = random.Random(8)
    words = ["foo", "FOO", "acd", "abbcd", "redx", "greenx", "12x", "xyy", "xredyy", "joe@acme.com", "key = 123", "aaabc", "abcabc", "look", "yes", "noyes", "one", "two", "TAG1", "tag1",
             "x.y", "add", "cdd", "bcc", "zozz", "KELVIN", "Kelvin", "été", "Abc", "a-b.c", "atoms", "mass", "maſse", "straße", "STRASSE", "ſtrasse", "İ", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(150)] + ["", None]
    names = {f"p{i:02d}": p for i, p in enumerate(PATTERNS) if p}
    table = spark.createDataFrame(list(names.items()), "name string, pattern string")
    got = docs_x_patterns(docs(*texts), table).select("doc_id", "findings")
    specs = [PatternSpec(n, p) for n, p in sorted(names.items())]
    want = docs(*texts).select("doc_id", pattern_findings(F.col("text"), specs).alias("findings"))
    assert {r[0]: r[1] for r in got.collect()} == {r[0]: r[1] for r in want.collect()}
    listed = dict(explain_patterns(table))
    assert listed["p00"] == ["foo"] and listed[next(n for n, p in names.items() if p == r"\d+")] == []


def test_ten_thousand_patterns(spark, docs):
    table = spark.range(10_000).selectExpr("format_string('p%05d', id) as name", r"concat('(?i)\\bname', id, 'x+\\b') as pattern")
    df = docs(*[f"text {i} name{i}xx and NAME{i * 3}x" for i in range(300)])
    rows = docs_x_patterns(df, table).collect()
    for r in rows:
        i = r["doc_id"]
        assert [(f["type"], f["matches"]) for f in r["findings"]] == sorted(
            [(f"p{i:05d}", [f"name{i}xx"])] + ([(f"p{i * 3:05d}", [f"NAME{i * 3}x"])] if i else [])
        ) or i == 0
    none = docs_x_patterns(df, table.limit(0)).first()["findings"]
    assert none == []


def test_an_index_finds_all_strings_of_a_text():
    rng = random.Random(4)
    strings = {i: frozenset("".join(rng.choice("abk") for _ in range(rng.randint(2, 4))) for _ in range(2)) for i in range(40)}
    index = literal_index(strings)
    for _ in range(200):
        text = "".join(rng.choice("abkKK ") for _ in range(20))
        folded = text.lower().replace("K", "k")
        assert present(index, text) == [i for i, some in strings.items() if any(s in folded for s in some)]


# --- spans -------------------------------------------------------------------
def test_spans_are_cut_as_substrings(spark, docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé😀 \n日") for _ in range(n)) for n in (0, 1, 999, 1000, 1001, 5000)]
    rows = [(d, 0, o, "X", s, s + rng.choice([-2, 0, 1, 7, 1000, 2500]), 0.5) for d, t in enumerate(texts) for o, s in enumerate([0, *[rng.randint(0, len(t) + 3) for _ in range(40)]])]
    rows += [(5, 0, 90, "X", -3, 2, 0.5), (5, 0, 91, "X", None, 4, 0.5)]
    chunks = docs(*texts).withColumn("chunk_idx", F.lit(0))
    table = spark.createDataFrame(rows, SPANS)
    want = table.join(chunks, ["doc_id", "chunk_idx"]).withColumn("value", F.expr("substring(text, span_start + 1, span_end - span_start)")).drop("text")
    got = spans.span_texts(chunks, table)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_hundred_thousand_spans_of_one_text(spark):
    text = F.repeat(F.lit("Ann Lee of ACME, é. "), 500_000)
    chunks = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"), text.alias("text"))
    at = (F.col("id") * 100).cast("int")
    table = spark.range(100_000).select(
        F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.col("id").cast("int").alias("ord"), F.lit("PERSON").alias("label"),
        at.alias("span_start"), (at + 7).alias("span_end"), F.lit(0.5).alias("score"),
    )
    begun = time.time()
    found = spans.detect_ner(chunks, table)
    assert found.filter(F.col("matches") == F.array(F.lit("Ann Lee"))).count() == 100_000
    assert time.time() - begun < 60


def test_folds_of_hot_keys(spark):
    """A third of all rows under one key; folds stay near the size asked for and lose nothing."""
    many = spark.range(0, 6000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.col("id")).alias("v")
    )
    one = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    folds = fold_many_to_one(many, one, ["doc_id"], 100).cache()
    assert folds.agg(F.max(F.size("items"))).first()[0] < 600 and folds.filter("doc_id = 7").count() > 5
    got = folds.select("doc_id", "text", F.inline("items"))
    want = many.join(one, "doc_id").select("doc_id", "text", "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_patterns_of_other_engines_are_left_to_spark():
    for pattern in ("(", "a)", "[", "a{", "*a", "(?<", "\\"):
        assert required_literals(pattern) is None
    assert re.fullmatch("x", "x")
