"""Hits against the third-party regex module and hand-made rows."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from veilframe import catalog
from veilframe.functions import patterns as fp
from veilframe.operators.detection import (
    detect_argentina,
    detect_international,
    detect_regex,
    detect_regex_scored,
    docs_x_patterns,
)

SPECS = catalog.general_specs() + catalog.argentina_specs()
BITS = [
    "123-45-6789", "AB123456", "A1234567", "ABC1234567", "x.y+z@mail.example.org", "a@b.c|d", "(206) 555-0006", "206-555-0006",
    "+1 206.555.0006", "12 Elm Street", "7 Ave", "4111 1111 1111 1111", "4111111111111111", "123456789", "12-3456789",
    "123 45 6789", "34960099", "22.105.779", "25-042-095", "20-22375732-5", "23-22375732-9", "27223757321", "AAA732750", "ZZZ123456",
    "11111111", "12345678N", "DNI", "d.n.i", "pasaporte argentino", "Passport No", "travel document", "٣٤٥-١٢-٦٧٨٩", "é", "😀",
    "\n", "\t", "  ", "-", ".", ",", "@", "$", "word", "Straße", " ", "_", "9", "2024",
]


def texts(n=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", "; "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def expected(spec, text):
    return [m.group(0) for m in regex.finditer(spec.pattern, text)]


def test_every_pattern_agrees_with_the_regex_module(docs):
    sample = texts()
    found = docs(*sample).select("doc_id", *[fp.find_spec(F.col("text"), s).alias(s.name) for s in SPECS]).collect()
    hits = 0
    for row in found:
        for spec in SPECS:
            want = expected(spec, sample[row["doc_id"]])
            assert row[spec.name] == want, (spec.name, sample[row["doc_id"]])
            hits += len(want)
    assert hits > 500


def test_shortcuts_do_not_change_findings(docs):
    """Shapes, literals and the digit test only save time."""
    sample = texts(300, 11)
    rows = detect_regex(docs(*sample), ["AR"]).collect()
    for row in rows:
        text = sample[row["doc_id"]]
        want = []
        for spec in SPECS:
            hits = expected(spec, text)
            if hits and (spec.context is None or regex.search(spec.context.replace("(?i)", ""), text, regex.I)):
                want.append((spec.name, hits, spec.method, spec.confidence, spec.country))
        got = [(f["type"], f["matches"], f["detection_method"], f["confidence"], f["country"]) for f in row["findings"]]
        assert got == want, text


def test_documented_examples(docs):
    sample = [f"DNI, passport {info['example']} end" for info in catalog.ARGENTINA_PATTERNS.values()]
    rows = detect_argentina(docs(*sample)).orderBy("doc_id").collect()
    for row, (name, info) in zip(rows, catalog.ARGENTINA_PATTERNS.items()):
        assert info["example"] in [m for f in row["findings"] if f["type"] == name for m in f["matches"]]


def test_quirks(docs):
    rows = detect_regex(docs("", None, "call (206) 555-0006", "4111111111111111 AB123456", "a@b.c|", "x 123-45-6789 y 123-45-6789")).orderBy("doc_id").collect()
    found = [{f["type"]: f["matches"] for f in r["findings"]} for r in rows]
    assert found[0] == {} and found[1] == {} and "phone" not in found[2]
    assert list(found[3]) == ["passport", "driver_license", "credit_card", "bank_account", "employee_id", "medical_record"]
    assert found[4] == {"email": ["a@b.c|"]} or found[4] == {}
    assert found[5]["social_security"] == ["123-45-6789", "123-45-6789"]


def test_match_and_validate(docs):
    df = docs("123-45-6789", "123-45-6789 ", "u@example.com")
    rows = df.select(
        fp.match_pii(F.col("text"), "social_security").alias("m"), fp.match_pii(F.col("text"), "nothing").alias("n"),
        fp.validate_pii(F.col("text"), "social_security").alias("v"), fp.validate_pii(F.col("text"), "nothing").alias("w"),
    ).collect()
    assert [r["v"] for r in rows] == [True, False, False]
    assert [len(r["m"]) for r in rows] == [1, 1, 0]
    assert not any(r["n"] or r["w"] for r in rows)


@pytest.mark.parametrize("countries, hit", [(["US"], False), (["AR"], True), (["US", "ARGENTINA"], True), (["ar"], False), ([], False)])
def test_countries(docs, countries, hit):
    df = docs("DNI 34960099", countries=[countries])
    by_list = detect_international(df, countries).first()["findings"]
    by_column = detect_international(df, F.col("countries")).first()["findings"]
    assert by_list == by_column and bool(by_list) == hit
    both = detect_regex(df, F.col("countries")).first()["findings"]
    assert any(f["type"] == "argentina_dni" for f in both) == hit


def test_scored_has_ungated_country_patterns(docs):
    found = detect_regex_scored(docs("number 34960099 only")).first()["findings"]
    assert [(f["type"], f["confidence"], f["detection_method"]) for f in found if "dni" in f["type"]] == [("argentina_dni", 0.8, "regex")]
    assert detect_regex_scored(docs("number 34960099 only"), international=False).first()["findings"] == []


def test_custom_patterns(docs, spark):
    merged = catalog.merge_specs(catalog.general_specs(), {"email": r"never", "tag": r"#\w*"})
    assert [s.name for s in merged][-1] == "tag" and len(merged) == 13
    found = detect_regex(docs("u@example.com #one #"), None, merged).first()["findings"]
    assert [(f["type"], f["matches"]) for f in found] == [("tag", ["#one", "#"])]
    table = spark.createDataFrame([(f"p{i:03d}", f"w{i}x*") for i in range(450)], "name string, pattern string")
    found = docs_x_patterns(docs("w7 w449xx"), table).first()["findings"]
    assert [(f["type"], f["matches"]) for f in found] == [("p004", ["w4"]), ("p007", ["w7"]), ("p044", ["w44"]), ("p449", ["w449xx"])]
    with pytest.raises(ValueError):
        docs_x_patterns(docs("x"), table, max_patterns=10)
    empty = docs_x_patterns(docs("aab"), spark.createDataFrame([("e", "b*")], "name string, pattern string")).first()["findings"]
    assert empty[0]["matches"] == ["b"]
