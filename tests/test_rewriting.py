import hashlib

import pytest

from veilframe.plans.detect import detect_documents
from veilframe.plans.service import DetectionService, TransformationService
from veilframe.plans.transform import transform_documents
from veilframe.functions.tokens import check_method
from veilframe.operators.transform import transform_data
from pyspark.sql import functions as F

TEXTS = [
    "card 4111 1111 1111 1111, again 4111 1111 1111 1111, acct 000123456789",
    "id AB123456 mail u1@example.com mail U1@EXAMPLE.com",
    "nothing here", "", "DNI 34.960.099 y 20-22375732-5",
    "9 Elm Street 123-45-6789 " * 3,
]


def token(method, type_, value, doc, pos):
    if method == "anonymize":
        return f"[{type_}_ANONYMIZED]"
    if method == "mask":
        return "*" * len(value)
    if method == "tokenize":
        return f"[{type_}_{hashlib.sha256(f'run_{doc}_{pos}'.encode()).hexdigest()[:8]}]"
    return f"[{type_}_{hashlib.sha256(f'salt_{type_}_{value}'.encode()).hexdigest()[:16]}]"


def rewritten(row, method):
    text, pos = row["text"], 0
    for finding in row["pii_matches"]:
        for value in finding["matches"]:
            text = text.replace(value, token(method, finding["type"], value, row["doc_id"], pos))
            pos += 1
    return text, pos


@pytest.mark.parametrize("method", ["pseudonymize", "anonymize", "tokenize", "mask"])
def test_rewriting_is_sequential(docs, method):
    rows = transform_documents(docs(*TEXTS), "salt", method, "run", chunk_size=60, overlap=10).collect()
    for r in rows:
        want, n = rewritten(r, method)
        assert r["transformed_text"] == want
        report = r["transformation_report"]
        assert report["total_pii_instances"] == n == sum(report["pii_types_identified"].values())
        assert report["transformation_method"] == method
        assert report["transformation_impact"] == (1 - len(want) / len(r["text"]) if r["text"] else 0)
        if method == "mask":
            assert len(want) == len(r["text"])


NASTY = [
    (["a", "b", "a"], "xx", "ab a"), (["1", "2", "1", "2"], "n1", "1212 21"), (["*", "q", "*"], "s", "q*q*"),
    (["[x", "x", "[x", "x"], "x", "[xx [x"), (["z", "z", "z"], "zz", "zzzz"), (["u@e.f", "u@e.f", "e.f", "e.f"], "mail", "u@e.f e.f u@e.f"),
    (["e", "f", "e"], "t", "efef"), (["", "a", ""], "t", "a"),
]


@pytest.mark.parametrize("method", ["pseudonymize", "anonymize", "tokenize", "mask"])
def test_repeats_of_a_value(spark, method):
    """Values that stand in tokens or at their edges are replaced again."""
    rows = [(i, text, [(type_, values), (type_ + "2", values)]) for i, (values, type_, text) in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_matches array<struct<type:string,matches:array<string>>>")
    for r in transform_data(df, "salt", method, "run").collect():
        found = [{"type": t, "matches": [m for m in ms if m]} for t, ms in rows[r["doc_id"]][2]]
        if any("" in ms for _, ms in rows[r["doc_id"]][2]) and method == "tokenize":
            continue  # skipped empty matches have a position of their own
        assert r["transformed_text"] == rewritten({"doc_id": r["doc_id"], "text": r["text"], "pii_matches": found}, method)[0]


def test_method_per_row_and_unknown_names(docs):
    methods = ["mask", "anonymize", "tokenize", "pseudonymize", "shred", None]
    rows = transform_documents(docs(*TEXTS, transform_method=methods), "salt", F.col("transform_method"), "run").collect()
    for r in rows:
        assert r["transformed_text"] == rewritten(r, r["transform_method"])[0]
    with pytest.raises(ValueError, match="Unknown transformation method"):
        check_method("shred")
    with pytest.raises(ValueError):
        transform_documents(docs("x"), "salt", "tokenize")
    service = TransformationService("salt", "shred")
    found = detect_documents(docs(*TEXTS))
    out = service.report(service.transform_data(found)).collect()
    assert all(r["transformed_text"] == rewritten(r, "pseudonymize")[0] for r in out)
    with pytest.raises(ValueError):
        service.set_method("shred")
    service.set_method("mask")
    assert service.method == "mask"


def test_chunked_search_finds_what_the_whole_text_has(docs):
    text = ("word " * 7 + "123-45-6789 and u7@example.com ") * 6
    whole = {(f["type"], m) for f in detect_documents(docs(text)).first()["pii_matches"] for m in f["matches"]}
    chunked = {(f["type"], m) for f in detect_documents(docs(text), 80, 30).first()["pii_matches"] for m in f["matches"]}
    assert {m for m in whole if m[0] in ("social_security", "email")} <= chunked


def test_service_merges_ignoring_case(docs):
    out = DetectionService().detect_pii(docs("x 34960099", "u@example.com DNI 22.105.779"), ["regex", "international"]).orderBy("doc_id").collect()
    # without its context words a number is reported by every plain pattern
    assert [(f["type"], f["detection_method"]) for f in out[0]["pii_matches"]] == [
        ("argentina_dni", "regex"), ("argentina_drivers_license", "regex")
    ]
    kinds = [(f["type"], f["detection_method"]) for f in out[1]["pii_matches"]]
    assert kinds == [("email", "regex")] + [(f"argentina_{n}", "regex") for n in ("dni", "dni_dot", "drivers_license")]
    assert out[1]["confidence_scores"] == {"regex": 1.0}
    only = DetectionService({"supported_countries": ["US"]}).detect_pii(docs("DNI 34960099"), ["international"]).first()
    assert only["pii_detected"] is False and only["confidence_scores"] == {}
