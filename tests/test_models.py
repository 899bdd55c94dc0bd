import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe import catalog
from veilframe.operators import classify, responses, spans
from veilframe.plans.detect import detect_jobs
from veilframe.sources.weights import Weights, load_weights, save_weights, weights_table
from veilframe.schemas import RESPONSES, SPANS
from veilframe.workspace import workspace

TEXT = "😀 Ann Lee of ACME, ann@example.com"


def chunks(docs, *texts):
    return docs(*texts).withColumn("chunk_idx", F.lit(0))


def test_span_detectors(docs, spark):
    def span(ord_, label, part, score=0.9):
        at = TEXT.index(part)
        return (0, 0, ord_, label, at, at + len(part), score)

    table = spark.createDataFrame([
        span(0, "PERSON", "Ann Lee"), span(1, "ORG", "ACME"), span(2, "EMAIL_ADDRESS", "ann@example.com"), span(3, "FAC", "ACME"),
    ], SPANS)
    df = chunks(docs, TEXT)
    presidio = spans.detect_presidio(df, table).orderBy("ord").collect()
    assert [(r["type"], r["matches"], r["confidence"]) for r in presidio] == [("person", ["Ann Lee"], 0.9), ("email_address", ["ann@example.com"], 0.9)]
    assert presidio[0]["location"]["start"] == 2
    ner = spans.detect_ner(df, table).orderBy("ord").collect()
    assert [r["type"] for r in ner] == ["person_name", "organization", "email_address", "fac"]
    gliner = spans.detect_gliner(df, table).orderBy("ord").collect()
    assert [(r["type"], r["confidence"]) for r in gliner] == [("person", 0.75), ("organization", 0.75)]
    every = spans.detect_gliner(df, table, ["ALL"], "ner", None).orderBy("ord").collect()
    assert [(r["type"], r["confidence"], r["detection_method"]) for r in every][3] == ("fac", None, "ner")
    assert spans.presidio_entities(["international"], ["AR"])[-3:] == ["ID_NUMBER", "DOMAIN_NAME", "LOCATION"]
    assert "LOCATION" not in spans.presidio_entities(["international"], ["US"])


def test_custom_recognizer(docs):
    def predict(text, entities):
        return [{"label": "LOUD", "start": 0, "end": 2, "score": 0.4}] if text.isupper() and "ALL" in entities else []

    rows = spans.custom_recognizer(docs("ABC", "abc", None), predict).collect()
    assert [(r["doc_id"], r["label"], r["span_end"], r["score"]) for r in rows] == [(0, "LOUD", 2, 0.4)]


def item(value="Ann Lee", start=2, drop=(), **more):
    made = {"type": "person_name", "value": value, "confidence": 0.9, "start_index": start, "end_index": start + len(value), **more}
    return {k: v for k, v in made.items() if k not in drop}


ANSWERS = {
    json.dumps([item(), item("ACME", 13)]): 2,
    "Sure:\n```json\n" + json.dumps([item()], indent=1).replace("[\n {", "[{").replace("}\n]", "}]") + "\n```": 1,
    "[note] the list is " + json.dumps([item()]): 1,
    json.dumps([item(start=3)]): 0,
    json.dumps([item(drop=("confidence",)), item()]): 1,
    json.dumps([item(confidence=None)]): 1,
    json.dumps([item(start_index="2", end_index="9")]): 1,
    json.dumps([item(start_index="two")]): 0,
    json.dumps(item()): 0,
    json.dumps({"items": [item()]}): 0,
    "[{'type': 'x'}]": 0, "no list": 0, "[]": 0, "": 0, '[{"type": "a"}, {bad': 0,
}


def test_answers(docs, spark):
    df = chunks(docs, *[TEXT] * (len(ANSWERS) + 1))
    rows = [(i, 0, a) for i, a in enumerate(ANSWERS)] + [(len(ANSWERS), 0, None)]
    found = responses.parse_responses(df, spark.createDataFrame(rows, RESPONSES)).collect()
    counts = [sum(r["doc_id"] == i for r in found) for i in range(len(rows))]
    assert counts == [*ANSWERS.values(), 0]
    assert {tuple(r["matches"]) for r in found} == {("Ann Lee",), ("ACME",)}
    assert {r["detection_method"] for r in found} == {"llm_semantic"}


def test_prompts(docs):
    types = responses.add_type(responses.add_type(catalog.PROMPT_TYPES, "email"), "badge")
    assert types == [*catalog.PROMPT_TYPES, "badge"]
    prompt = responses.build_prompts(docs("the text"), types).first()["prompt"]
    assert "ip_address, badge\n" in prompt and "```\nthe text\n```" in prompt
    listed = docs("x").withColumn("types", F.array(F.lit("email")))
    assert responses.with_custom_type(listed, "types", "email").first()["types"] == ["email"]


def forward(weights, x):
    for b in weights.blocks:
        x = x @ b["weight"].T + b["bias"]
        if "gain" in b:
            x = (x - x.mean()) / np.sqrt(x.var() + 1e-5) * b["gain"] + b["shift"]
            x = 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * (np.exp(x) - 1))
    return x


def test_classifier(docs, spark):
    weights = Weights.initial(seed=4)
    assert [b["weight"].shape for b in weights.blocks] == [(64, 100), (32, 64), (10, 32)]
    rng = np.random.default_rng(1)
    vectors = [list(map(float, rng.normal(size=n))) for n in (64, 100, 384)] + [None]
    rows = classify.classify_documents(docs(*"abcd", embedding=vectors), weights).orderBy("doc_id").collect()
    for row, vector in zip(rows[:3], vectors):
        z = forward(weights, np.array((vector + [0.0] * 100)[:100]))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        q = row["quantum_analysis"]
        assert q["pii_probability"] == pytest.approx(p[0]) and q["predicted_class"] == p.argmax()
        u = q["uncertainty"]
        assert u["shannon_entropy"] == pytest.approx(-(p * np.log(p + 1e-10)).sum())
        assert u["uncertainty_principle"] == pytest.approx(1 - p.max()) and u["probabilistic_variance"] == pytest.approx(p.var(ddof=1))
    assert rows[3]["quantum_analysis"]["pii_probability"] == 0 and rows[3]["quantum_analysis"]["uncertainty"]["shannon_entropy"] == 0


def test_weights_table(spark):
    path, weights = workspace(spark, "w"), Weights.initial(seed=2, complexity_level=0.25)
    save_weights(spark, weights, path)
    loaded = load_weights(spark, path)
    assert loaded.complexity_level == 0.25 and loaded.input_dim == 100 and loaded.num_classes == 10
    assert all((a[k] == b[k]).all() for a, b in zip(weights.blocks, loaded.blocks) for k in a)
    broken = workspace(spark, "w")
    weights_table(spark, weights).filter("NOT (layer = 1 AND name = 'bias')").write.parquet(broken)
    for bad in (broken, workspace(spark, "none")):
        with pytest.raises(ValueError):
            load_weights(spark, bad)


def test_mean_pool(spark):
    rows = [(i % 3, int(i % 4 != 0), [float(i), 1.0]) for i in range(30)] + [(9, 0, [5.0, 5.0])]
    got = classify.mean_pool(spark.createDataFrame(rows, "doc_id long, mask int, vec array<double>"), 2).collect()
    for r in got:
        own = [v for d, m, v in rows if d == r["doc_id"] and m]
        want = np.mean(own, axis=0) if own else [0, 0]
        assert r["embedding"] == pytest.approx(list(want))


def test_jobs_choose_their_detectors(docs, spark):
    text = "DNI 34960099 u@example.com"
    methods = [["regex"], ["ner"], ["quantum_classification"], []]
    df = docs(*[text] * 4, methods=methods, countries=[["AR"], ["AR"], ["US"], ["US"]], embedding=[[0.1] * 100] * 4)
    table = spark.createDataFrame([(i, 0, 0, "PERSON", 0, 3, 0.5) for i in range(4)], SPANS)
    out = detect_jobs(df, table, table, None, Weights.initial()).orderBy("doc_id").collect()
    assert [sorted(r["confidence_scores"]) for r in out] == [["international_regex", "regex"], ["ner"], ["quantum"], []]
    assert [r["pii_detected"] for r in out] == [True, True, False, False]
