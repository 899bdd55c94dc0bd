import random

from pyspark.sql import functions as F

from veilframe.operators import combine, routing
from veilframe.operators.in_row import dedup_array
from veilframe.functions.findings import score_map
from veilframe.operators.skew import join_many_to_one
from veilframe.operators.transform import transform_report
from veilframe.schemas import FINDING_ROW

SCHEMA = (
    "doc_id long, chunk_idx int, method_rank int, ord int, type string, matches array<string>, detection_method string, "
    "confidence double, location struct<start:int,end:int>, country string, description string"
)


def sample(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rank = rng.randrange(3)
        rows.append((
            0 if i % 3 == 0 else rng.randrange(40), rng.randrange(3), rank, i, rng.choice(["email", "Email", "phone"]),
            [rng.choice("aAb") for _ in range(rng.randint(1, 3))], ["regex", "ner", None][rank], rng.choice([None, 0.25, 1.0]), None, None, None,
        ))
    return rows


def first_wins(rows, fold=lambda s: s):
    seen, kept = set(), []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3])):
        key = (r[0], fold(r[4]), tuple(sorted(fold(m) for m in r[5])))
        if key not in seen:
            seen.add(key)
            kept.append(r)
    return kept


def scores_of(rows, quantum=None):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r[0], {}).setdefault(r[6] or "unknown", []).append(0.5 if r[7] is None else r[7])
    out = {}
    for doc, methods in by_doc.items():
        total = sum(map(len, methods.values()))
        for m, c in methods.items():
            out[doc, m] = (len(c) / total + sum(c) / len(c)) / 2
    for doc, p in (quantum or {}).items():
        out[doc, "quantum"] = (p + 0.5) / 2
    return out


def test_dedup_scores_and_verdicts(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    want = first_wins(rows)
    unique = combine.dedup_findings(df)
    assert sorted(r["ord"] for r in unique.collect()) == sorted(r[3] for r in want)
    assert sorted(r["ord"] for r in combine.dedup_findings(unique).collect()) == sorted(r[3] for r in want)
    ci = combine.dedup_findings_ci(df).collect()
    assert sorted(r["ord"] for r in ci) == sorted(r[3] for r in first_wins(rows, str.lower))

    quantum = {0: 0.3, 77: 0.9}
    classified = spark.createDataFrame([(k, (p, 0)) for k, p in quantum.items()], "doc_id long, quantum_analysis struct<pii_probability:double,predicted_class:int>")
    got = {(r["doc_id"], r["method"]): r["score"] for r in combine.final_scores(unique, classified).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in scores_of(want, quantum).items()}
    shares = combine.method_share(unique).groupBy("doc_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares)

    docs = spark.range(0, 80).withColumnRenamed("id", "doc_id")
    verdicts = combine.combine_results(docs, df, classified=classified).collect()
    assert len(verdicts) == 80
    for v in verdicts:
        own = [r for r in want if r[0] == v["doc_id"]]
        assert [(f["type"], f["matches"]) for f in v["pii_matches"]] == [(r[4], r[5]) for r in own]
        assert v["pii_detected"] == bool(own)
        mine = {m: s for (d, m), s in scores_of(want, quantum).items() if d == v["doc_id"]}
        assert {m: round(s, 9) for m, s in v["confidence_scores"].items()} == {m: round(s, 9) for m, s in mine.items()}


def test_in_row_merge_equals_the_table_merge(spark):
    rows = sample(500, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    per_doc = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("method_rank", "chunk_idx", "ord", F.struct(*FINDING_ROW[4:]).alias("f")))).alias("l"))
    listed = per_doc.select("doc_id", F.transform("l", lambda x: x["f"]).alias("pii_matches"))
    for ignore, fold in ((False, lambda s: s), (True, str.lower)):
        want = first_wins(rows, fold)
        got = dedup_array(listed, "pii_matches", ignore).withColumn("scores", score_map(F.col("pii_matches")))
        for r in got.collect():
            own = [(x[4], x[5]) for x in want if x[0] == r["doc_id"]]
            assert [(f["type"], f["matches"]) for f in r["pii_matches"]] == own
            mine = {m: round(s, 9) for (d, m), s in scores_of(want).items() if d == r["doc_id"]}
            assert {m: round(s, 9) for m, s in r["scores"].items()} == mine


def test_hot_key_join_keeps_every_row(spark):
    """A third of all rows under one key, many of them equal copies."""
    many = spark.range(0, 3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("doc_id"),
        F.lit(0).alias("chunk_idx"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v"),
    )
    one = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.concat(F.lit("t"), "id").alias("text"))
    keys = ["doc_id", "chunk_idx"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_many_to_one(many, one, keys).groupBy(*keys, "v", "text").count()
        want = many.join(one, keys).groupBy(*keys, "v", "text").count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_routing(spark):
    tasks = spark.createDataFrame(
        [(i, m) for i, m in enumerate([["regex"], ["international"], ["ner"], ["quantum_classification", "regex"], [], None])],
        "job_id int, methods array<string>",
    )
    assert sorted(r["job_id"] for r in routing.route_regex(tasks).collect()) == [0, 1, 3]
    assert sorted(r["job_id"] for r in routing.route_ml(tasks).collect()) == [2, 3]
    assert [r["job_id"] for r in routing.only_method(tasks, "ner").collect()] == [2]
    run = {r["job_id"]: r["methods_run"] for r in routing.with_methods_run(tasks).collect()}
    assert run[3] == ["quantum_classification"] and run[0] == []
    merged = routing.merge_config(spark.createDataFrame([(0.9, None), (None, ["es"])], "confidence_threshold double, supported_languages array<string>"))
    assert sorted(r["confidence_threshold"] for r in merged.collect()) == [0.5, 0.9]
    assert all(len(r["detection_methods"]) == 6 for r in merged.collect())


def test_report_of_an_empty_text(spark):
    df = spark.createDataFrame([(0, "", "", [])], "doc_id long, text string, transformed_text string, pii_matches array<struct<type:string,matches:array<string>>>")
    report = transform_report(df).first()["transformation_report"]
    assert report["transformation_impact"] == 0 and report["total_pii_instances"] == 0 and report["pii_types_identified"] == {}
