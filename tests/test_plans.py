"""What the plans must look like to hold at scale."""

import re

from pyspark.sql import functions as F

from veilframe.operators.detection import detect_regex, finding_rows
from veilframe.operators.spans import detect_presidio
from veilframe.plans.detect import detect_documents, detect_long_documents
from veilframe.plans.transform import transform_documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_texts_are_searched_once_and_not_shuffled(spark):
    docs = documents(spark)
    for df in (detect_documents(docs), transform_documents(docs, "s"), finding_rows(detect_regex(docs)).select("doc_id", "type")):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
        assert text.count("SSN") + text.count(r"\b\d{3}-\d{2}-\d{4}\b") == 1
    found = detect_regex(docs).filter(F.size("findings") > 0).filter("lang = 'en'")
    text = plan(found)
    assert text.count(r"\b\d{3}-\d{2}-\d{4}\b") == 1
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,en\)", text)


def test_only_needed_columns_are_read(spark):
    text = plan(detect_documents(documents(spark).select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_long_documents_shuffle_no_text_with_the_findings(spark):
    docs = documents(spark)
    short, long = detect_documents(docs.select("doc_id", "text"), 500, 50), detect_long_documents(docs, 500, 50)
    a = {r["doc_id"]: r["pii_matches"] for r in short.collect()}
    assert a == {r["doc_id"]: r["pii_matches"] for r in long.collect()}


def test_label_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "spans")
    spark.createDataFrame([(0, 0, 0, "PERSON", 0, 1, 0.5)], "doc_id long, chunk_idx int, ord int, label string, span_start int, span_end int, score double").write.parquet(path)
    df = detect_presidio(documents(spark).select("doc_id", "text", F.lit(0).alias("chunk_idx")), spark.read.parquet(path))
    text = plan(df)
    assert re.search(r"PushedFilters: \[In\(label", text)
    assert "Cartesian" not in text and "NestedLoop" not in text
