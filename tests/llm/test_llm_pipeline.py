from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from test_llm_lines_mixing import brute_lines
from test_llm_simhash import brute_components
from veilframe.llm.common import saved

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage gets and, last, what the last one returns."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        found.append(docs)
        docs = saved(stage(spark, docs, SF), "stage")
    return [*found, docs]


def rows(df):
    return df.collect()


def test_columns(tables):
    for df in tables[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go_and_others_stay(spark, tables):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before, after = {r.doc_id for r in rows(tables[0])}, {r.doc_id for r in rows(tables[1])}
    assert after <= before and len((before - after) - toxic) < 0.1 * len(before)


def test_lines(tables):
    got = sorted((r.doc_id, r.text) for r in rows(tables[2]))
    assert got == [(i, t) for i, t, _ in brute_lines([(r.doc_id, r.text) for r in rows(tables[1])])]
    assert all(r.n_chars == len(r.text) for r in rows(tables[2]))


def test_one_of_each_group(tables):
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in rows(tables[2])])}
    assert sorted(r.doc_id for r in rows(tables[3])) == sorted(want)


def test_tokens_of_the_mixture(tables):
    library = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in rows(tables[3])}
    last = rows(tables[5])
    assert Counter(r.doc_id for r in rows(tables[4])) == Counter(r.doc_id for r in last)
    for r in last:
        assert r.token_ids == library.encode(texts[r.doc_id]).ids and r.n_tokens == len(r.token_ids)
        assert r.text == texts[r.doc_id]


def test_run(spark, tables):
    got = pipeline.run(spark, SF)
    assert got.columns == tables[5].columns and Counter(r.doc_id for r in rows(got)) == Counter(r.doc_id for r in rows(tables[5]))


def test_edges(spark, edge_rows, no_rows):
    counts = []
    for _, stage in pipeline.STAGES:
        counts.append(stage(spark, edge_rows, SF).count())
        assert stage(spark, no_rows, SF).count() == 0
    n = edge_rows.count()
    assert counts[0] == counts[1] == counts[4] == n and counts[2] < n
    kept = rows(pipeline.drop_near_duplicates(spark, edge_rows, SF))
    assert Counter(r.doc_id for r in kept)[1] == 1 and {3, 7} <= {r.doc_id for r in kept} and 4 not in {r.doc_id for r in kept}
