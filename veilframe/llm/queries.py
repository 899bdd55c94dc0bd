"""The registered query of each operator, on the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, dialogue, fingerprint, lines, merge_tree, mixing, phrases, pii, quality, simhash, toxicity, urls, warc
from veilframe.operators.steps import compute_once
from veilframe.workspace import workspace

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip_documents(read(spark, sf_dir, "documents", "doc_id", "text"), path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op4_mixing"] = mixing.ORACLE
ORACLES["op5_lines"] = lines.ORACLE


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    path = workspace(spark, "warc")
    warc.write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return warc.read_warc(spark, path, payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLES["op9_warc"] = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select *, min(page_id) over (partition by payload_digest) as first from hashed)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from firsts
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["number"] < 4)

    def n(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(n, ("email", "ip", "card", "phone")), F.sha2(pii.report(base), 256).alias("base_sha256"), pii.report(F.col("pii")).alias("spans"),
        *map(n, ("iban", "secret")), F.size("pii").cast("long").alias("n_spans"),
    )


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    printed = fingerprint.fingerprint_documents(docs).drop("fingerprint")
    pairs = fingerprint.with_next(printed, "doc_id", "text", "vector", ids=docs)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    filled = pairs.withColumns({"text": F.coalesce("text", F.lit("")), "after": F.coalesce("next.text", F.lit(""))})
    edited = compute_once(filled, "edited", F.concat(F.left("text", n - half), F.left("after", half)))
    hashed = compute_once(edited.drop("after"), "hashed", fingerprint.hashes(F.col("edited")))
    small = hashed.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "vector", F.col("next.vector").alias("next_vector"), "hashed"
    )
    vectors = compute_once(small, "edited_vector", fingerprint.vector(F.col("hashed"))).drop("hashed")
    lanes = compute_once(vectors, "s", F.struct(*[fingerprint.signed(F.col(c)).alias(c) for c in ("vector", "edited_vector", "next_vector")]))
    return lanes.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.digits(F.col("vector")).alias("fingerprint"), fingerprint.digits(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("s.vector"), F.col("s.edited_vector")).alias("near_edited"),
        fingerprint.likeness(F.col("s.vector"), F.col("s.next_vector")).alias("near_next"),
    )


def held_out():
    """Is a document kept from training?"""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic").filter(~held_out()))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "sentences")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query
def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page is as good as the document whose text it shows
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    pages = urls.with_labels(read(spark, sf_dir, "pages", "page_id", "url", "html"), docs, keep=["page_id", "url"], labels=labels)
    judged = urls.judge_urls(pages, RULES, labels="bad")
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = merge_tree.round_trip_documents(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return done.select(
        "doc_id", F.expr("cast(octet_length(token_bytes) div 4 as long)").alias("n_tokens"),
        F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(dialogue.damage_conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents", "lang", "text"))


ORACLES["op13_phrases"] = phrases.ORACLE
