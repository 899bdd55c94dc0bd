"""From raw documents to token ids: five stages, each one an operator on the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, lines, mixing, simhash
from veilframe.llm.common import row_key, saved
from veilframe.llm.queries import toxicity_model
from veilframe.llm.toxicity import score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their order."""
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones that aren't held out, doesn't call toxic.

    Null and empty texts are not toxic and stay; rows and repeats stay or go alike.
    """
    return _documents(score_documents(docs, toxicity_model(docs, spark, sf_dir)).filter("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier passage of three lines.

    Every row stays, with an empty text if all of it was copied; n_chars follows the text.
    """
    cut = lines.dedup_lines(docs)
    return _documents(cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null ids come last, equal ids in the order of a hash of id and text.  Of rows
    with equal id and text one stays, the smallest by the other columns.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key"))
    groups = simhash.near_duplicates(docs.select(place.alias("place"), "text"), doc_id="place")
    kept = saved(groups.select("component_id.key").distinct(), "kept")
    # equal rows are folded before the exchange, however many there are
    single = docs.select(key.alias("key"), F.struct(*COLUMNS).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    return _documents(single.join(kept, "key", "left_semi").select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in random order."""
    return _documents(mixing.mix_sources(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, in `token_ids`, their number in `n_tokens`, and in `text` what they
    decode to, beside id, language and source.

    Null and empty texts have no ids and decode to an empty text; an empty table stays empty.
    """
    done = bpe.round_trip_documents(docs, public_tokenizers.path(TOKENIZER), decoded="text")
    return done.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "text")


#: Name and function of each stage; each gets what the one before returned, written and read again.
STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("BPE encoding and decoding", tokenize),
]
#: Sentence scores, components and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{i + 1}")
    return docs
