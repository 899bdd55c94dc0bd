"""Stateless stages of the stream: chunk messages in, result messages out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import ML_METHODS, REGEX_METHODS
from veilframe.operators.classify import classify_documents
from veilframe.operators.detection import regex_findings
from veilframe.operators.routing import asks_for
from veilframe.operators.steps import compute_once
from veilframe.sources.weights import Weights


def _texts(messages: DataFrame, methods: list[str]) -> DataFrame:
    wanted = asks_for(F.split("methods", ","), methods)
    return messages.filter((F.col("action") == "store_text") & wanted)


def _reply(messages: DataFrame, service: str) -> DataFrame:
    """Result messages carry findings, not the text again."""
    return messages.withColumns({
        "service": F.lit(service),
        "action": F.lit("results"),
        "text": F.lit(None).cast("string"),
    })


def stream_detect_regex(messages: DataFrame) -> DataFrame:
    """Result messages of the pattern detectors; works on batches alike.

    Countries are those of the message, US where it names none.
    """
    countries = F.split(F.coalesce("countries", F.lit("US")), ",")
    found = compute_once(_texts(messages, REGEX_METHODS), "pii_matches", regex_findings(F.col("text"), countries))
    return _reply(found, "regex")


def stream_detect_ml(messages: DataFrame, weights: Weights) -> DataFrame:
    """Result messages of the classifier; the messages carry `embedding`."""
    texts = _texts(messages, ML_METHODS)
    asked = F.array_contains(F.split("methods", ","), "quantum_classification")
    scored = classify_documents(
        texts.drop("quantum").withColumn("embedding", F.when(asked, F.col("embedding"))), weights
    )
    result = F.when(asked, F.col("quantum_analysis")).alias("quantum")
    return _reply(scored.select(*[c for c in scored.columns if c not in ("quantum_analysis", "embedding")], result), "ml")
