"""Documents to verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import CHUNK_SIZE, METHOD_RANK, OVERLAP, PatternSpec
from veilframe.functions.findings import score_map
from veilframe.functions.patterns import NO_FINDINGS
from veilframe.operators import spans
from veilframe.operators.chunking import chunk_documents, with_chunks
from veilframe.operators.classify import classify_documents
from veilframe.operators.combine import combine_results
from veilframe.operators.detection import detect_regex, finding_rows, regex_findings
from veilframe.operators.in_row import dedup_array
from veilframe.operators.responses import parse_responses
from veilframe.operators.routing import asks_for, only_method, route_regex
from veilframe.operators.steps import compute_once
from veilframe.sources.weights import Weights


def detect_documents(
    docs: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    countries: Sequence[str] | Column | None = ("US", "AR"),
    specs: Sequence[PatternSpec] | None = None,
) -> DataFrame:
    """Chunk, search, deduplicate and score each document within its row.

    Keeps all columns of `docs` (doc_id, text, and `quantum_analysis` if the
    classifier has run) and adds pii_matches, pii_detected, confidence_scores.
    A narrow plan: text is read once and never shuffled.
    """
    chunked = with_chunks(docs, chunk_size, overlap)
    per_chunk = F.transform("chunks", lambda chunk: regex_findings(chunk, countries, specs))
    found = F.coalesce(F.flatten(per_chunk), F.array().cast(NO_FINDINGS))
    unique = dedup_array(compute_once(chunked, "pii_matches", found).drop("chunks"), "pii_matches")
    if "quantum_analysis" in docs.columns:
        probability = F.col("quantum_analysis.pii_probability")
    else:
        probability = None
    return unique.withColumns({
        "pii_detected": F.size("pii_matches") > 0,
        "confidence_scores": score_map(F.col("pii_matches"), quantum=probability),
    })


def detect_long_documents(
    docs: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    countries: Sequence[str] | None = ("US", "AR"),
    partitions: int | None = None,
) -> DataFrame:
    """The same verdicts with chunks spread over tasks.

    For tables in which a few documents hold much of the text: chunks are dealt
    out evenly, searched, and the findings alone come back together.
    """
    chunks = chunk_documents(docs.select("doc_id", "text"), chunk_size, overlap)
    keys = ("doc_id", "chunk_idx")
    spread = chunks.repartition(partitions, *keys) if partitions else chunks.repartition(*keys)
    return combine_results(docs.select("doc_id"), finding_rows(detect_regex(spread, countries)))


def detect_jobs(
    jobs: DataFrame,
    presidio_spans: DataFrame | None = None,
    ner_spans: DataFrame | None = None,
    responses: DataFrame | None = None,
    weights: Weights | None = None,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Verdicts of requests that each choose their methods and countries.

    `jobs` has doc_id, text, the arrays methods and countries, and `embedding`
    for the classifier.  Spans and answers are keyed by document and chunk.  A
    detector sees only the rows that ask for it.  Texts are joined once with the
    spans of all taggers and once with the answers, and stay behind when the
    findings are merged.
    """
    chunks = chunk_documents(jobs.select("doc_id", "text", "methods", "countries"), chunk_size, overlap)
    found = [finding_rows(detect_regex(route_regex(chunks), F.col("countries")), METHOD_RANK["regex"])]
    if responses is not None:
        found.append(parse_responses(only_method(chunks, "llm_semantic"), responses))
    tagged = [] if presidio_spans is None else [spans.presidio_spans(presidio_spans)]
    if ner_spans is not None:
        tagged += [spans.ner_spans(ner_spans), spans.gliner_spans(ner_spans)]
    if tagged:
        asking = chunks.filter(asks_for(F.col("methods"), ["presidio", "ner", "gliner"]))
        found.append(spans.span_findings(asking, *tagged))
    classified = None
    if weights is not None:
        asked = only_method(jobs, "quantum_classification").select("doc_id", "embedding")
        classified = classify_documents(asked, weights).drop("embedding")
    return combine_results(jobs.drop("text", "embedding"), *found, classified=classified)
