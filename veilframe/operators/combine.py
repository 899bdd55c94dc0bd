"""Merging the findings of all detectors into one verdict per document.

Findings stay one per row here.  Every step aggregates before it shuffles, on
keys finer than the document where that is possible, so a document with very
many findings is spread over tasks.  For findings that sit in the row of their
document see `veilframe.functions.findings`, which needs no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.catalog import DEFAULT_CONFIDENCE
from veilframe.functions.findings import match_key, score_map
from veilframe.functions.patterns import NO_FINDINGS
from veilframe.schemas import CLASSIFIER_RESULT, FINDING_FIELDS, FINDING_ROW

ORDER = ["method_rank", "chunk_idx", "ord"]


def union_methods(*findings: DataFrame) -> DataFrame:
    """All findings in one table; `method_rank` holds the order of the detectors."""
    return reduce(DataFrame.unionByName, [f.select(*FINDING_ROW) for f in findings])


def _dedup(findings: DataFrame, key: str, ignore_case: bool) -> DataFrame:
    rest = [c for c in findings.columns if c not in (key, *ORDER)]
    type_, matches = match_key(F.col("type"), F.col("matches"), ignore_case)
    first = F.min(F.struct(*ORDER, *rest)).alias("_first")
    kept = findings.groupBy(key, type_.alias("_type"), matches.alias("_matches")).agg(first)
    return kept.select(key, "_first.*").select(*findings.columns)


def dedup_findings(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first finding of each (document, type, sorted matches).

    A minimum, not a ranking window: copies are folded before the shuffle and
    nothing is sorted per document.
    """
    return _dedup(findings, key, ignore_case=False)


def dedup_findings_ci(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """As `dedup_findings`, with type and matches compared in lower case."""
    return _dedup(findings, key, ignore_case=True)


def _method() -> Column:
    return F.coalesce("detection_method", F.lit("unknown"))


def method_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of findings per document and method."""
    return findings.groupBy(key, _method().alias("method")).agg(F.count("*").alias("n"))


def method_avg_confidence(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean confidence per document and method; a missing one counts as 0.5."""
    return findings.groupBy(key, _method().alias("method")).agg(
        F.avg(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("avg_confidence")
    )


def _stats(findings: DataFrame, key: str) -> DataFrame:
    """Count, mean confidence and share; the window sees a few rows per document."""
    stats = findings.groupBy(key, _method().alias("method")).agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("avg_confidence"),
    )
    return stats.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(key)))


def method_share(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of a document's findings made by each method."""
    return _stats(findings, key).select(key, "method", "share")


def quantum_share(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """The classifier's probability as the share of one more method."""
    return classified.filter(F.col("quantum_analysis").isNotNull()).select(
        key, F.lit("quantum").alias("method"), F.col("quantum_analysis.pii_probability").alias("share")
    )


def with_quantum(shares: DataFrame, classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shares with the classifier's row added for documents it has seen."""
    return shares.unionByName(quantum_share(classified, key))


def final_scores(findings: DataFrame, classified: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(share + mean confidence) / 2 per document and method.

    The classifier has no mean confidence; 0.5 stands for it.
    """
    scored = _stats(findings, key).select(key, "method", "share", "avg_confidence")
    if classified is not None:
        extra = quantum_share(classified, key).withColumn("avg_confidence", F.lit(DEFAULT_CONFIDENCE))
        scored = scored.unionByName(extra)
    return scored.select(key, "method", ((F.col("share") + F.col("avg_confidence")) / 2).alias("score"))


def share_scores(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The library service's scores: the share alone."""
    return method_share(findings, key).withColumnRenamed("share", "score")


def first_chunk_quantum(classified: DataFrame) -> DataFrame:
    """The classifier's result for the first chunk only."""
    return classified.filter(F.col("chunk_idx") == 0)


def type_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches per document and type."""
    return findings.groupBy(key, F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.sum(F.size("matches")).alias("instances")
    )


def verdicts(
    docs: DataFrame,
    unique: DataFrame,
    classified: DataFrame | None = None,
    key: str = "doc_id",
    with_confidence: bool = True,
) -> DataFrame:
    """One row per document from deduplicated findings.

    Documents without findings have a row too.  The distinct findings of one
    document become one array, as the document itself is one row, and are
    scored in it; `final_scores` gives the scores as a table instead, without
    arrays.  `docs` is shuffled once, whatever is joined to it.
    """
    listed = F.array_sort(F.collect_list(F.struct(*ORDER, F.struct(*FINDING_FIELDS).alias("f"))))
    per_doc = unique.groupBy(key).agg(F.transform(listed, lambda x: x["f"]).alias("pii_matches"))
    out = docs.join(per_doc, key, "left")
    probability = None
    if classified is None:
        out = out.withColumn("quantum_analysis", F.lit(None).cast(CLASSIFIER_RESULT))
    else:
        out = out.join(classified.select(key, "quantum_analysis"), key, "left")
        probability = F.col("quantum_analysis.pii_probability")
    filled = out.withColumn("pii_matches", F.coalesce("pii_matches", F.array().cast(NO_FINDINGS)))
    return filled.withColumns({
        "pii_detected": F.size("pii_matches") > 0,
        "confidence_scores": score_map(F.col("pii_matches"), with_confidence, probability),
    })


def combine_results(
    docs: DataFrame, *findings: DataFrame, classified: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """Verdict per document from the findings of any number of detectors.

    `classified` has `quantum_analysis` per document or chunk; the first chunk
    counts.
    """
    unique = dedup_findings(union_methods(*findings), key)
    if classified is not None and "chunk_idx" in classified.columns:
        classified = first_chunk_quantum(classified)
    return verdicts(docs, unique, classified, key)
