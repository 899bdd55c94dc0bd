"""The library service: whole texts, chosen methods, its own merge rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import (
    ARGENTINA_NAMES,
    DEFAULT_TRANSFORM,
    SERVICE_DEFAULTS,
    SERVICE_RANK,
    TRANSFORM_NAMES,
    PatternSpec,
    argentina_specs,
    merge_specs,
)
from veilframe.functions.findings import score_map
from veilframe.functions.patterns import NO_FINDINGS, pattern_findings
from veilframe.functions.tokens import check_method
from veilframe.operators import spans
from veilframe.operators.classify import classify_documents
from veilframe.operators.combine import dedup_findings_ci, union_methods, verdicts
from veilframe.operators.detection import finding_rows, scored_specs
from veilframe.operators.in_row import dedup_array
from veilframe.operators.responses import parse_responses
from veilframe.operators.steps import compute_once
from veilframe.operators.transform import transform_data, transform_report
from veilframe.schemas import CLASSIFIER_RESULT
from veilframe.sources.weights import Weights


class DetectionService:
    """Detection without chunks: findings compared ignoring case, scored by share.

    Tables of spans and model answers, and classifier weights, stand for the
    models; a method whose input is missing is left out.
    """

    def __init__(
        self,
        config: Mapping[str, Any] | None = None,
        presidio_spans: DataFrame | None = None,
        ner_spans: DataFrame | None = None,
        responses: DataFrame | None = None,
        weights: Weights | None = None,
        extra_patterns: Mapping[str, str] | Sequence[PatternSpec] = (),
    ):
        self.config = {**SERVICE_DEFAULTS, **(config or {})}
        self.presidio_spans = presidio_spans
        self.ner_spans = ner_spans
        self.responses = responses
        self.weights = weights
        international = "international" in self.config["detection_methods"]
        extra = extra_patterns if isinstance(extra_patterns, Mapping) else list(extra_patterns)
        self.specs = merge_specs(scored_specs(international), extra)

    def _pattern_findings(self, methods: Sequence[str]):
        found = [F.array().cast(NO_FINDINGS)]
        if "regex" in methods:
            found.append(pattern_findings(F.col("text"), self.specs))
        if "international" in methods and set(ARGENTINA_NAMES) & set(self.config["supported_countries"]):
            found.append(pattern_findings(F.col("text"), argentina_specs()))
        return F.coalesce(F.concat(*found), F.array().cast(NO_FINDINGS))

    def detect_pii(self, docs: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
        """Verdict per document.

        Patterns alone are settled within each row.  Spans and answers are
        tables of their own and are merged by document.
        """
        methods = list(methods or self.config["detection_methods"])
        searched = compute_once(docs, "pii_matches", self._pattern_findings(methods))
        classified = None
        if "quantum_classification" in methods and self.weights is not None and "embedding" in docs.columns:
            searched = classify_documents(searched, self.weights)
            classified = "quantum_analysis"
        outside = self._model_findings(docs.withColumn("chunk_idx", F.lit(0)), methods)
        if not outside:
            unique = dedup_array(searched, "pii_matches", ignore_case=True)
            out = unique.withColumns({
                "pii_detected": F.size("pii_matches") > 0,
                "confidence_scores": score_map(F.col("pii_matches"), with_confidence=False),
            })
            return out if classified else out.withColumn("quantum_analysis", F.lit(None).cast(CLASSIFIER_RESULT))
        rows = finding_rows(searched.withColumnRenamed("pii_matches", "findings"))
        unique = dedup_findings_ci(union_methods(rows, *outside))
        analysed = searched.select("doc_id", classified) if classified else None
        return verdicts(docs, unique, analysed, with_confidence=False)

    def _model_findings(self, chunks: DataFrame, methods: Sequence[str]) -> list[DataFrame]:
        tagged = []
        if "presidio" in methods and self.presidio_spans is not None:
            allowed = spans.presidio_entities(self.config["detection_methods"], self.config["supported_countries"])
            tagged.append(spans.presidio_spans(self.presidio_spans, allowed, SERVICE_RANK["presidio"]))
        if "ner" in methods and self.ner_spans is not None:
            tagged.append(spans.ner_spans(self.ner_spans, rank=SERVICE_RANK["ner"]))
        found = [spans.span_findings(chunks.select("doc_id", "chunk_idx", "text"), *tagged)] if tagged else []
        if "llm_semantic" in methods and self.responses is not None:
            found.append(parse_responses(chunks, self.responses, SERVICE_RANK["llm_semantic"]))
        return found


class TransformationService:
    """Rewriting with a stored choice of method."""

    def __init__(
        self, salt: str, method: str = DEFAULT_TRANSFORM, preserve_context: bool = True, nonce: str | None = None
    ):
        self.salt = salt
        self.method = method
        self.preserve_context = preserve_context
        self.nonce = nonce

    def set_method(self, method: str) -> None:
        """ValueError if the name is unknown."""
        self.method = check_method(method)

    def transform_data(self, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Add `transformed_text`; a configured name that is unknown pseudonymizes."""
        method = self.method if self.method in TRANSFORM_NAMES else DEFAULT_TRANSFORM
        return transform_data(verdicts, self.salt, method, self.nonce, key)

    def report(self, transformed: DataFrame) -> DataFrame:
        """Add `transformation_report`."""
        return transform_report(transformed, self.method, self.preserve_context)
