"""Documents to rewritten documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from veilframe.catalog import CHUNK_SIZE, DEFAULT_TRANSFORM, OVERLAP
from veilframe.operators.transform import transform_data, transform_report
from veilframe.plans.detect import detect_documents, detect_long_documents


def transform_documents(
    docs: DataFrame,
    salt: str,
    method: str | Column = DEFAULT_TRANSFORM,
    nonce: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    countries: Sequence[str] | Column | None = ("US", "AR"),
) -> DataFrame:
    """Detect, rewrite and report within the row of each document.

    The text to rewrite is the document itself, which equals its chunks put
    together without the overlaps, so nothing is shuffled.  For documents with
    thousands of different matches see `transform_long_documents`.
    """
    verdicts = detect_documents(docs, chunk_size, overlap, countries)
    return transform_report(transform_data(verdicts, salt, method, nonce, many_values=False), method)


def transform_long_documents(
    docs: DataFrame,
    salt: str,
    method: str | Column = DEFAULT_TRANSFORM,
    nonce: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    countries: Sequence[str] | None = ("US", "AR"),
) -> DataFrame:
    """The same rows for tables with very long documents.

    Chunks are searched where they are dealt to, the findings meet their text again,
    and a text with many different matches is rewritten in one walk.
    """
    verdicts = docs.join(detect_long_documents(docs, chunk_size, overlap, countries), "doc_id")
    return transform_report(transform_data(verdicts, salt, method, nonce), method)
