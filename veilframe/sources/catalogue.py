"""The pattern catalogue as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from veilframe.catalog import PatternSpec, argentina_specs, general_specs

SCHEMA = (
    "ord int, name string, pattern string, origin string, description string, country string, "
    "confidence double, example string, has_context boolean"
)


def pattern_catalog(spark: SparkSession, specs: Sequence[PatternSpec] | None = None) -> DataFrame:
    """All patterns with what is reported for them."""
    specs = general_specs() + argentina_specs() if specs is None else specs
    rows = [
        (
            i, s.name, s.pattern, "international" if s.method == "international_regex" else "general",
            s.description, s.country, s.confidence, s.example, s.context is not None,
        )
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(rows, SCHEMA)
