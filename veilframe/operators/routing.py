"""Which detector sees which chunk, and what is kept of the findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import DEFAULT_CONFIDENCE, ML_METHODS, REGEX_METHODS, SERVICE_DEFAULTS


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def asks_for(methods: Column, names: Sequence[str]) -> Column:
    """Whether a list of methods has one of these names."""
    return F.coalesce(F.arrays_overlap(methods, _names(names)), F.lit(False))


def route_regex(tasks: DataFrame) -> DataFrame:
    """Rows for the pattern detectors."""
    return tasks.filter(asks_for(F.col("methods"), REGEX_METHODS))


def route_ml(tasks: DataFrame) -> DataFrame:
    """Rows for the model detectors, any of the five."""
    return tasks.filter(asks_for(F.col("methods"), ML_METHODS))


def only_method(tasks: DataFrame, name: str) -> DataFrame:
    """Rows whose methods name this detector; put before the detector's work."""
    return tasks.filter(F.array_contains("methods", name))


def with_methods_run(tasks: DataFrame, available: Sequence[str] = tuple(ML_METHODS)) -> DataFrame:
    """Add `methods_run`: the available detectors that the row asks for, in
    the order of running."""
    return tasks.withColumn("methods_run", F.array_intersect(_names(available), F.col("methods")))


def merge_config(df: DataFrame) -> DataFrame:
    """User settings over the defaults, column by column.

    A setting the table has no column for, or a NULL in it, is the default.
    """

    def default(value):
        return _names(value) if isinstance(value, list) else F.lit(value)

    merged = {
        name: F.coalesce(F.col(name), default(value)) if name in df.columns else default(value)
        for name, value in SERVICE_DEFAULTS.items()
    }
    return df.withColumns(merged)


def confidence_filter(findings: DataFrame, threshold: float = SERVICE_DEFAULTS["confidence_threshold"]) -> DataFrame:
    """Findings with at least that confidence; a missing one counts as 0.5."""
    return findings.filter(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)) >= threshold)
