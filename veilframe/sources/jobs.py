"""Requests: one row per job with its options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import (
    DEFAULT_COUNTRIES,
    DEFAULT_TRANSFORM,
    DETECT_METHODS,
    FORM_METHODS,
    TRANSFORM_METHODS,
)


def job_requests(requests: DataFrame) -> DataFrame:
    """Fill in defaults and split the option lists.

    `requests` has endpoint (detect, transform, or form for a direct
    submission), methods, countries and transform_method, the options as comma
    lists or NULL.  Names are not trimmed.
    """
    endpoint = F.col("endpoint")
    default_methods = (
        F.when(endpoint == "detect", DETECT_METHODS).when(endpoint == "transform", TRANSFORM_METHODS).otherwise(FORM_METHODS)
    )
    return requests.withColumns({
        "methods": F.split(F.coalesce("methods", default_methods), ","),
        "countries": F.split(F.coalesce("countries", F.lit(DEFAULT_COUNTRIES)), ","),
        "transform_method": F.when(
            endpoint == "transform", F.coalesce("transform_method", F.lit(DEFAULT_TRANSFORM))
        ),
        "status": F.lit("processing"),
        "progress": F.lit(0),
    })
