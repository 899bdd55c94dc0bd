"""Column functions on the array of findings that one document carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.catalog import DEFAULT_CONFIDENCE


def match_key(type_: Column, matches: Column, ignore_case: bool = False) -> tuple[Column, Column]:
    """What makes two findings equal: type and sorted matches, duplicates counted."""
    if ignore_case:
        return F.lower(type_), F.sort_array(F.transform(matches, lambda m: F.lower(m)))
    return type_, F.sort_array(matches)


def _method(finding: Column) -> Column:
    return F.coalesce(finding["detection_method"], F.lit("unknown"))


def score_map(findings: Column, with_confidence: bool = True, quantum: Column | None = None) -> Column:
    """Method -> score of one document's deduplicated findings.

    The share of the findings made by the method, averaged with the method's
    mean confidence (missing = 0.5) unless `with_confidence` is off.  `quantum`
    is a classifier probability scored as one more method.
    """
    total = F.greatest(F.size(findings), F.lit(1))

    def entry(method: Column) -> Column:
        own = F.filter(findings, lambda f: _method(f) == method)
        share = F.size(own) / total
        if not with_confidence:
            return F.struct(method.alias("key"), share.alias("value"))
        summed = F.aggregate(
            own, F.lit(0.0), lambda acc, f: acc + F.coalesce(f["confidence"], F.lit(DEFAULT_CONFIDENCE))
        )
        return F.struct(method.alias("key"), ((share + summed / F.size(own)) / 2).alias("value"))

    entries = F.transform(F.array_distinct(F.transform(findings, _method)), entry)
    if quantum is not None:
        extra = F.array(F.struct(F.lit("quantum").alias("key"), ((quantum + DEFAULT_CONFIDENCE) / 2).alias("value")))
        entries = F.when(quantum.isNotNull(), F.concat(entries, extra)).otherwise(entries)
    return F.map_from_entries(entries)


def instance_count(findings: Column) -> Column:
    """Number of matches in all findings."""
    return F.aggregate(findings, F.lit(0), lambda acc, f: acc + F.size(f["matches"]))


def type_count_map(findings: Column) -> Column:
    """Type -> number of matches."""

    def entry(type_: Column) -> Column:
        own = F.filter(findings, lambda f: F.coalesce(f["type"], F.lit("unknown")) == type_)
        return F.struct(type_.alias("key"), instance_count(own).alias("value"))

    types = F.array_distinct(F.transform(findings, lambda f: F.coalesce(f["type"], F.lit("unknown"))))
    return F.map_from_entries(F.transform(types, entry))
