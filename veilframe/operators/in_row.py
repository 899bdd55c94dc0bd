"""Merging the findings that sit in the row of their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.findings import match_key
from veilframe.operators.steps import compute_once


def dedup_array(df: DataFrame, column: str, ignore_case: bool = False) -> DataFrame:
    """Keep the first of equal findings in an array column, in order.

    Sort by (key, position), keep the heads of the runs, put them back in
    position order: n log n for a document with many findings, and no shuffle.
    """

    def keyed(finding: Column, i: Column) -> Column:
        type_, matches = match_key(finding["type"], finding["matches"], ignore_case)
        return F.struct(type_.alias("t"), matches.alias("m"), i.alias("pos"))

    def head_of_run(item: Column, i: Column) -> Column:
        before = F.element_at(F.col("_sorted"), i)
        return (i == 0) | (before["t"] != item["t"]) | (before["m"] != item["m"])

    several = F.size(column) > 1
    ranked = compute_once(df, "_sorted", F.when(several, F.sort_array(F.transform(column, keyed))))
    kept = F.transform(
        F.sort_array(F.transform(F.filter("_sorted", head_of_run), lambda item: item["pos"])),
        lambda pos: F.element_at(F.col(column), pos + 1),
    )
    return compute_once(ranked, column, F.when(several, kept).otherwise(F.col(column))).drop("_sorted")
