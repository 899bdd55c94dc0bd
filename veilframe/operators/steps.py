"""Computing a costly column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column whose expression must run once per row.

    A plain projection is merged into whatever reads the column: a filter on
    it, or the filter that Spark infers below an explode, would search the text
    a second time.  Generating exactly one row from a one-element array keeps
    the expression where it is, while filters on other columns still pass.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, array: str, kept: list[str], pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per element with its position; no filter is inferred below."""
    return df.select(*kept, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
