"""What the operators of this subpackage share: columns, row keys, saved tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.workspace import workspace

#: The characters that part words, for use inside a bracket of a Java regex.
SPACE = r"\x20\x09-\x0D"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so
    a lost executor costs a read and not the work before.
    """
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: Column) -> Column:
    """128 bits that rows share only if they have equal values, nulls included."""
    marked = [part for c in columns for part in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *marked).alias("b"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns can't clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str], /, **new: Column) -> DataFrame:
    """The columns of a packed row with new ones; a new one replaces its namesake."""
    taken = {n.lower() for n in new}
    kept = [F.col(row).getField(n).alias(n) for n in names if n.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


class Memory:
    """What was used of late: when the young generation is full, it becomes the old one."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
