"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import saved


def _downhill(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, as (u, v) with u > v."""
    return edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two digests that tell whether they changed."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, label).

    Alternates two steps until nothing changes, each one a minimum by node
    and a join: every node hands its smallest neighbour to its larger ones,
    then to its smaller ones.  The number of rounds grows with the logarithm of
    the longest path, the number of edges never grows, and no group is gathered.
    A node with very many neighbours is a skewed join key, which adaptive
    execution splits; for that, minima are tables of their own.  Every step is a
    table in the shared folder.
    """
    current = saved(_downhill(edges, a, b), "edges")
    before = _state(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "lowest")
        large = both.join(lowest, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u > v").distinct(), "edges")
        lowest = saved(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "lowest")
        joined = large.join(lowest, F.col("u") == F.col("k"))
        small = joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        current = saved(small.filter("u > v").distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select("v", "v").distinct())
