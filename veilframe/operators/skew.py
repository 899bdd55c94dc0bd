"""Joining many rows per key with one row per key when a few keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100
TRACKED_KEYS = 10000
FOLDED_ROWS = 20_000


def hot_counts(many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At most 100 key hashes with the most rows and their numbers, from one pass with a sketch.

    Only key columns are read and one small sketch per task is shuffled.
    """
    hashed = many.select(F.xxhash64(*keys).alias("_hash"))
    top = hashed.agg(F.expr(f"approx_top_k(_hash, {MAX_HOT_KEYS}, {TRACKED_KEYS})").alias("top"))
    return top.select(F.inline("top")).select(F.col("item").alias("_hash"), F.col("count").alias("_rows"))


def hot_keys(many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key hashes of `hot_counts`."""
    return hot_counts(many, keys).select("_hash")


def join_many_to_one(many: DataFrame, one: DataFrame, keys: Sequence[str], salts: int = 32) -> DataFrame:
    """Inner join of `many` rows with the one row of their key.

    The rows of the 100 fullest keys are spread over `salts` tasks and the
    single matching row is copied to each, so a key with a third of all rows
    does not end in one task.  All other keys are joined as they are.  The list
    of hot keys is broadcast; its length is bounded by the sketch.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(many, keys).withColumn("_hot", F.lit(True)))
    payload = [c for c in many.columns if c not in keys]
    # The same for a retried task, unlike a random draw; the partition number
    # spreads equal rows too.
    place = F.xxhash64(*payload, F.spark_partition_id())
    spread = (
        many.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(place, F.lit(salts)).cast("int")).otherwise(F.lit(0)),
        )
        .drop("_hash", "_hot")
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copied = (
        one.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0)))))
        .drop("_hash", "_hot")
    )
    return spread.join(copied, [*keys, "_salt"]).drop("_salt")


def fold_many_to_one(many: DataFrame, one: DataFrame, keys: Sequence[str], folded: int = FOLDED_ROWS) -> DataFrame:
    """Inner join of `many` rows, folded to one array `items` per key, with the one row of their key.

    The row of `one` is copied once per fold instead of once per row of `many`.  A fold
    of a hot key has about `folded` rows: as many folds as it takes are made of the
    100 fullest keys, each with a copy of the matching row, and dealt to as many tasks.
    """
    keys = list(keys)
    parts = F.ceil(F.col("_rows") / folded).cast("int")
    hot = F.broadcast(hot_counts(many, keys).select("_hash", parts.alias("_parts")).filter("_parts > 1"))
    payload = [c for c in many.columns if c not in keys]
    place = F.xxhash64(*payload, F.spark_partition_id())
    dealt = (
        many.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn("_part", F.coalesce(F.pmod(place, F.col("_parts")).cast("int"), F.lit(0)))
    )
    items = dealt.groupBy(*keys, "_part").agg(F.collect_list(F.struct(*payload)).alias("items"))
    copied = (
        one.withColumn("_hash", F.xxhash64(*keys))
        .join(hot, "_hash", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_hash", "_parts")
    )
    return items.join(copied, [*keys, "_part"]).drop("_part")
