"""Rewriting documents by their verdicts, and reporting on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import DEFAULT_TRANSFORM
from veilframe.functions.findings import instance_count, type_count_map
from veilframe.functions.replacing import replace_many
from veilframe.functions.tokens import check_method, replace_in_order, replacements, token_for
from veilframe.operators.steps import compute_once

# up to so many values, one walk of the text for each costs less than a way to Python and back
FEW_VALUES = 64


def transform_data(
    df: DataFrame,
    salt: str,
    method: str | Column = DEFAULT_TRANSFORM,
    nonce: str | None = None,
    key: str = "doc_id",
    many_values: bool = True,
) -> DataFrame:
    """Add `transformed_text` to rows with `text` and `pii_matches`.

    The same salt gives the same pseudonym for the same value everywhere.  A
    method given as a column may differ per row; unknown names pseudonymize.

    Values are replaced one after the other, each with a walk of the text.  With
    `many_values`, a row of more than 64 of them is done by an automaton in one walk,
    in Python, with the same result; other rows stay in Spark's expressions.
    """
    if isinstance(method, str):
        check_method(method)
    if nonce is None and (not isinstance(method, str) or method == "tokenize"):
        raise ValueError("tokenize needs a nonce that names the run")
    pairs = replacements(F.col("pii_matches"), lambda p: token_for(method, p, F.col(key), salt, nonce))
    paired = compute_once(df, "_pairs", pairs)
    if not many_values:
        lean = _without_repeats(paired)
        return compute_once(lean, "transformed_text", replace_in_order(F.col("text"), F.col("_pairs"))).drop("_pairs")
    is_many = F.coalesce(F.size("_pairs") > FEW_VALUES, F.lit(False))
    parted = paired.withColumns({"_many": F.when(is_many, F.col("_pairs")), "_pairs": F.when(~is_many, F.col("_pairs"))})
    lean = _without_repeats(parted)
    few = compute_once(lean, "_few", F.when(F.col("_many").isNull(), replace_in_order(F.col("text"), F.col("_pairs"))))
    long = F.when(F.col("_many").isNotNull(), F.col("text"))
    many = replace_many(long, F.transform("_many", lambda p: p["value"]), F.transform("_many", lambda p: p["token"]))
    done = few.withColumn("transformed_text", F.coalesce(many, F.col("_few")))
    return done.drop("_pairs", "_many", "_few")


def _without_repeats(df: DataFrame) -> DataFrame:
    """Drop replacements that would find nothing left to replace.

    A value that occurs a thousand times is a thousand matches, and each would
    walk the whole text.  After the first one the value can only stand in an
    inserted token or across its edge, so a repeat is kept if some token
    contains the value or the value has a character of a token's edge.
    """
    pairs = F.col("_pairs")
    repeats = F.size(F.array_distinct(F.transform(pairs, lambda p: p["value"]))) < F.size(pairs)
    by_value = F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["pos"].alias("pos"), p["token"].alias("token")))
    sorted_ = compute_once(df, "_sorted", F.when(repeats, F.sort_array(by_value)))
    tokens = F.array_join(F.transform(pairs, lambda p: p["token"]), "\n")
    known = compute_once(sorted_, "_tokens", F.when(F.col("_sorted").isNotNull(), tokens))

    def kept(pair: Column, i: Column) -> Column:
        first = (i == 0) | (F.element_at(F.col("_sorted"), i)["value"] != pair["value"])
        return first | pair["value"].rlike(r"[\[\]*]") | F.contains(F.col("_tokens"), pair["value"])

    ordered = F.sort_array(
        F.transform(
            F.filter("_sorted", kept),
            lambda p: F.struct(p["pos"].alias("pos"), p["value"].alias("value"), p["token"].alias("token")),
        )
    )
    return compute_once(known, "_pairs", F.coalesce(ordered, pairs)).drop("_sorted", "_tokens")


def pseudonymize(df: DataFrame, salt: str) -> DataFrame:
    """Matches become consistent tokens."""
    return transform_data(df, salt, "pseudonymize")


def anonymize(df: DataFrame) -> DataFrame:
    """Matches become the name of their type."""
    return transform_data(df, "", "anonymize")


def tokenize(df: DataFrame, nonce: str, key: str = "doc_id") -> DataFrame:
    """Matches become tokens that no other match has in this run."""
    return transform_data(df, "", "tokenize", nonce, key)


def mask(df: DataFrame) -> DataFrame:
    """Matches become asterisks, one per character."""
    return transform_data(df, "", "mask")


def transform_report(
    df: DataFrame, method: str | Column = DEFAULT_TRANSFORM, preserve_context: bool = True
) -> DataFrame:
    """Add `transformation_report` to rows of `transform_data`."""
    found = F.col("pii_matches")
    impact = F.when(
        F.length("text") > 0, 1 - F.length("transformed_text") / F.length("text")
    ).otherwise(F.lit(0.0))
    return df.withColumn(
        "transformation_report",
        F.struct(
            (F.lit(method) if isinstance(method, str) else method).alias("transformation_method"),
            instance_count(found).cast("long").alias("total_pii_instances"),
            type_count_map(found).cast("map<string,bigint>").alias("pii_types_identified"),
            impact.alias("transformation_impact"),
            F.lit(preserve_context).alias("preserved_context"),
        ),
    )
