"""Prompts for a language model and findings from its answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import METHOD_RANK, PROMPT_GUIDE, PROMPT_HEAD, PROMPT_TAIL, PROMPT_TYPES, RESPONSE_KEYS
from veilframe.operators.skew import join_many_to_one
from veilframe.operators.steps import compute_once, spread

KEYS = ["doc_id", "chunk_idx"]


def add_type(types: Sequence[str], new: str) -> list[str]:
    """The list with a further type, if it is not in it."""
    return list(types) if new in types else [*types, new]


def prompt(text: Column, types: Sequence[str] | Column = tuple(PROMPT_TYPES)) -> Column:
    """The question put to the model for one chunk."""
    listed = F.array_join(types, ", ") if isinstance(types, Column) else F.lit(", ".join(types))
    return F.concat(F.lit(PROMPT_HEAD), listed, F.lit(PROMPT_GUIDE), text, F.lit(PROMPT_TAIL))


def build_prompts(chunks: DataFrame, types: Sequence[str] | Column = tuple(PROMPT_TYPES)) -> DataFrame:
    """Add `prompt` to every chunk."""
    return chunks.withColumn("prompt", prompt(F.col("text"), types))


def with_custom_type(df: DataFrame, column: str, new: str | Column) -> DataFrame:
    """Add a type to a column of type lists, where it is not in the list."""
    value = F.lit(new) if isinstance(new, str) else new
    return df.withColumn(column, F.array_union(F.col(column), F.array(value)))


def _items(answer: Column) -> Column:
    """The JSON list in an answer, items as string maps; NULL if there is none.

    An answer that is one JSON value counts as it stands.  Otherwise the first
    bracketed list of objects in it is taken.
    """
    kind = "array<map<string,string>>"
    strict = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.when(F.ltrim(answer).startswith("["), answer), kind, strict)
    is_object = F.ltrim(answer).startswith("{") & F.rtrim(answer).endswith("}") & F.try_parse_json(answer).isNotNull()
    bracketed = F.regexp_extract(answer, r"(?s)(\[\{.*?\}\])", 1)
    return F.coalesce(listed, F.from_json(F.when(~is_object, bracketed), kind, strict))


def _has_all_keys(item: Column) -> Column:
    return reduce(and_, [F.map_contains_key(item, key) for key in RESPONSE_KEYS])


def _number(value: Column, kind: str) -> Column:
    """The number a JSON value stands for; NULL if it stands for none."""
    number = value.try_cast("double")
    return number if kind == "double" else number.try_cast(kind)


def _as_item(item: Column) -> Column:
    return F.struct(
        item["type"].alias("type"),
        item["value"].alias("value"),
        _number(item["confidence"], "double").alias("confidence"),
        _number(item["start_index"], "int").alias("start"),
        _number(item["end_index"], "int").alias("end"),
    )


def _in_place(text: Column, item: Column) -> Column:
    covered = F.substring(text, item["start"] + 1, item["end"] - item["start"])
    return (item["start"] >= 0) & (covered == item["value"])


def parse_responses(chunks: DataFrame, responses: DataFrame, rank: int = METHOD_RANK["llm_semantic"]) -> DataFrame:
    """Findings from answers: items with all keys whose value stands in the
    text at the given place.  Anything else gives no rows.

    Items are read and checked within the row of answer and text; only those
    that hold leave it, without the text.
    """
    joined = join_many_to_one(responses.select(*KEYS, "response"), chunks.select(*KEYS, "text"), KEYS)
    parsed = compute_once(joined, "_items", _items(F.col("response")))
    complete = F.filter("_items", _has_all_keys)
    placed = F.filter(F.transform(complete, _as_item), lambda item: _in_place(F.col("text"), item))
    checked = compute_once(parsed, "_items", placed)
    return spread(checked, "_items", KEYS, "ord").select(
        *KEYS,
        F.lit(rank).alias("method_rank"),
        "ord",
        F.col("item.type").alias("type"),
        F.array("item.value").alias("matches"),
        F.lit("llm_semantic").alias("detection_method"),
        F.col("item.confidence").alias("confidence"),
        F.lit(None).cast("struct<start:int,end:int>").alias("location"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("description"),
    )
