"""Findings from entity spans that an external tagger has written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from veilframe.catalog import (
    GLINER_CONFIDENCE,
    GLINER_ENTITIES,
    GLINER_LABELS,
    METHOD_RANK,
    NER_CONFIDENCE,
    NER_LABELS,
    PRESIDIO_ENTITIES,
    PRESIDIO_INTERNATIONAL_ENTITIES,
    PRESIDIO_SERVICE_ENTITIES,
)
from veilframe.functions.text import pieces
from veilframe.operators.skew import fold_many_to_one
from veilframe.operators.steps import compute_once, spread
from veilframe.schemas import SPANS

KEYS = ["doc_id", "chunk_idx"]


BLOCK = 1000


def _covered(blocks: Column, text: Column, start: Column, end: Column) -> Column:
    """What a span covers, from the one or two blocks of the text that it touches.

    A plain `substring` would walk the text from its start for each span.
    """
    touched = F.transform(F.sequence((start / BLOCK).cast("int"), ((end - 1) / BLOCK).cast("int")), lambda i: F.get(blocks, i))
    near = F.substring(F.array_join(touched, ""), (start % BLOCK + 1).cast("int"), end - start)
    return F.when((start >= 0) & (end > start), near).otherwise(F.substring(text, start + 1, end - start))


def _cut(joined: DataFrame, kept: list[str]) -> DataFrame:
    """One row per span with its `value`, from rows of a text and `items`, its spans.

    The text is cut in blocks once, in one pass, however many spans it has, and is
    not copied to them.
    """
    blocks = compute_once(joined, "_blocks", pieces(F.col("text"), BLOCK))

    def value(span: Column) -> Column:
        covered = _covered(F.col("_blocks"), F.col("text"), span["span_start"], span["span_end"])
        return F.struct(*[span[c].alias(c) for c in kept], covered.alias("value"))

    found = compute_once(blocks, "_found", F.transform("items", value))
    return spread(found.select(*KEYS, "_found"), "_found", KEYS, "_at", "_f").select(*KEYS, "_f.*")


def span_texts(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span with the text it covers; offsets count code points."""
    joined = fold_many_to_one(spans, chunks.select(*KEYS, "text"), KEYS)
    return _cut(joined, [c for c in spans.columns if c not in KEYS])


def _map_label(labels: Mapping[str, str], label: Column) -> Column:
    """Mapped label; labels without an entry in lower case."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[label], F.lower(label))


def _reported(spans: DataFrame, type_: Column, method: str, confidence: Column, rank: int) -> DataFrame:
    """Spans with what will be reported for them; no text is needed for that."""
    return spans.select(
        *KEYS, "ord", "span_start", "span_end",
        type_.alias("type"),
        F.lit(method).alias("detection_method"),
        confidence.cast("double").alias("confidence"),
        F.lit(rank).alias("method_rank"),
    )


def span_findings(chunks: DataFrame, *reported: DataFrame) -> DataFrame:
    """Findings of any number of detectors with one join to the texts.

    Where `chunks` has `methods`, a detector's spans count only for the rows
    that ask for it.
    """
    spans = reduce(DataFrame.unionByName, reported)
    gated = "methods" in chunks.columns
    joined = fold_many_to_one(spans, chunks.select(*KEYS, "text", *(["methods"] if gated else [])), KEYS)
    if gated:
        joined = joined.withColumn("items", F.filter("items", lambda s: F.array_contains("methods", s["detection_method"])))
    return _cut(joined, [c for c in spans.columns if c not in KEYS]).select(
        *KEYS,
        "method_rank",
        "ord",
        "type",
        F.array("value").alias("matches"),
        "detection_method",
        "confidence",
        F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("location"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("description"),
    )


def presidio_entities(methods: Sequence[str], countries: Sequence[str]) -> list[str]:
    """Allow-list of the library service, wider if Argentina is supported."""
    wide = "international" in methods and "AR" in countries
    return PRESIDIO_SERVICE_ENTITIES + (PRESIDIO_INTERNATIONAL_ENTITIES if wide else [])


def presidio_spans(
    spans: DataFrame, entities: Sequence[str] = tuple(PRESIDIO_ENTITIES), rank: int = METHOD_RANK["presidio"]
) -> DataFrame:
    """Spans of the allowed entities, with the tagger's score.  The label filter
    runs before any join and reaches the scan."""
    kept = spans.filter(F.col("label").isin(list(entities)))
    return _reported(kept, F.lower("label"), "presidio", F.col("score"), rank)


def ner_spans(spans: DataFrame, labels: Mapping[str, str] = NER_LABELS, rank: int = METHOD_RANK["ner"]) -> DataFrame:
    """All spans, labels mapped to finding types."""
    return _reported(spans, _map_label(labels, F.col("label")), "ner", F.lit(NER_CONFIDENCE), rank)


def gliner_spans(
    spans: DataFrame,
    entities: Sequence[str] = tuple(GLINER_ENTITIES),
    method: str = "gliner",
    confidence: float | None = GLINER_CONFIDENCE,
    rank: int = METHOD_RANK["gliner"],
) -> DataFrame:
    """Spans of the requested entity names, or of all if `ALL` is requested.

    The library service reports them as method ``ner`` with no confidence.
    """
    named = spans.withColumn("label", _map_label(GLINER_LABELS, F.col("label")))
    if "ALL" not in entities:
        named = named.filter(F.col("label").isin(list(entities)))
    return _reported(named, F.lower("label"), method, F.lit(confidence), rank)


def detect_presidio(chunks: DataFrame, spans: DataFrame, *args, **kwargs) -> DataFrame:
    """Findings of `presidio_spans`."""
    return span_findings(chunks, presidio_spans(spans, *args, **kwargs))


def detect_ner(chunks: DataFrame, spans: DataFrame, *args, **kwargs) -> DataFrame:
    """Findings of `ner_spans`."""
    return span_findings(chunks, ner_spans(spans, *args, **kwargs))


def detect_gliner(chunks: DataFrame, spans: DataFrame, *args, **kwargs) -> DataFrame:
    """Findings of `gliner_spans`."""
    return span_findings(chunks, gliner_spans(spans, *args, **kwargs))


TAGGED_AT_ONCE = 10_000


def custom_recognizer(
    docs: DataFrame, predict: Callable[[str, list[str]], list[dict]], entities: Sequence[str] = ("ALL",)
) -> DataFrame:
    """Spans from a user's recognizer.

    `predict(text, entities)` gives dicts with label, start, end and, if it has
    one, score.  It runs inside the tasks on Arrow batches; for a recognizer that
    loads a model see `recognizer_function`.
    """
    wanted = list(entities)
    columns = SPANS.fieldNames()
    if "chunk_idx" not in docs.columns:
        docs = docs.withColumn("chunk_idx", F.lit(0))

    def tag(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, chunk_idx, text in zip(batch["doc_id"], batch["chunk_idx"], batch["text"]):
                for ord_, span in enumerate([] if text is None else predict(text, wanted)):
                    rows.append((doc_id, chunk_idx, ord_, span["label"], span["start"], span["end"], span.get("score")))
                    if len(rows) >= TAGGED_AT_ONCE:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return docs.select("doc_id", "chunk_idx", "text").mapInPandas(tag, SPANS)


_MODELS: dict[str, Callable] = {}


def recognizer_function(build: Callable[[], Callable[[str, list[str]], Iterable[dict]]], entities: Sequence[str] = ("ALL",)):
    """A table function of a user's recognizer, whose model every Python worker builds once.

    `build()` gives the recognizer: called with a text and entity names, it gives
    spans one after the other, as `custom_recognizer` describes them.  They leave the
    worker as they are found.  Use it with `recognize`, or on a table argument:

        tag = recognizer_function(load_my_tagger)
        tag(docs.asTable())                     # rows where they are
        tag(docs.asTable().partitionBy("lang"))
    """
    wanted, name = list(entities), uuid.uuid4().hex
    columns = SPANS

    class Recognizer:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not {"doc_id", "chunk_idx", "text"} <= set(table.dataType.fieldNames()):
                raise ValueError("a table with doc_id, chunk_idx and text is needed")
            return AnalyzeResult(schema=columns)

        def __init__(self):
            if name not in _MODELS:
                _MODELS[name] = build()
            self.predict = _MODELS[name]

        def eval(self, row):
            if row["text"] is not None:
                for i, span in enumerate(self.predict(row["text"], wanted)):
                    yield row["doc_id"], row["chunk_idx"], i, span["label"], span["start"], span["end"], span.get("score")

    return F.udtf(Recognizer)


def recognize(docs: DataFrame, function) -> DataFrame:
    """Spans that a `recognizer_function` finds in every text, read where it lies, without a shuffle."""
    if "chunk_idx" not in docs.columns:
        docs = docs.withColumn("chunk_idx", F.lit(0))
    return function(docs.select("doc_id", "chunk_idx", "text").asTable())
