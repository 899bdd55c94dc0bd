"""Column functions that search text with patterns."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.catalog import ARGENTINA_NAMES, PatternSpec, lookup
from veilframe.schemas import FINDING

NO_HITS = "array<string>"
NO_FINDINGS = f"array<{FINDING.simpleString()}>"


def _literal(pattern: str, lead: str | None = None) -> Column:
    ahead = f"(?={lead})" if lead else ""
    return F.lit(f"(?U){ahead}{pattern}")


def find_all(text: Column, pattern: str, lead: str | None = None, literal: str | None = None) -> Column:
    """All hits in text order, whole matches only; empty matches are skipped.

    `lead` (what a hit starts with) and `literal` (what a hit contains) must
    follow from the pattern; they only save time.
    """
    hits = F.regexp_extract_all(text, _literal(pattern, lead), F.lit(0))
    if lead is None and literal is None:
        hits = F.filter(hits, lambda hit: hit != "")
    if literal is not None:
        hits = F.when(F.contains(text, F.lit(literal)), hits)
    return F.coalesce(hits, F.array().cast(NO_HITS))


def find_spec(text: Column, spec: PatternSpec) -> Column:
    """All hits of a catalogue entry, its context not looked at."""
    return find_all(text, spec.pattern, spec.lead, spec.literal)


def match_pii(text: Column, name: str) -> Column:
    """Hits of the general pattern of that name; no hits for an unknown name."""
    pattern = lookup(name)
    return F.array().cast(NO_HITS) if pattern is None else find_all(text, pattern)


def validate_pii(value: Column, name: str) -> Column:
    """Whether the whole value is one hit of that pattern; false for an unknown name."""
    pattern = lookup(name)
    if pattern is None:
        return F.lit(False)
    return F.coalesce(value.rlike(rf"(?U)\A(?:{pattern})\z"), F.lit(False))


def in_context(text: Column, context: str | None) -> Column:
    """Whether the context words occur anywhere in the text."""
    return F.lit(True) if context is None else text.rlike(f"(?U){context}")


def gated_hits(text: Column, spec: PatternSpec) -> Column:
    """Hits of a pattern, none if its context words are missing."""
    box = F.array(find_spec(text, spec))
    kept = F.filter(box, lambda hits: (F.size(hits) > 0) & in_context(text, spec.context))
    return F.coalesce(F.get(kept, F.lit(0)), F.array().cast(NO_HITS))


def _finding(text: Column, spec: PatternSpec, shapes: Column) -> Column:
    hits = find_spec(text, spec)
    if spec.shape is not None:
        hits = F.coalesce(F.when(shapes[_flag(spec.shape)], hits), F.array().cast(NO_HITS))
    return F.struct(
        F.lit(spec.name).alias("type"),
        hits.alias("matches"),
        F.lit(spec.method).alias("detection_method"),
        F.lit(spec.confidence).cast("double").alias("confidence"),
        F.lit(None).cast("struct<start:int,end:int>").alias("location"),
        F.lit(spec.country).cast("string").alias("country"),
        F.lit(spec.description).cast("string").alias("description"),
    )


def _flag(shape: str) -> str:
    return f"s{zlib.crc32(shape.encode())}"


def _reported(text: Column, specs: Sequence[PatternSpec]):
    """Predicate on a finding: it has hits, and its context words are there."""
    contexts: dict[str, list[str]] = {}
    for spec in specs:
        if spec.context is not None:
            contexts.setdefault(spec.context, []).append(spec.name)

    def test(finding: Column) -> Column:
        hit = F.size(finding["matches"]) > 0
        if not contexts:
            return hit
        branches = [(finding["type"].isin(names), in_context(text, ctx)) for ctx, names in contexts.items()]
        first, *rest = branches
        gate = reduce(lambda acc, branch: acc.when(*branch), rest, F.when(*first))
        return hit & gate.otherwise(F.lit(True))

    return test


def pattern_findings(text: Column, specs: Sequence[PatternSpec]) -> Column:
    """One finding per pattern with hits, in catalogue order.

    All patterns are literals in one expression, so each is compiled once per
    task, and the hits of a text are found without a join or a shuffle.  A text
    with neither a digit nor an ``@`` is settled by one search; else one search
    per shape (the one-element array holds their outcomes) picks the patterns
    that are worth running.
    """
    if not specs:
        return F.array().cast(NO_FINDINGS)
    shapes = sorted({spec.shape for spec in specs if spec.shape is not None})
    flags = F.struct(F.lit(True).alias("any"), *[text.rlike(f"(?U){s}").alias(_flag(s)) for s in shapes])
    reported = _reported(text, specs)
    found = F.get(
        F.transform(
            F.array(flags),
            lambda has: F.filter(F.array(*[_finding(text, spec, has) for spec in specs]), reported),
        ),
        F.lit(0),
    )
    if all(spec.has_digit for spec in specs):
        found = F.when(text.rlike(r"(?U)\d"), found)
    elif all(spec.has_digit or spec.literal == "@" for spec in specs):
        found = F.when(text.rlike(r"(?U)[\d@]"), found)
    return F.coalesce(found, F.array().cast(NO_FINDINGS))


def wants_argentina(countries: Column) -> Column:
    """Whether an array of country names asks for the Argentine patterns."""
    return F.coalesce(F.arrays_overlap(countries, F.array(*[F.lit(c) for c in ARGENTINA_NAMES])), F.lit(False))
