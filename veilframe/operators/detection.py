"""Pattern detection on documents or chunks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import (
    ARGENTINA_NAMES,
    REGEX_CONFIDENCE,
    PatternSpec,
    argentina_specs,
    general_specs,
    ungated_argentina_specs,
)
from veilframe.functions.literals import literal_index, present, required_literals
from veilframe.functions.patterns import NO_FINDINGS, pattern_findings, wants_argentina
from veilframe.operators.steps import compute_once, spread
from veilframe.schemas import FINDING_FIELDS

Countries = Sequence[str] | Column | None


def _argentina(text: Column, countries: Countries) -> Column | None:
    """Findings of the Argentine patterns, None where they are not asked for."""
    if isinstance(countries, Column):
        found = pattern_findings(text, argentina_specs())
        return F.coalesce(F.when(wants_argentina(countries), found), F.array().cast(NO_FINDINGS))
    if countries and set(countries) & set(ARGENTINA_NAMES):
        return pattern_findings(text, argentina_specs())
    return None


def regex_findings(
    text: Column, countries: Countries = None, specs: Sequence[PatternSpec] | None = None
) -> Column:
    """General patterns always, Argentine ones if a country asks for them.

    `countries` is a list, or a column of lists where it differs per row.
    """
    base = list(specs) if specs is not None else general_specs()
    if isinstance(countries, Column):
        return F.concat(pattern_findings(text, base), _argentina(text, countries))
    if countries and set(countries) & set(ARGENTINA_NAMES):
        base += argentina_specs()
    return pattern_findings(text, base)


def detect_regex(
    df: DataFrame, countries: Countries = None, specs: Sequence[PatternSpec] | None = None
) -> DataFrame:
    """Add `findings` to every row of a table with `text`."""
    return compute_once(df, "findings", regex_findings(F.col("text"), countries, specs))


def scored_specs(international: bool = True) -> list[PatternSpec]:
    """General patterns at confidence 0.8, with the Argentine ones as plain
    patterns if the service is configured for them."""
    extra = ungated_argentina_specs(REGEX_CONFIDENCE) if international else []
    return general_specs(REGEX_CONFIDENCE) + extra


def detect_regex_scored(df: DataFrame, international: bool = True) -> DataFrame:
    """As `detect_regex`, every finding with a confidence."""
    return compute_once(df, "findings", pattern_findings(F.col("text"), scored_specs(international)))


def detect_argentina(df: DataFrame) -> DataFrame:
    """Add the findings of the Argentine patterns, context words required."""
    return compute_once(df, "findings", pattern_findings(F.col("text"), argentina_specs()))


def detect_international(df: DataFrame, countries: Countries) -> DataFrame:
    """Country patterns for the supported countries; none for the others."""
    found = _argentina(F.col("text"), countries)
    return compute_once(df, "findings", F.array().cast(NO_FINDINGS) if found is None else found)


def finding_rows(df: DataFrame, method_rank: int = 0) -> DataFrame:
    """One row per finding from rows that carry `findings`."""
    if "chunk_idx" not in df.columns:
        df = df.withColumn("chunk_idx", F.lit(0))
    return spread(df, "findings", ["doc_id", "chunk_idx"], "ord", "f").select(
        "doc_id", "chunk_idx", F.lit(method_rank).alias("method_rank"), "ord",
        *[F.col(f"f.{name}").alias(name) for name in FINDING_FIELDS],
    )


def read_patterns(patterns: DataFrame, max_patterns: int = 10000) -> list[PatternSpec]:
    """The user's own catalogue (name, pattern), read by the driver, with its size checked."""
    rows = patterns.select("name", "pattern").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns")
    return [PatternSpec(r["name"], r["pattern"]) for r in sorted(rows, key=lambda r: r["name"])]


def explain_patterns(patterns: DataFrame, max_patterns: int = 10000) -> list[tuple[str, list[str]]]:
    """Each pattern's name with the strings of which a text must hold one for the pattern
    to be run on it; those without any are run on every text."""
    needs = [(spec.name, required_literals(spec.pattern)) for spec in read_patterns(patterns, max_patterns)]
    return [(name, sorted(need or [])) for name, need in needs]


def _present_patterns(spark, specs: Sequence[PatternSpec], text: Column) -> Column:
    """Numbers of the patterns that may have hits in a text, in order."""
    needs = {i: need for i, spec in enumerate(specs) if (need := required_literals(spec.pattern)) is not None}
    always = [i for i in range(len(specs)) if i not in needs]
    every = F.from_json(F.lit(json.dumps(always)), "array<int>")
    if not needs:
        return every
    shared = spark.sparkContext.broadcast(needs)
    made: list = []  # the index, once per task

    @F.arrow_udf("array<int>")
    def search(texts):
        import pyarrow as pa

        if not made:
            made.append(literal_index(shared.value))
        return pa.array([None if t.as_py() is None else present(made[0], t.as_py()) for t in texts], pa.list_(pa.int32()))

    found = F.coalesce(search(text), F.array().cast("array<int>"))
    return F.sort_array(F.concat(found, every)) if always else found


def docs_x_patterns(docs: DataFrame, patterns: DataFrame, max_patterns: int = 10000) -> DataFrame:
    """Every document searched with every pattern of a table (name, pattern).

    The table is the user's own catalogue, read by the driver.  One walk of a text
    finds which of the strings that the patterns' hits must contain are there; only
    the patterns that can have hits are run, so the cost of a text grows with those
    and not with the catalogue.  Patterns without such strings run on every text
    (`explain_patterns` lists them).  Documents are scanned once; nothing is shuffled or
    crossed.
    """
    specs = read_patterns(patterns, max_patterns)
    if not specs:
        return compute_once(docs, "findings", F.array().cast(NO_FINDINGS))
    listed = F.from_json(
        F.lit(json.dumps([{"name": s.name, "pattern": f"(?U){s.pattern}"} for s in specs])), "array<struct<name:string,pattern:string>>"
    )
    numbered = docs.withColumn("_present", _present_patterns(docs.sparkSession, specs, F.col("text")))
    numbered = compute_once(numbered, "_present", F.col("_present"))

    def finding(number: Column) -> Column:
        spec = F.get(listed, number)
        hits = F.filter(F.regexp_extract_all("text", spec["pattern"], F.lit(0)), lambda hit: hit != "")
        return F.struct(
            spec["name"].alias("type"), hits.alias("matches"), F.lit("regex").alias("detection_method"), F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("struct<start:int,end:int>").alias("location"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("description"),
        )

    found = F.filter(F.transform("_present", finding), lambda f: F.size(f["matches"]) > 0)
    return compute_once(numbered, "findings", F.coalesce(found, F.array().cast(NO_FINDINGS))).drop("_present")
