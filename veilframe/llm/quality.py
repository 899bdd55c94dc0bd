"""Quality rules on counts, and on how far a document's histograms are from its language's.

All of it is SQL functions.  Two histograms of a document, its classes of
characters and the common words of its language, are held against the pooled
histograms of that language by the Jensen-Shannon distance.  Short documents have
ragged histograms, so each comparison has a least length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import SPACE, col, saved, unpacked, whole_row
from veilframe.operators.steps import compute_once

BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Base rules: fewest words, and most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Common words of each language that has a reference.
COMMON = {
    "de": "und der die das den dem des ein eine in zu mit von ist im auf für nicht sich auch".split(),
    "en": "the of and to a in that is was for it on with as be at by this are from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus avec".split(),
}
#: The reference of all other languages, which has no common words.
OTHER = "other"
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "white", "wide")
#: Least length for each comparison, and the distance from which a document is rejected.
LEAST_CHARS, MOST_CLASS_DISTANCE = 200, 0.35
LEAST_COMMON_WORDS, MOST_WORD_DISTANCE = 100, 0.32


def _removed(text: Column, pattern: str) -> Column:
    """How many code points of a text match runs of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def class_counts(text: Column, white: Column) -> Column:
    """Code points by class; `wide` counts the bytes beyond one for each."""
    upper, digit = _removed(text, "[A-Z]+"), _removed(text, "[0-9]+")
    punctuation = _removed(text, r"""[.,;:!?'"()\-]+""")
    symbol = _removed(text, r"[#*$%&|<>@=+/\\^_`~{}\[\]]+")
    wide = F.octet_length(text) - F.length(text)
    lower = F.greatest(F.length(text) - upper - digit - punctuation - symbol - white - wide, F.lit(0))
    return F.array(*[c.cast("long") for c in (lower, upper, digit, punctuation, symbol, white, wide)])


def _only(words: Column, common: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*common))


def common_words(words: Column, language: Column) -> Column:
    """The common words of the language among the words, two blanks around each."""
    chosen = None
    for name, common in COMMON.items():
        hits = _only(words, common)
        case = F.when if chosen is None else chosen.when
        chosen = case(language == name, F.concat(F.lit("  "), F.array_join(hits, "  "), F.lit("  ")))
    return chosen


def _histogram(hits: Column, n_words: Column, language: Column) -> Column:
    """How often each common word of the language occurs, and last all other words."""
    chosen = None
    for name, common in COMMON.items():
        counts = [((F.length(hits) - F.length(F.replace(hits, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in common]
        case = F.when if chosen is None else chosen.when
        chosen = case(language == name, F.array(*counts))
    total = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(chosen.isNotNull(), F.concat(chosen, F.array(n_words - total)))


def js_distance(counts_a: Column, counts_b: Column) -> Column:
    """Jensen-Shannon distance of two histograms, 0 to 1; null if one is empty."""
    def share(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(counts, lambda x: x / total))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)

    terms = F.zip_with(share(counts_a), share(counts_b), term)
    return F.sqrt(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))  # rounding may leave it just below 0


def measured(docs: DataFrame, text: str, lang: str | None, keep: list[str]) -> DataFrame:
    """Counts of each document: columns `row` (those kept), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, language, classes, common."""
    language = F.lit(OTHER) if lang is None else F.when(col(lang).isin(*COMMON), col(lang)).otherwise(F.lit(OTHER))
    rows = docs.select(whole_row(docs.select(*[col(c) for c in keep])).alias("row"), language.alias("language"), F.coalesce(col(text), F.lit("")).alias("t"))
    stripped = F.btrim(F.col("t"), F.lit(BLANK))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"[{SPACE}]+", -1))
    with_words = compute_once(rows, "words", words)
    full_lines = F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    counted = with_words.select(
        "row", "language", "words", "t", full_lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
    )
    counted = compute_once(counted, "lines", F.col("lines"))
    slim = counted.select(
        "row", "language", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        class_counts(F.col("t"), F.length("t") - F.col("word_chars")).alias("classes"),
        common_words(F.col("words"), F.col("language")).alias("hits"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # a hash of eight words from two of four, from two of two
    step = compute_once(slim, "h", F.when(F.col("n_words") >= WINDOW, F.col("h")).otherwise(F.array().cast("array<bigint>")))
    by = 1
    while by < WINDOW:
        n = F.greatest(F.size("h") - by, F.lit(0))
        step = compute_once(step, "h", F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b)))
        by *= 2
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.when(repeats, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = compute_once(step, "placed", placed).drop("h")

    def twice(x: Column, k: Column) -> Column:
        return (F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"])

    starts = F.sort_array(F.transform(F.filter("placed", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))
    step = compute_once(step, "starts", starts)
    spans = F.zip_with("starts", F.slice("starts", F.lit(2), F.size("starts")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return step.select(
        "row", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "classes",
        _histogram(F.col("hits"), F.col("n_words"), F.col("language")).alias("common"),
    )


def judge_quality(docs: DataFrame, text: str = "text", lang: str | None = "lang", keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept.

    A document is kept if it passes the base rules and neither histogram is too
    far from its language's.  References are the pooled counts of all documents of
    the language that pass the base rules and are long enough for the comparison.
    A language without list, null too, has the pooled reference `other` and no
    comparison of words.  Too short documents are not compared; their distance is null.

    Null texts have no words; they and empty texts fail the base rules.  Rows and
    repeats stay.  `keep` names the columns carried along (by default all);
    those called like new ones are replaced.
    """
    names = docs.columns if keep is None else keep
    counts = measured(docs, text, lang, names)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = saved(counts.withColumn("base_failed", failed), "quality")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)

    def pooled(column: str, size: int, enough: Column) -> list[Column]:
        fit = ~F.col("base_failed") & enough
        return [F.sum(F.when(fit, F.get(column, F.lit(i))).otherwise(0).cast("double")) for i in range(size)]

    n_common = len(next(iter(COMMON.values()))) + 1
    references = counts.groupBy("language").agg(
        F.array(*pooled("classes", len(CLASSES), chars >= LEAST_CHARS)).alias("ref_classes"),
        F.array(*pooled("common", n_common, F.col("n_words") >= LEAST_COMMON_WORDS)).alias("ref_common"),
    )
    joined = counts.join(F.broadcast(references), "language")  # a row for each list of common words and one more
    class_distance = F.when(chars >= LEAST_CHARS, js_distance(F.col("classes"), F.col("ref_classes")))
    word_distance = F.when(F.col("n_words") >= LEAST_COMMON_WORDS, js_distance(F.col("common"), F.col("ref_common")))
    done = joined.withColumns({"class_distance": class_distance, "word_distance": word_distance})
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance")
    return unpacked(done, "row", names, **{f: F.col(f) for f in fields}, kept=~F.col("base_failed") & near)
