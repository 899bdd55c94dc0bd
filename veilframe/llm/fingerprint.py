"""Fingerprints of documents as sums of vectors hashed from their paragraphs.

A paragraph (a line of the text) has a vector: eight hashes of 32 bits, the
number of its groups of four words, and for each bit of a 64-bit hash the
number of groups that have it.  A document's fingerprint is the sum of its
paragraphs' vectors, so it does not depend on their order, and paragraphs can be
added and taken away later.  The first part tells equal from different; the
second, read as signed sums, gives the cosine between two documents' groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import SPACE, col, unpacked, whole_row
from veilframe.operators.steps import compute_once

SEEDS = (11, 12, 13, 14)
EXACT = 2 * len(SEEDS)
LANES = 64
LOW = (1 << 32) - 1
#: Two counters of 32 bits in a long.
PAIR = 1 | 1 << 32
WORDS = 4
_GROUP = rf"[^{SPACE}]++(?:[\x20\t\x0B\f\r]++[^{SPACE}]++){{0,{WORDS - 1}}}+"

#: Rows that lie in order in one task, and the most such stretches.
ROWS_PER_STRETCH, MAX_STRETCHES = 500, 4096


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x))


def hashes(text: Column) -> Column:
    """Hashes of a text's paragraphs and groups, for `vector`; keep it in a column."""
    filled = F.coalesce(text, F.lit(""))
    paragraphs = F.when(filled == "", F.array().cast("array<string>")).otherwise(F.split(filled, "\n", -1))
    return F.struct(
        F.transform(paragraphs, lambda p: F.struct(*[F.xxhash64(F.lit(s), p).alias(f"h{s}") for s in SEEDS])).alias("paragraphs"),
        F.transform(F.regexp_extract_all(filled, F.lit(_GROUP), F.lit(0)), lambda g: F.xxhash64(F.lit(0), g)).alias("groups"),
    )


def vector(hashed: Column) -> Column:
    """The fingerprint as an array of longs, from a column made by `hashes`."""
    def modular(name: str, shift: int) -> Column:
        return F.aggregate(
            hashed["paragraphs"][name], F.lit(0).cast("long"),
            lambda a, x: (a + F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW)),
        )

    exact = [modular(f"h{s}", shift) for s in SEEDS for shift in (0, 32)]
    groups = hashed["groups"]
    counts = [_sum(groups, lambda x, i=i: F.shiftrightunsigned(x, i).bitwiseAND(F.lit(PAIR))) for i in range(LANES // 2)]
    return F.array(*exact, F.size(groups).cast("long"), *counts)


def insert(vector_a: Column, vector_b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.zip_with(F.transform(vector_a, _numbered), vector_b, lambda a, b: _wrapped(a, a["v"] + b))


def delete(vector_a: Column, vector_b: Column) -> Column:
    """The fingerprint of the first without the paragraphs of the second, all of which it must have."""
    return F.zip_with(F.transform(vector_a, _numbered), vector_b, lambda a, b: _wrapped(a, a["v"] - b))


def _numbered(v: Column, i: Column) -> Column:
    return F.struct(v.alias("v"), i.alias("i"))


def _wrapped(a: Column, value: Column) -> Column:
    return F.when(a["i"] < EXACT, value.bitwiseAND(F.lit(LOW))).otherwise(value)


def digits(v: Column) -> Column:
    """A fingerprint as hexadecimal text: eight digits for each hash, sixteen for the rest."""
    def put(width: int):
        return lambda x: F.lpad(F.lower(F.hex(x)), width, "0")

    return F.concat(
        F.array_join(F.transform(F.slice(v, 1, EXACT), put(8)), ""),
        F.array_join(F.transform(F.slice(v, EXACT + 1, 1 + LANES // 2), put(16)), ""),
    )


def signed(v: Column) -> Column:
    """The lanes as sums of +1 and -1; keep it in a column."""
    n = F.get(v, F.lit(EXACT)).cast("double")
    packed = F.slice(v, EXACT + 2, LANES // 2)
    both = F.transform(packed, lambda x: F.array(x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)))
    return F.transform(F.flatten(both), lambda c: 2.0 * c - n)


def likeness(a: Column, b: Column) -> Column:
    """Cosine between two fingerprints from their signed lanes, 0 to 1.

    Equal fingerprints give exactly 1; one without words against one with, 0.
    """
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    cosine = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `vector` and `fingerprint`, its hexadecimal text.

    Null and empty texts have no paragraphs and the zero vector.  Rows, repeats
    and other columns stay; columns called like the new ones are replaced.
    """
    rows = compute_once(docs.select(whole_row(docs).alias("row"), col(text).alias("t")), "hashed", hashes(F.col("t"))).drop("t")
    done = compute_once(rows, "vector", vector(F.col("hashed")))
    return unpacked(done, "row", docs.columns, vector=F.col("vector"), fingerprint=digits(F.col("vector")))


def _stretch(value: Column, edges: list[int]) -> Column:
    """How many of the ascending edges are below a value, by bisection."""
    if not edges:
        return F.lit(0)
    known = F.array(*[F.lit(e).cast("long") for e in edges])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(edges)) & (F.get(known, at + by - 1) < value), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, doc_id: str, *columns: str, ids: DataFrame | None = None) -> DataFrame:
    """`docs` with the columns of the next row in descending order of a whole-number id.

    They are in the struct `next`; after the last row comes the first.  Ties
    are in the order of the columns; null ids come last.  The ids are cut in
    stretches of similar size at quantiles, at most MAX_STRETCHES; each stretch is a
    group of one window, so every row is moved once, and the first row of each
    stretch is copied to the end of the one before.

    `ids` may be a table of the same ids that is cheaper to read than `docs`.
    """
    ident = col(doc_id)
    ids = (docs if ids is None else ids).select(ident.alias("id"))
    n = ids.count()
    parts = max(1, min(MAX_STRETCHES, n // ROWS_PER_STRETCH))
    edges: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = ids.agg(F.percentile_approx("id", shares, 10 * MAX_STRETCHES).alias("q")).first().q
        edges = sorted(set(found or []))
    stretch = F.when(F.col("id").isNull(), -1).otherwise(_stretch(F.col("id"), edges))
    placed = compute_once(docs.select(whole_row(docs).alias("row"), ident.alias("id")), "stretch", stretch.cast("int"))
    heads = compute_once(ids, "stretch", stretch.cast("int")).groupBy("stretch").agg(F.max("id").alias("id")).orderBy(F.desc("stretch")).collect()
    before = [(r.stretch, r.id, heads[i - 1].stretch) for i, r in enumerate(heads)]  # the first row of each follows the last of the one before
    small = docs.sparkSession.createDataFrame(before, "stretch int, head long, before int")
    own = F.struct(F.col("stretch").alias("at"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("before").alias("at"), F.lit(True).alias("tail"))
    joined = placed.join(F.broadcast(small), "stretch")  # at most MAX_STRETCHES + 1 rows
    dealt = joined.select("row", "id", F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))).alias("p"))
    ties = [F.col("row").getField(c) for c in columns]
    order = Window.partitionBy("p.at").orderBy(F.col("p.tail"), F.col("id").desc_nulls_last(), *ties)
    follows = F.lead(F.struct(*[F.col("row").getField(c).alias(c) for c in columns])).over(order)
    done = dealt.select("row", "p", follows.alias("next")).filter(~F.col("p.tail"))
    return unpacked(done, "row", docs.columns, next=F.col("next"))
