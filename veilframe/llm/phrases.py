"""Phrases of words that stand together more often than their parts would have it.

Counting goes by stripes: a prefix of none, one or two words keys a counter of the
words that come next, with one entry for all that comes next, ends and words that
can't be part of a candidate included.  Stripes are merged elementwise.  The merged table gives all
that scoring needs: an entry is the count of prefix and word together, a stripe's
total is that of its prefix, and its largest entry tells whether the prefix is
subsumed by a longer phrase.

Three passes, one for each length of a prefix.  A phrase is frequent only if all its
parts are.  So a pass leaves out what the one before found rare, by a bitmap of
fixed size over hashes of the frequent phrases.  Bits that phrases share let rare ones
through, never the other way; exact counts decide at the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import col, saved

#: Bits of the bitmap; eight of them make a byte of what is broadcast.
BITS = 1 << 26
#: Bytes of text whose stripes are counted together in a task.
COUNTED_BYTES = 8 << 20
LONGEST = 3
#: Slices of a language's phrases when they are ranked, and of a common prefix's stripe.
RANK_SLICES, SLICES = 16, 64
UNKNOWN = "und"
#: Stands where a piece ends.
REST = b"\n"
#: A-Z in lower case, tabs as blanks, what parts pieces as line feeds.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 0x20 if b == 9 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)
)
#: A slice of a stripe: next words and their counts, both put together with blanks, and the stripe's total in one of its slices.
STRIPES = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("slice", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("nexts", T.StringType()), T.StructField("counts", T.StringType()),
])
#: Stripes of prefixes that make so large a part of all words are cut in slices.
HOT_SHARE = 5000
_ENTRIES = "array<struct<next:string,f:bigint>>"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64 bits for a phrase from those of its first words and its last word."""
    with np.errstate(over="ignore"):
        x = (left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + right
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _place(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(BITS - 1)


def _hash(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Frequent:
    """The frequent phrases of one length, as far as a bitmap tells."""

    def __init__(self, buckets: dict[int, bytes]):
        self.bits = np.zeros(BITS // 8, np.uint8)
        for bucket, part in buckets.items():
            start = bucket * len(part)
            self.bits[start : start + len(part)] = np.frombuffer(part, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(hashes)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent(phrases: DataFrame, length: int) -> Frequent:
    """The bitmap over phrases of a length, from rows of lang, prefix and next.

    Every executor makes bits of its rows; what reaches the driver is at most the bitmap.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            by_lang = defaultdict(list)
            for lang, prefix, word in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by_lang[lang].append([*prefix.encode().split(b" "), word.encode()] if prefix else [word.encode()])
            for lang, rows in by_lang.items():
                columns = [_hash([r[i] for r in rows], lang) for i in range(length)]
                found.append(_place(reduce(_mixed, columns)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["at"])

    at = phrases.select("lang", "prefix", "next").mapInArrow(places, "at long")
    # Spark counts a bitmap's places from 1 and puts 32,768 in each
    buckets = at.select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    rows = buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    return Frequent({r.bucket - 1: bytes(r.bits) for r in rows})


def _words(text: bytes) -> pa.Array:
    """The words of a text and the ends of its pieces, in order."""
    parts = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), pattern=b" ").values
    return parts.filter(pc.greater(pc.binary_length(parts), 0))


def _stripes(lang: str, text: bytes, length: int, known: list[Frequent], hot: Frequent | None) -> pa.RecordBatch | None:
    """Stripes of prefixes of `length` words in one text of pieces.

    The total is of all that comes next, what can't matter included.  The longest
    prefixes need none: it is the entry of their last word.
    """
    words = _words(text).dictionary_encode()
    codes, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    n = len(codes) - length
    if n <= 0:
        return None
    hashes = _hash(names, lang)
    good = np.array([w != REST for w in names])
    if length:
        good &= known[0].has(hashes)
    # a place counts if what stands there before the next word is frequent, its next word if it can be part of a candidate
    kept = np.ones(n, bool)
    for i in range(length):
        kept &= good[codes[i : i + n]]
    fits = good[codes[length:]]
    if length > 1:
        pairs = known[1].has(_mixed(hashes[codes[:-1]], hashes[codes[1:]]))
        kept &= pairs[:n]
        fits &= pairs[1 : n + 1]
    if length == LONGEST - 1 or not length:
        kept &= fits
    at = np.flatnonzero(kept)
    if not len(at):
        return None
    size = len(names)
    prefix = np.zeros(len(at), np.int64)
    for i in range(length):
        prefix = prefix * size + codes[at + i]
    groups, prefix = np.unique(prefix, return_inverse=True)
    of_group = [groups // size ** (length - 1 - i) % size for i in range(length)]
    # each entry goes by its prefix, and by its next word too where the prefix is common
    common = hot.has(reduce(_mixed, [hashes[c] for c in of_group])) if length else np.ones(1, bool)
    place = prefix * SLICES + np.where(common[prefix], (hashes[codes[at + length]] >> np.uint64(40)).astype(np.int64) % SLICES, 0)
    keys, counts = np.unique((place * size + codes[at + length])[fits[at]], return_counts=True)
    entry_place, nxt = keys // size, keys % size
    places = np.unique(entry_place)
    total = np.zeros(len(places), np.int64)
    if length < LONGEST - 1:
        places = np.union1d(places, np.arange(len(groups)) * SLICES)
        total = np.where(places % SLICES == 0, np.bincount(prefix)[places // SLICES], 0)
    offsets = pa.array(np.searchsorted(entry_place, np.append(places, len(groups) * SLICES)).astype(np.int32))
    texts = words.dictionary.cast(pa.large_string()).cast(pa.string())

    def put_together(items: pa.Array) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(offsets, items), " ")

    group = places // SLICES
    parts = [texts.take(pa.array(c[group])) for c in of_group]
    prefixes = pc.binary_join_element_wise(*parts, " ") if parts else pa.array([""] * len(group))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(group)), prefixes, pa.array(places % SLICES), pa.array(total), put_together(texts.take(pa.array(nxt))), put_together(pa.array(counts).cast(pa.string()))],
        STRIPES.fieldNames(),
    )


def _shares(text: bytes) -> Iterator[bytes]:
    """A long text in shares of some megabytes, cut where pieces end."""
    start = 0
    while start < len(text):
        stop = text.find(b"\n", start + COUNTED_BYTES)
        stop = len(text) if stop < 0 else stop + 1
        yield text[start:stop]
        start = stop


def stripes(texts: DataFrame, length: int, known: list, hot=None) -> DataFrame:
    """Stripes of prefixes of `length` words, from rows of lang and text: one row per prefix, slice and share of text.

    `known` are broadcast variables of `Frequent` for shorter phrases, `hot` of that of the common prefixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, common = [k.value for k in known], hot and hot.value
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                for share in _shares(b"".join(parts)):
                    made = _stripes(lang, share, length, bitmaps, common)
                    if made is not None:
                        yield made
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                plain = text.as_py().encode().translate(TABLE) + b"\n"
                held[lang.as_py()].append(plain)
                size += len(plain)
                if size >= COUNTED_BYTES:
                    yield from counted()
                    size = 0
        yield from counted()

    return texts.mapInArrow(count, STRIPES)


def merged(found: DataFrame) -> DataFrame:
    """Stripes merged elementwise: rows of lang, prefix, next (null for the total) and f.

    Stripes travel whole, a word and a count for each entry, by their prefix and slice;
    the stripe of a common prefix is spread, so that one as common as any fills no task.
    """
    listed = F.arrays_zip(F.split("nexts", " ").alias("next"), F.transform(F.split("counts", " "), lambda f: f.cast("long")).alias("f"))
    entries = F.when(F.col("nexts") != "", listed).otherwise(F.array().cast(_ENTRIES))
    total = F.when(F.col("total") > 0, F.array(F.struct(F.lit(None).cast("string").alias("next"), F.col("total").alias("f")))).otherwise(F.array().cast(_ENTRIES))
    dealt = found.repartition("lang", "prefix", "slice")
    each = dealt.select("lang", "prefix", "slice", F.inline(F.concat(entries, total)))
    return each.groupBy("lang", "prefix", "slice", "next").agg(F.sum("f").alias("f")).drop("slice")


def collocations(docs: DataFrame, lowest: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut at `[.,;:!?]` and line ends, and into words at
    blanks and tabs.  a is how often the phrase comes, n how many words the language
    has.  Of the ways to cut a phrase in two that with the lowest
    floor(1000000 a a / (l r)) counts, the first of equals.  Phrases that come fewer
    than `lowest` times are none; one inside a longer phrase that comes at least
    `share` percent as often is dropped.  Ties in rank go by a, then by phrase.

    Null texts are empty, null languages `und`.  Empty tables and texts give no rows,
    repeated rows count each; texts of any length are counted whole; other columns
    are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col("text"), F.lit("")).alias("text"))
    known, hot, tables = [], None, []
    for length in range(LONGEST):
        entries = merged(stripes(texts, length, known, hot))
        kept = entries.filter((F.col("f") >= lowest) | (F.col("prefix") == "") & F.col("next").isNull())
        tables.append(saved(kept, f"stripes-{length}"))
        if length < LONGEST - 1:
            words = tables[-1].filter(F.col("next").isNotNull())
            known.append(spark.sparkContext.broadcast(frequent(words, length + 1)))
            total = tables[0].filter(F.col("next").isNull() & (F.col("prefix") == "")).agg(F.sum("f")).first()[0] or 0
            hot = spark.sparkContext.broadcast(frequent(words.filter(F.col("f") >= total // HOT_SHARE), length + 1))
    return ranked(tables, share, top)


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)) in exact decimals; a is below 10^16."""
    a, left, right = (f"cast({c} as decimal(19,0))" for c in (a, left, right))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right})")


def ranked(tables: list[DataFrame], share: int, top: int) -> DataFrame:
    """Phrases with their scores from the merged stripes of all lengths."""
    rows = [t.select("lang", "prefix", "next", "f", F.lit(length).alias("words")) for length, t in enumerate(tables, 1)]
    every = reduce(DataFrame.unionByName, rows)
    totals, entries = every.filter(F.col("next").isNull()), every.filter(F.col("next").isNotNull())
    whole = F.when(F.col("words") == 1, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    phrases = entries.select("lang", whole.alias("phrase"), "prefix", "f", "words")
    # what stands before a cut is the prefix of a stripe, with its total (that of two words is an entry, too);
    # what stands after it is an entry
    before = totals.filter("prefix <> ''").select("lang", F.lit(0).alias("side"), F.col("prefix").alias("part"), F.col("f").alias("part_f"))
    before = before.unionByName(phrases.filter(f"words > 1 and words < {LONGEST}").select("lang", F.lit(0).alias("side"), F.col("phrase").alias("part"), F.col("f").alias("part_f")))
    after = phrases.filter(F.col("words") < LONGEST).select("lang", F.lit(1).alias("side"), F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    words = F.split("phrase", " ")

    def sides(k: int):
        first, rest = F.slice(words, 1, k), F.slice(words, F.lit(k + 1), F.col("words") - k)
        return [F.struct(F.lit(k).alias("k"), F.lit(i).alias("side"), F.array_join(p, " ").alias("part")) for i, p in enumerate((first, rest))]

    cuts = F.filter(F.array(*[side for k in range(1, LONGEST) for side in sides(k)]), lambda s: s["k"] < F.col("words"))
    asked = phrases.filter("words > 1").select("lang", "phrase", "f", F.inline(cuts))
    found = asked.join(before.unionByName(after).hint("merge"), ["lang", "side", "part"])
    part = {(k, side): F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("part_f"))) for k in range(1, LONGEST) for side in (0, 1)}
    scored = found.groupBy("lang", "phrase").agg(F.max("f").alias("a"), *[c.alias(f"{'lr'[side]}{k}") for (k, side), c in part.items()])
    each = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, LONGEST)
    ]
    scored = scored.select("lang", "phrase", "a", F.least(*each).alias("best"))  # the lowest score, then the first cut
    # the largest entry of a phrase's own stripe, and of the longer phrases that end with it
    longer = phrases.filter(F.col("words") == LONGEST)
    ends = F.array("prefix", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    inside = longer.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = scored.join(inside.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    order = [F.desc("best.score"), F.desc("a"), F.col("phrase")]
    # the first of each slice of a language, then the first of those: the last step gets RANK_SLICES * top rows at most
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = totals.filter("prefix = ''").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


#: The same rows in SQL, phrase by phrase.
ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
occurs as (
  select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from cut, (values (1), (2), (3)) as lengths(k) where len(w) >= k),
counts as materialized (select lang, phrase, count(*) as f from occurs group by all),
total as (select lang, sum(f)::bigint as n from counts where phrase not like '% %' group by all),
candidates as materialized (
  select lang, phrase, f, string_split(phrase, ' ') as w from counts where f >= 10 and phrase like '% %'),
asked as (
  select lang, phrase, f, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:], ' ') as tail
  from candidates, (values (1), (2)) as places(j) where j < len(w)),
cuts as (
  select a.lang, a.phrase, a.f as a, a.j, l.f as l, r.f as r,
         ((1000000::hugeint * a.f * a.f) // (l.f::hugeint * r.f))::bigint as score
  from asked a join counts l on l.lang = a.lang and l.phrase = a.head
               join counts r on r.lang = a.lang and r.phrase = a.tail),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longest as (
  select lang, part as phrase, max(f) as longest from (
    select lang, f, array_to_string(w[1:2], ' ') as part from candidates where len(w) = 3
    union all select lang, f, array_to_string(w[2:3], ' ') from candidates where len(w) = 3) group by all),
kept as (
  select b.* from best b left join longest g using (lang, phrase) where g.longest is null or 100 * g.longest < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""
