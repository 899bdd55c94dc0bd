"""Near-duplicates by SimHash, found through deletion variants of segments.

Two fingerprints that differ in at most `d` bits, cut in ceil((d + 1) / 2)
segments, agree in some segment up to one bit.  So every fingerprint is indexed
under each segment with each single bit of it left out, equal keys are joined
and the whole distance is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, saved
from veilframe.llm.components import components

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
#: Keys with more fingerprints than this are linked through shared neighbours.
FULL_BUCKET = 64
#: Bytes of text that are cut in words at a time.
BLOCK = 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        gap = _GAP.search(data, min(start + BLOCK, len(data)))
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end + 1


def _shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles in blocks, so that long texts take bounded memory."""
    carry: list[bytes] = []
    whole = True
    for block in _word_blocks(data):
        words = carry + block
        n = len(words) - size + 1
        if n > 0:
            whole = False
            shingles = zip(*(islice(words, i, None) for i in range(size)))
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
            carry = words[n:]
        else:
            carry = words
    if whole and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def simhash(text: str, size: int = SHINGLE) -> int:
    """64-bit fingerprint as a signed number; zero for a text without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text.encode().lower(), size):
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """SimHash of a text column as a long; null counts as empty."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(t.as_py(), size) for t in texts), pa.int64())

    return run(F.coalesce(text, F.lit("")))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max_distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _variants(max_distance: int) -> Column:
    """(key, slot) of every segment with one bit left out; the slot is that bit."""
    fp = F.col("fp")
    found = []
    for start, bits in _segments(max_distance):
        mask = ((1 << bits) - 1) << start
        for bit in range(start, start + bits):
            kept = mask & ~(1 << bit)
            kept = kept - (1 << 64) if kept >= 1 << 63 else kept
            found.append(F.xxhash64(F.lit(bit), fp.bitwiseAND(F.lit(kept))))
    return F.posexplode(F.array(*found)).alias("slot", "key")


def _first_shared_slot(max_distance: int) -> Column:
    """The first slot that two fingerprints share, from the bits they differ in."""
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    slot = F.lit(None).cast("int")
    for start, bits in reversed(_segments(max_distance)):
        mask = ((1 << bits) - 1) << start
        part = diff.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
        lowest = F.length(F.bin(part)) - 1  # the number of the highest set bit
        slot = F.when(part == 0, start).when(F.bit_count(part) == 1, lowest.cast("int")).otherwise(slot)
    return slot


def _ball() -> Column:
    """The fingerprint and all that differ from it in one bit."""
    flips = [0, *(1 << b for b in range(63)), -(1 << 63)]
    return F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("near")


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """Links that join all fingerprints at most `max_distance` bits apart.

    `prints` has one row per distinct fingerprint, in `fp`.  Keys shared by up
    to `full_bucket` fingerprints give their pairs, each pair once and
    checked.  A key shared by more would give a square of them; those
    fingerprints are instead joined through values one bit away from each.
    Two fingerprints have such a value in common exactly if they differ in two
    bits or fewer, so every link of the key is kept, with 65 rows per fingerprint.
    At a distance of one, the values are the fingerprints with a bit left out.
    """
    if max_distance not in (1, 2):
        raise ValueError("the distance must be 1 or 2 bits")
    keyed = prints.select("fp", _variants(max_distance))
    shared = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    # shared keys grow with the table, so they are not broadcast at any size
    busy = saved(keyed.join(shared.hint("merge"), "key"), "variants")
    some = busy.filter(F.col("n") <= full_bucket).select("key", "slot", "fp")
    pairs = some.join(some.select("key", F.col("fp").alias("other")), "key").filter(
        (F.col("fp") < F.col("other"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_distance)
        & (F.col("slot") == _first_shared_slot(max_distance))
    )
    many = busy.filter(F.col("n") > full_bucket).select("fp").distinct()
    if max_distance == 2:
        near = many.select("fp", _ball())
    else:
        masks = [~(1 << b) for b in range(63)] + [(1 << 63) - 1]
        near = many.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("near"))
    first = near.groupBy("near").agg(F.min("fp").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    hubs = near.join(first, "near").filter("fp > other").select("fp", "other").distinct()
    return pairs.select("fp", "other").union(hubs)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
    full_bucket: int = FULL_BUCKET,
) -> DataFrame:
    """One row per row of `docs`: its id, `fingerprint` and `component_id`.

    The component is the smallest id that links of at most `max_distance`
    differing bits reach.  Only distinct fingerprints are compared, so any
    number of copies costs one row.

    Null and empty texts, and texts of white space, have fingerprint zero and
    are linked like any other.  A text of fewer words than a shingle is one
    shingle.  Repeated rows stay repeated.  A null id is never a component's id
    unless all its ids are null.  Other columns are not returned; an empty
    table gives an empty table.
    """
    prints = saved(docs.select(col(doc_id).alias("id"), fingerprint(col(text), shingle).alias("fp")), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    linked = components(links(classes.select("fp"), max_distance, full_bucket), "fp", "other")
    labelled = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    smallest = saved(labelled.groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    reached = labelled.join(smallest, "label").select(F.col("fp").alias("print"), "component_id")
    return prints.join(reached, F.col("fp") == F.col("print")).select(
        F.col("id").alias(doc_id), hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )
