"""Cutting documents in chunks and putting them together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.catalog import CHUNK_SIZE, OVERLAP
from veilframe.functions.text import break_shift, pieces, with_overlap
from veilframe.operators.steps import compute_once, spread


def with_chunks(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Add `chunks`, the array of a document's overlapping chunks, to its row."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    cut = compute_once(docs, "_pieces", pieces(F.col("text"), chunk_size))
    return compute_once(cut, "chunks", with_overlap(F.col("_pieces"), chunk_size, overlap)).drop("_pieces")


def _one_row_per_chunk(docs: DataFrame) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("text", "chunks")]
    counted = docs.withColumn("total_chunks", F.size("chunks"))
    return spread(counted, "chunks", [*kept, "total_chunks"], "chunk_idx", "text")


def chunk_documents(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk.

    Chunk i is the i-th piece of `chunk_size` characters with the last `overlap`
    characters of the piece before in front.  A narrow operation; repartition
    the result where a few long documents hold most of the text.
    """
    return _one_row_per_chunk(with_chunks(docs, chunk_size, overlap))


def single_chunk(docs: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Add `is_single`: fewer bytes than `chunk_size` make one chunk."""
    return docs.withColumn("is_single", F.octet_length("text") < chunk_size)


def chunk_at_breaks(docs: DataFrame, chunk_size: int = CHUNK_SIZE, window: int = 100) -> DataFrame:
    """One row per chunk, cut near every `chunk_size` characters at a natural
    break; the chunks together are the text.

    Works on neighbouring pieces, so the text is walked once.
    """
    if 2 * window > chunk_size:
        raise ValueError("window may be at most half of chunk_size")
    cut = compute_once(docs, "_p", pieces(F.col("text"), chunk_size))
    p = F.col("_p")
    shifted = compute_once(
        cut,
        "_d",
        F.transform(
            p,
            lambda part, i: F.when(i == 0, F.lit(0)).otherwise(break_shift(F.element_at(p, i), part, window)),
        ),
    )
    d = F.col("_d")

    def rejoin(part, i):
        here = F.element_at(d, i + 1)
        following = F.coalesce(F.get(d, i + 1), F.lit(0))
        lead = F.when(here < 0, F.right(F.element_at(p, i), -here)).otherwise(F.lit(""))
        first = F.greatest(here, F.lit(0))
        body = F.substring(part, first + 1, F.length(part) - first + F.least(following, F.lit(0)))
        trail = F.when(following > 0, F.left(F.get(p, i + 1), following)).otherwise(F.lit(""))
        return F.concat(lead, body, trail)

    whole = F.transform(p, rejoin)
    chunks = F.when(F.size(p) > 1, F.filter(whole, lambda c: c != "")).otherwise(p)
    return _one_row_per_chunk(compute_once(shifted, "chunks", chunks).drop("_p", "_d"))


def reassemble_chunks(
    chunks: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP, key: str = "doc_id"
) -> DataFrame:
    """One text per document from its chunks, overlaps dropped.

    The chunks of one document make one row again, as they did before.
    """
    keep = max(0, min(overlap, chunk_size))
    own = F.when(F.col("chunk_idx") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {keep + 1})"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", own.alias("own"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["own"]), "").alias("text"))
