"""Text files of any size as chunks, without a row that holds a whole file.

Spark reads a file in splits, line by line.  Each line knows the split it begins in;
lengths in code points are summed within a split, and over the splits of a file, which
gives each line its place in the whole text.  A line is cut where chunks end, and the
parts of a chunk come together.  Only a single line has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.catalog import CHUNK_SIZE, OVERLAP
from veilframe.functions.text import pieces
from veilframe.operators.steps import compute_once, spread

FILE = ["path", "block"]


def _lines(spark: SparkSession, path: str, glob: str | None, parts: bool = False) -> DataFrame:
    """Lines as bytes that form text, with their text, file, split and order in it."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    file = F.col("_metadata.file_path")
    return reader.text(path).select(
        file.alias("path"),
        (F.regexp_replace(file, "/[^/]*$", "") if parts else file).alias("whole"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.octet_length("value").alias("bytes"),
        F.make_valid_utf8("value").alias("text"),
    )


def _clean(text: Column, ended: Column) -> Column:
    """A line with its line feed, if it has one, and line ends as LF."""
    whole = F.when(ended, F.concat(text, F.lit("\n"))).otherwise(text)
    return F.regexp_replace(whole, F.lit("\r\n?"), F.lit("\n"))


def read_lines(spark: SparkSession, path: str, glob: str | None = None, parts: bool = False) -> DataFrame:
    """Lines of text files: path, file_size, total (code points of the file), start (the line's first one), text.

    Bad UTF-8 is replaced and line ends become LF, as `read_text_documents` does.  Put
    together in the order of `start`, the lines of a file are its text.

    With `parts`, the files of a folder are the parts of one text, in the order of their
    names, as Spark writes a sorted table; `path` is the folder and `file_size` the sum.
    Each part is decoded on its own, so one has to end with a line.

    Lines move once, to their split: what is to be known of a file is found from one row
    per split, so the tasks do not grow with the files.
    """
    raw = _lines(spark, path, glob, parts)
    # whether the last line is ended, and whether Spark left a byte order mark out, follows from the size
    per_split = raw.groupBy(*FILE, "whole").agg(
        F.max("file_size").alias("file_size"), F.max("line").alias("split_last"), F.min("line").alias("split_first"), F.sum(F.col("bytes") + 1).alias("counted")
    )
    file = Window.partitionBy("path")
    over = F.col("file_size") - F.sum("counted").over(file)
    known = per_split.select(
        *FILE, F.when(F.col("block") == F.max("block").over(file), F.col("split_last")).alias("last_line"),
        F.when(F.col("block") == F.min("block").over(file), F.col("split_first")).alias("first_line"), over.alias("over"),
    ).select(
        *FILE, "last_line", "first_line", F.col("over").isin(0, 3).alias("ended"), (F.col("over") >= 2).alias("marked"),
        F.when(~F.col("over").isin(-1, 0, 2, 3), F.raise_error(F.concat(F.lit("not a plain file: "), "path"))).alias("problem"),
    )
    lines = raw.join(known, FILE).filter(F.col("problem").isNull())
    is_ended = F.col("last_line").isNull() | (F.col("line") != F.col("last_line")) | F.col("ended")
    mark = F.when((F.col("line") == F.col("first_line")) & F.col("marked"), F.lit("﻿")).otherwise(F.lit(""))
    texts = lines.select("whole", *FILE, "file_size", "line", F.concat(mark, _clean(F.col("text"), is_ended)).alias("text"))
    texts = texts.withColumn("n", F.length("text").cast("long"))
    sizes = texts.groupBy("whole", *FILE).agg(F.max("file_size").alias("size"), F.sum("n").alias("split_n"))
    whole = Window.partitionBy("whole")
    before = whole.orderBy(*FILE).rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.select(
        *FILE, F.coalesce(F.sum("split_n").over(before), F.lit(0)).alias("split_start"), F.sum("split_n").over(whole).alias("total"),
        F.sum(F.when(F.col("block") == 0, F.col("size"))).over(whole).alias("whole_size"),
    )
    within = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.join(splits, FILE).withColumn("start", F.col("split_start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.select(F.col("whole").alias("path"), F.col("whole_size").alias("file_size"), "total", "start", "text")


def read_chunks(
    spark: SparkSession, path: str, glob: str | None = None, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP, parts: bool = False
) -> DataFrame:
    """One row per chunk of text files of any size: path, file_size, chunk_idx, total_chunks, text.

    The chunks are those of `chunk_documents` on `read_text_documents`.  With `parts`, the
    files of a folder are one text, see `read_lines`.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    keep = max(0, min(overlap, chunk_size))
    lines = read_lines(spark, path, glob, parts).withColumn("room", (chunk_size - F.col("start") % chunk_size).cast("int"))
    # the part in the line's first chunk, then parts of whole chunks
    rest = F.expr("substring(text, room + 1)")
    parts = F.when(F.length("text") <= F.col("room"), F.array("text")).otherwise(F.concat(F.array(F.left("text", F.col("room"))), pieces(rest, chunk_size)))
    cut = spread(compute_once(lines, "parts", parts), "parts", ["path", "file_size", "total", "start"], "i", "part")
    first = (F.col("start") / chunk_size).cast("long") if chunk_size == 1 else F.floor(F.col("start") / chunk_size)
    own = cut.select(
        "path", "file_size", F.ceil(F.col("total") / chunk_size).cast("int").alias("total_chunks"), (first + F.col("i")).cast("int").alias("chunk_idx"),
        F.when(F.col("i") == 0, F.col("start") % chunk_size).otherwise(0).cast("int").alias("at"), "part",
    )
    if keep:
        # the end of a chunk's range stands in front of the next chunk, too
        skipped = F.greatest(F.lit(chunk_size - keep) - F.col("at"), F.lit(0))
        tail = F.struct((F.col("chunk_idx") + 1).alias("chunk_idx"), (F.col("at") + skipped - chunk_size).alias("at"), F.substring("part", skipped + 1, F.length("part")).alias("part"))
        both = F.array(F.struct("chunk_idx", "at", "part"), F.when((F.length("part") > skipped) & (F.col("chunk_idx") + 1 < F.col("total_chunks")), tail))
        own = own.select("path", "file_size", "total_chunks", F.inline(F.filter(both, lambda p: p.isNotNull())))
    together = own.groupBy("path", "file_size", "chunk_idx", "total_chunks").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return together.select("path", "file_size", "chunk_idx", "total_chunks", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))
