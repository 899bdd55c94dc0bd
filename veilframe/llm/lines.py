"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import col, row_key, saved, unpacked, whole_row
from veilframe.operators.steps import compute_once

WINDOW = 3
#: White space that does not count at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def windows(docs: DataFrame, doc_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """One row per run of `size` lines that are not blank, with its place and hash.

    Columns: `key` of the row it is in, `id`, `start` and `stop` (numbers of its
    first and last line), `hash` (128 bits).
    """
    line_hashes = F.transform(
        F.split(F.coalesce(col(text), F.lit("")), "\n", -1),
        lambda line, i: F.struct(i.alias("at"), row_key(F.btrim(line, F.lit(BLANK))).alias("h"), (F.btrim(line, F.lit(BLANK)) == "").alias("blank")),
    )
    full = F.transform(F.filter(line_hashes, lambda x: ~x["blank"]), lambda x: F.struct(x["at"], x["h"]))
    rows = compute_once(docs.select(row_key(col(doc_id), col(text)).alias("key"), col(doc_id).alias("id"), full.alias("full")), "full", F.col("full"))
    starts = F.when(F.size("full") >= size, F.sequence(F.lit(0), F.size("full") - size))

    def one(i: Column) -> Column:
        lines = [F.get("full", i + k) for k in range(size)]
        return F.struct(lines[0]["at"].alias("start"), lines[-1]["at"].alias("stop"), row_key(*[x["h"]["a"] for x in lines], *[x["h"]["b"] for x in lines]).alias("hash"))

    return rows.select("key", "id", F.explode(F.transform(starts, one)).alias("w")).select("key", "id", "w.*")


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines that the spans cover, and their number."""
    lines = text.split("\n")
    gone = bytearray(len(lines))
    for start, stop in spans:
        gone[start : stop + 1] = b"\1" * (stop + 1 - start)
    return "\n".join(line for line, g in zip(lines, gone) if not g), sum(gone)


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("removed", T.LongType()))
def _without(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    cut, removed = [], []
    for text, start, stop in zip(texts, starts, stops):
        rest = (None, 0) if text.as_py() is None else _cut(text.as_py(), list(zip(start.as_py(), stop.as_py())))
        cut.append(rest[0])
        removed.append(rest[1])
    return pa.StructArray.from_arrays([pa.array(cut, pa.string()), pa.array(removed, pa.int64())], ["text", "removed"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`docs` with rewritten texts, and `n_removed`, the number of lines taken out.

    Lines are compared without white space at their ends; blank lines take no
    part in windows.  Of the windows with equal lines, anywhere in the table, the
    first by (id, text hash, line number) stays, and every line from the first to the
    last line of any other is taken out, blank ones between them too.  The first
    place of a line is in no later window, so no line is lost altogether.

    A text of fewer than `size` lines that are not blank stays as it is, and so do
    null and empty texts.  A text that is all copied becomes empty; its row stays.
    Repeated rows count as one place and are treated alike; null ids come first.
    Other columns stay; one called `n_removed` is replaced.
    """
    found = saved(windows(docs, doc_id, text, size), "windows")
    place = F.struct("id", "key", "start")
    ends = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # a table of its own, so that adaptive execution can split a hot hash in the join
    first = saved(ends.filter(~F.col("first").eqNullSafe(F.col("last"))).select("hash", "first"), "first-places")
    # both sides of each join grow with the table, so neither is broadcast at any size
    later = found.join(first.hint("merge"), "hash").filter(~place.eqNullSafe(F.col("first")))
    covered = saved(later.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "covered")
    rows = docs.select(row_key(col(doc_id), col(text)).alias("key"), whole_row(docs).alias("row"))
    joined = rows.join(covered.hint("merge"), "key", "left")
    old = F.col("row").getField(text)
    cut = _without(F.when(F.col("spans").isNotNull(), old), F.col("spans.start"), F.col("spans.stop"))
    done = joined.select("row", "spans", cut.alias("cut"))
    return unpacked(
        done, "row", docs.columns,
        **{text: F.when(F.col("spans").isNotNull(), F.col("cut.text")).otherwise(old), "n_removed": F.coalesce("cut.removed", F.lit(0))},
    )


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from documents),
filled as (
  select doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as l
  from lines where trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
windows as (
  select doc_id, pos as start, lead(pos, 2) over w as stop, l as l1, lead(l, 1) over w as l2, lead(l, 2) over w as l3
  from filled window w as (partition by doc_id order by pos)),
places as (
  select *, row_number() over (partition by l1, l2, l3 order by doc_id, start) as place
  from windows where stop is not null),
gone as (
  select distinct l.doc_id, l.pos from places p
  join lines l on l.doc_id = p.doc_id and l.pos between p.start and p.stop where p.place > 1),
rest as (
  select l.doc_id, count(g.pos) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
  from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
select doc_id, text, n_removed from rest
"""
