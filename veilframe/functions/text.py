"""Column functions on text: newlines, fixed-size pieces, natural breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.catalog import BREAK_CHARS


def universal_newlines(text: Column) -> Column:
    """CRLF and CR become LF, as reading in text mode does."""
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def decode_utf8(content: Column) -> Column:
    """Bytes to text; bad bytes become U+FFFD."""
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def pieces(text: Column, size: int) -> Column:
    """Cut text in pieces of `size` code points, in one pass over the text.

    Repeated ``substring`` calls would walk from the start of the text each
    time.  The possessive quantifier keeps the regex engine iterative.
    An empty text is one empty piece.
    """
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut)


def with_overlap(parts: Column, size: int, overlap: int) -> Column:
    """Put the last `overlap` characters of the piece before in front of each piece.

    `parts` must be a plain column, since it is used twice.
    """
    keep = min(overlap, size)
    if keep <= 0:
        return parts
    return F.transform(
        parts,
        lambda part, i: F.when(i == 0, part).otherwise(
            F.concat(F.right(F.element_at(parts, i), F.lit(keep)), part)
        ),
    )


def _break_after(head: Column) -> Column:
    """Characters up to and with the first break in `head`; 0 if there is none."""
    return F.length(F.regexp_extract(head, f"^[^{BREAK_CHARS}]*[{BREAK_CHARS}]", 0))


def _break_before(tail: Column) -> Column:
    """Characters up to and with the last break in `tail`; 0 if there is none."""
    return F.length(F.regexp_extract(tail, f"(?s)^.*[{BREAK_CHARS}]", 0))


def natural_break(text: Column, position: Column, window: int = 100) -> Column:
    """The first break within `window` after the position, else the last one
    within `window` before it, else the position itself."""
    position = position.cast("int")
    start = F.greatest(F.lit(0), position - window)
    ahead = _break_after(F.substring(text, position + 1, F.lit(window)))
    behind = _break_before(F.substring(text, start + 1, position - start))
    return F.when(ahead > 0, position + ahead).when(behind > 0, start + behind).otherwise(position)


def break_shift(before: Column, after: Column, window: int) -> Column:
    """How far the cut between two neighbouring pieces moves to a natural break."""
    tail = F.right(before, F.lit(window))
    ahead = _break_after(F.left(after, F.lit(window)))
    behind = _break_before(tail)
    return F.when(ahead > 0, ahead).when(behind > 0, behind - F.length(tail)).otherwise(F.lit(0))
