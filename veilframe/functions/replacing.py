"""Replacing very many values of a text, with the result of replacing one after the other.

One automaton finds all values in one walk.  Of the places found, those of an earlier
value go first, then those further left; a place that meets one taken before is left
alone.  That is what replacing value by value does, as long as no value is found in
or across what was put in.

A value is found there only if it stands inside a token, or has the first or last
character of one: what is left of a token always ends at such a character.  Values of
that kind are replaced on their own, at their turn; all others go in one walk from one
such value to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _automaton(places: dict[str, int]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for value, place in places.items():
        found.add_word(value, (place, len(value)))
    found.make_automaton()
    return found


def _at_tokens(places: dict[str, int], tokens: Sequence[str]) -> set[str]:
    """Values that may be found in or across a token."""
    edges = {c for token in tokens for c in (token[0], token[-1])}
    near = {value for value in places if not edges.isdisjoint(value)}
    distinct, order = list(dict.fromkeys(tokens)), list(places)
    inside = _automaton({value: i for i, value in enumerate(order)})
    for token in distinct:
        near.update(order[i] for _, (i, _) in inside.iter(token))
    return near


def _walked(text: str, automaton, tokens: Sequence[str], start: int, stop: int) -> str:
    """The text with the values of the places from `start` to `stop` replaced in one walk."""
    hits = []
    for end, (place, length) in automaton.iter(text):
        if start <= place < stop:
            hits.append((place, end + 1 - length, end + 1))
    if not hits:
        return text
    hits.sort()
    taken = bytearray(len(text))
    kept = []
    for place, begin, end in hits:
        if taken.find(1, begin, end) < 0:
            taken[begin:end] = b"\1" * (end - begin)
            kept.append((begin, end, place))
    kept.sort()
    parts, at = [], 0
    for begin, end, place in kept:
        parts += (text[at:begin], tokens[place])
        at = end
    parts.append(text[at:])
    return "".join(parts)


def replace_values(text: str, values: Sequence[str], tokens: Sequence[str]) -> str:
    """`text` with each value's occurrences replaced by its token, one value after the other.

    Empty values replace nothing.  Takes time for the text and its hits, and once more
    for each value that stands at or in a token.
    """
    if not all(tokens[i] for i, value in enumerate(values) if value):  # texts would grow together
        for value, token in zip(values, tokens):
            text = text.replace(value, token) if value else text
        return text
    places: dict[str, int] = {}
    for i, value in enumerate(values):
        if value:
            places.setdefault(value, i)
    if not places:
        return text
    near = _at_tokens(places, [tokens[i] for i, value in enumerate(values) if value])
    plain = {value: i for value, i in places.items() if value not in near}
    automaton = _automaton(plain) if plain else None
    start = 0
    for i, value in enumerate(values):
        if value in near:
            if automaton is not None:
                text = _walked(text, automaton, tokens, start, i)
            text = text.replace(value, tokens[i])
            start = i + 1
    return text if automaton is None else _walked(text, automaton, tokens, start, len(values))


def replace_many(text: Column, values: Column, tokens: Column) -> Column:
    """`replace_values` on columns, an Arrow batch at a time; null texts stay null."""

    @F.arrow_udf("string")
    def run(texts, value_lists, token_lists):
        import pyarrow as pa

        done = []
        for one, found, put in zip(texts, value_lists, token_lists):
            plain = one.as_py()
            if plain is not None and found.values is not None:
                plain = replace_values(plain, found.values.to_pylist(), put.values.to_pylist())
            done.append(plain)
        return pa.array(done, pa.string())

    return run(text, values, tokens)
