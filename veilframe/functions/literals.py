"""Which plain strings a text must hold for a pattern to have a hit in it.

A text is folded (ASCII letters in lower case, with the few letters that Unicode case
folding brings to them) and searched once for the strings of all patterns; only the
patterns whose strings are there are worth running.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

#: The shortest string that is worth an entry.
SHORTEST = 2
#: Letters outside ASCII that equal an ASCII letter where case is ignored.
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"} | {c: chr(c + 32) for c in range(65, 91)}
# escapes that stand for something longer or that change how what follows is read
_UNREAD = re.compile(r"\\[QExucNk0-9]|\(\?[a-zA-Z]*x|\(\?#|&&")


def fold(text: str) -> str:
    return text.translate(FOLDED)


class _Reader:
    """One pass over a pattern, noting the runs of plain characters that each hit contains."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def alternatives(self, depth: int = 0) -> list[frozenset[str] | None]:
        """What each branch needs, up to the closing parenthesis: one of a set of strings, or None."""
        found = [self._branch()]
        while self.at < len(self.pattern) and self.pattern[self.at] == "|":
            self.at += 1
            found.append(self._branch())
        if depth == 0 and self.at < len(self.pattern):
            raise ValueError("unbalanced parentheses")
        return found

    def _branch(self) -> frozenset[str] | None:
        needs: list[frozenset[str]] = []
        run = ""

        def end_run() -> None:
            nonlocal run
            if run:
                needs.append(frozenset([run]))
            run = ""

        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            plain, need = self._atom()
            least, most = self._quantifier()
            if plain is not None and least >= 1:
                run += plain
                if most != 1:  # repeated: what follows need not stand next to the first one
                    end_run()
            else:
                end_run()
                if need and least >= 1:
                    needs.append(need)
        end_run()
        usable = [n for n in needs if min(map(len, n)) >= SHORTEST]
        # the longest string says most; of several to choose from, the shortest counts
        return max(usable, key=lambda n: (min(map(len, n)), -len(n), sorted(n)), default=None)

    def _atom(self) -> tuple[str | None, frozenset[str] | None]:
        """A plain character in folded form, or what a group needs."""
        c = self.pattern[self.at]
        self.at += 1
        if c == "\\":
            c = self.pattern[self.at]
            self.at += 1
            if c in "pP":
                stop = self.pattern.index("}", self.at) + 1 if self.pattern[self.at] == "{" else self.at + 1
                self.at = stop
                return None, None
            return (None, None) if c.isalnum() else self._plain(c)
        if c == "[":
            self._skip_class()
            return None, None
        if c == "(":
            return None, self._group()
        if c in ".^$":
            return None, None
        if c in "*+?{":
            raise ValueError("nothing to repeat")
        return self._plain(c)

    def _plain(self, c: str) -> tuple[str | None, None]:
        return (fold(c) if c.isascii() else None), None

    def _group(self) -> frozenset[str] | None:
        counts = True
        if self.pattern.startswith("?", self.at):
            head = re.compile(r"\?(?:[:>]|<[A-Za-z][A-Za-z0-9]*>|[a-zA-Z-]*:)").match(self.pattern, self.at)
            flags = re.compile(r"\?[a-zA-Z-]*\)").match(self.pattern, self.at)
            if flags:
                self.at = flags.end()
                return None
            counts = head is not None  # else it looks ahead or behind: what it needs may stand outside the hit, or not at all
            self.at = head.end() if head else re.compile(r"\?<?[=!]").match(self.pattern, self.at).end()
        found = self.alternatives(1)
        if not self.pattern.startswith(")", self.at):
            raise ValueError("a group without an end")
        self.at += 1
        return union(found) if counts else None

    def _skip_class(self) -> None:
        """To the end of a character class, with the classes in it."""
        if self.pattern.startswith("^", self.at):
            self.at += 1
        if self.pattern.startswith("]", self.at):
            raise ValueError("a bracket that begins a class")
        while (c := self.pattern[self.at]) != "]":
            self.at += 2 if c == "\\" else 1
            if c == "[":
                self._skip_class()
        self.at += 1

    def _quantifier(self) -> tuple[int, int | None]:
        found = re.compile(r"(?:([*+?])|\{([0-9]+)(,?)([0-9]*)\})[?+]?").match(self.pattern, self.at)
        if not found:
            return 1, 1
        self.at = found.end()
        sign, least, comma, most = found.groups()
        if sign:
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        return int(least), int(most) if most else None if comma else int(least)


def union(found: Iterable[frozenset[str] | None]) -> frozenset[str] | None:
    """One of any of the sets; None if some branch needs nothing."""
    together: set[str] = set()
    for need in found:
        if need is None:
            return None
        together |= need
    return frozenset(together) or None


def required_literals(pattern: str) -> frozenset[str] | None:
    """Folded strings of which each text with a hit holds one; None if there are no such strings, or none are known."""
    if _UNREAD.search(pattern):
        return None
    try:
        return union(_Reader(pattern).alternatives())
    except (ValueError, IndexError, AttributeError):
        return None  # not read to its end; Spark says what is wrong with it


def literal_index(patterns: Mapping[int, frozenset[str]]):
    """An automaton over the strings of all patterns, each with the numbers of its patterns."""
    import ahocorasick

    where: dict[str, list[int]] = {}
    for number, strings in patterns.items():
        for s in strings:
            where.setdefault(s, []).append(number)
    index = ahocorasick.Automaton()
    for s, numbers in where.items():
        index.add_word(s, tuple(numbers))
    index.make_automaton()
    return index


def present(index, text: str) -> list[int]:
    """Numbers of the patterns whose strings are in a text, in order."""
    seen: set[tuple[int, ...]] = {numbers for _, numbers in index.iter(fold(text))}
    return sorted({n for numbers in seen for n in numbers})
