"""Byte-level BPE by ranks as a tree reduction: halves are encoded, then joined.

Encodings form a monoid: the encoding of two texts put together follows from the
two encodings.  Only tokens near the border can change.  A window over the border,
at first one token of either side, is encoded anew.  If its first token is the one
that stood there before, all tokens to its left stay, and likewise on the right;
else the window grows on that side.

Why this is right: a sequence is the encoding of its text exactly if each token is
the encoding of its own text and so is each pair of neighbours.  (Merges go by rank,
then from the left.  The first merge across a border of two such tokens would be done
just so in their joint text alone.)  Tokens and pairs in the window come from one
encoding, those outside from the two halves, and the pairs at the window's ends stood
there before.

Decoding is the other way round: texts of tokens, put together up a tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bpe import NEWER
from veilframe.llm.common import Memory, col, unpacked, whole_row
from veilframe.operators.steps import compute_once

#: A file of ranks is broadcast; none may be larger.
MAX_FILE_BYTES = 64 << 20
#: Entries of one generation of a memory, for cells and for parts of them, and the longest text that is kept.
CELLS_REMEMBERED, PARTS_REMEMBERED, REMEMBERED_BYTES = 350_000, 200_000, 64
#: Windows up to this many bytes are merged by looking at all pairs each time.
SHORT = 48
#: Characters that are encoded, and tokens that are decoded, at a time.
STRETCH, LEAF = 1 << 20, 1 << 12

#: Fixed value: white space of the pattern.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
#: The pattern cuts a text wherever this does, and elsewhere only inside a cell.
CELLS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A place that ends one cell and begins the next, whatever stands around it.
BORDER = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def _by_unicode_16(pattern: str) -> str:
    """The pattern with letters and numbers of Unicode 16, which tokenizers here go by."""
    other, letter, number = r"[^\s\p{L}\p{N}]", r"\p{L}+", r"\p{N}+"
    if pattern.count(other) != 1 or pattern.count(letter) != 1 or pattern.count(number) != 1:
        raise ValueError("another pattern than the one that cells are made for")
    before, after = pattern.split(other)
    before = before.replace(letter, rf"[\p{{L}}--[{NEWER}]]+").replace(number, rf"[\p{{N}}--[{NEWER}]]+")
    return f"{before}[{other}||[{NEWER}]]{after}"


class Ranks:
    """Tokens by rank: encoding and decoding of texts."""

    def __init__(self, data: bytes):
        pairs = (line.split() for line in data.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)) or len(set(self.ranks.values())) < len(self.ranks):
            raise ValueError("a rank for every byte and every token is needed, each once")
        self.texts: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(_by_unicode_16(public_tokenizers.PATTERN), regex.V1)
        self.seams, self.parts, self.by_cell = Memory(PARTS_REMEMBERED), Memory(PARTS_REMEMBERED), Memory(CELLS_REMEMBERED)

    def merged(self, text: bytes) -> tuple[int, ...]:
        """Tokens of a short text, by doing the merges: lowest rank first, then from the left."""
        if len(text) > SHORT:
            return self._merged_by_queue(text)
        get, parts = self.ranks.get, [text[i : i + 1] for i in range(len(text))]
        pairs = [get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < 1 << 62:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 62)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 62)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merged_by_queue(self, text: bytes) -> tuple[int, ...]:
        """The same with a queue of pairs, for windows that have grown."""
        n, get = len(text), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each byte
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if end[a] != b or b >= n or end[b] != c:
                continue  # one of the two parts is gone
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (r := get(text[a : end[c]])) is not None:
                    heapq.heappush(queue, (r, a, c, end[c]))
            p = before[a]
            if p >= 0 and (r := get(text[p:c])) is not None:
                heapq.heappush(queue, (r, p, a, c))
        found, at = [], 0
        while at < n:
            found.append(self.ranks[text[at : end[at]]])
            at = end[at]
        return tuple(found)

    def _text(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, tokens))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two texts put together, from their encodings."""
        if not left or not right:
            return left + right
        i = j = 1  # tokens of either side in the window
        while True:
            window = self._window(left[-i:] + right[:j])
            grow_left = i < len(left) and window[0] != left[-i]
            grow_right = j < len(right) and window[-1] != right[j - 1]
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            if grow_left:
                i = min(2 * i, len(left))
            if grow_right:
                j = min(2 * j, len(right))

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """The joint text of neighbouring tokens, encoded anew."""
        text = self._text(tokens)
        if len(text) > SHORT:
            return self.merged(text)
        found = self.seams.get(text)
        if found is None:
            found = self.merged(text)
            self.seams.put(text, found)
        return found

    def reduced(self, text: bytes) -> tuple[int, ...]:
        """Tokens that merges give, by halves."""
        if len(text) == 1:
            return (self.ranks[text],)
        found = self.parts.get(text) if len(text) <= REMEMBERED_BYTES else None
        if found is None:
            half = len(text) // 2
            found = self.join(self.reduced(text[:half]), self.reduced(text[half:]))
            if len(text) <= REMEMBERED_BYTES:
                self.parts.put(text, found)
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern; one that is a token itself is that token."""
        whole = self.ranks.get(piece)
        return self.reduced(piece) if whole is None else (whole,)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece.encode())).tobytes()

    def _cell(self, cell: str) -> bytes:
        """Ids of one cell, or of one piece, as 32-bit numbers."""
        found = self.by_cell.get(cell)
        if found is None:
            letters = cell[1:] if cell[0] == " " else cell
            if letters.isalpha():  # letters are one piece, with or without a blank
                found = self._piece(cell)
            elif letters[:-1].isalpha() and letters[-1] in ",.":
                found = self._cell(cell[:-1]) + self._cell(cell[-1])
            else:
                pieces = self.pieces.findall(cell)
                found = self._piece(cell) if len(pieces) == 1 else b"".join(map(self._cell, pieces))
            if len(cell) <= REMEMBERED_BYTES:
                self.by_cell.put(cell, found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, a stretch at a time."""
        coded, start = [], 0
        while start < len(text):
            border = BORDER.search(text, start + STRETCH)
            stop = border.start() if border else len(text)
            cells = CELLS.findall(text, start, stop)
            found = list(map(self.by_cell.young.get, cells))
            if None in found:
                found = [self._cell(cells[k]) if ids is None else ids for k, ids in enumerate(found)]
            coded.append(b"".join(found))
            start = stop
        return np.frombuffer(b"".join(coded), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens: leaves of some thousand tokens, then pairs up the tree."""
        try:
            level = [self._text(ids[i : i + LEAF].tolist()) for i in range(0, len(ids), LEAF)] or [b""]
        except KeyError as e:
            raise ValueError(f"there is no token of the id {e}") from None
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


_LOADED: dict[str, Ranks] = {}


class RankTokenizer:
    """Encoding and decoding as column functions, from a file of ranks.

    The file is read once, by the driver, and broadcast; its size is checked.
    """

    def __init__(self, spark, path: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError("the file of ranks is too large to be broadcast")
        with open(path, "rb") as file:
            data = file.read()
        self._key = hashlib.sha256(data).hexdigest()
        self._data = spark.sparkContext.broadcast(data)

    def _loader(self):
        key, data = self._key, self._data

        def load() -> Ranks:
            if key not in _LOADED:
                _LOADED[key] = Ranks(data.value)
            return _LOADED[key]

        return load

    def encode(self, text: Column) -> Column:
        """Token ids of each text; null counts as empty."""
        load = self._loader()

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            ranks = load()
            rows = [ranks.encode(t.as_py()) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

        return run(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Bytes of each list of ids; null stays null."""
        load = self._loader()

        @F.arrow_udf("binary")
        def run(lists: pa.Array) -> pa.Array:
            ranks = load()
            return pa.array((None if one.values is None else ranks.decode(one.values.to_numpy(zero_copy_only=False)) for one in lists), pa.binary())

        return run(ids)

    def round_trip(self, text: Column) -> Column:
        """Ids of each text as 32-bit numbers, lowest byte first, and the bytes that they decode to."""
        load = self._loader()

        @F.arrow_udf("ids binary, decoded binary")
        def run(texts: pa.Array) -> pa.Array:
            ranks = load()
            rows = [ranks.encode(t.as_py()) for t in texts]
            packed = pa.array([r.astype("<i4", copy=False).tobytes() for r in rows], pa.binary())
            return pa.StructArray.from_arrays([packed, pa.array(map(ranks.decode, rows), pa.binary())], ["ids", "decoded"])

        return run(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the token ids of each whole text, in an array column.

    Null and empty texts give an empty array, an empty table an empty one; a very long text is
    encoded a stretch at a time, a very long piece of it up the tree.  Rows, repeats, ties and
    all other columns stay; a column already called like the new one is replaced.
    """
    packed = docs.select(whole_row(docs).alias("row"))
    packed = packed.withColumn("ids", RankTokenizer(docs.sparkSession, path).encode(F.col("row").getField(text)))
    return unpacked(packed, "row", docs.columns, **{ids: F.col("ids")})


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the bytes of each list of ids.

    A null list gives null, an empty one no bytes, an empty table an empty one; an id or an
    element that is no token is an error.  A column called like the new one is replaced.
    """
    found = RankTokenizer(docs.sparkSession, path).decode(col(ids)).alias(decoded)
    return docs.select(*[col(c) for c in docs.columns if c.lower() != decoded.lower()], found)


def round_trip_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_bytes", decoded: str = "decoded") -> DataFrame:
    """`docs` encoded and decoded again in one pass: ids packed as 32-bit numbers, lowest byte first, and the bytes they stand for.

    As `encode_documents` and `decode_documents`, for where the ids are kept packed and checked.
    """
    packed = docs.select(whole_row(docs).alias("row"))
    packed = packed.withColumn("done", RankTokenizer(docs.sparkSession, path).round_trip(F.col("row").getField(text)))
    packed = compute_once(packed, "done", F.col("done"))  # else every reader of the ids encodes anew
    return unpacked(packed, "row", docs.columns, **{ids: F.col("done.ids"), decoded: F.col("done.decoded")})
