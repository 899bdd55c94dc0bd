"""Byte-level BPE: encoding by longest matches with backtracking, decoding by offsets.

The encoder never replays merges.  An Aho-Corasick automaton gives the longest
token at every position of a piece.  A token may follow another one only if
merging their joint text would give just these two; where it would not, the next
shorter token is tried, and where none is left the token before is given up.
Every position is given up at most once, so the time is linear.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import Memory, col, unpacked, whole_row
from veilframe.operators.steps import compute_once

#: Fixed value: letters and numbers of the regex module that are newer than
#: Unicode 16, by which byte-level BPE is defined here.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Fixed value: how byte-level BPE cuts a text in pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    rf"| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]+"
    r"|\s+(?!\S)|\s+"
)
#: A tokenizer's file is broadcast; none may be larger.
MAX_FILE_BYTES = 64 << 20
#: Entries of one generation of what a worker remembers: words, and pieces and pairs of tokens; the longest text of one.
WORDS_REMEMBERED, REMEMBERED, REMEMBERED_BYTES = 350_000, 150_000, 100
#: Tokens that are turned into bytes at a time.
DECODED_AT_ONCE = 1 << 20


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file.

    Printable Latin-1 stands for itself, all else for 256 and up in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in letters]
    letters |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens of a byte-level BPE file, numbered by rank: bytes first, then merges."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or file["normalizer"] or not plain:
            raise ValueError("a plain byte-level BPE file is needed")
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.texts = [bytes([b]) for b in range(256)]
        self.ids = [model["vocab"][c] for c in letters]
        self.halves = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        rank = {t: r for r, t in enumerate(self.texts)}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = tuple(rank[bytes(byte_of[c] for c in part)] for part in (left, right))
            text = self.texts[pair[0]] + self.texts[pair[1]]
            if text in rank:
                raise ValueError("two merges give the same token")
            self.merged[pair] = rank[text] = len(self.texts)
            self.texts.append(text)
            self.ids.append(model["vocab"][left + right])
            self.halves.append(pair)
        self.lengths = [len(t) for t in self.texts]
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.special = {}
        for added in file["added_tokens"]:
            if any(added.get(k) for k in ("single_word", "lstrip", "rstrip")):
                raise ValueError("an added token asks for more than its own text")
            self.special[added["content"]] = added["id"]
        longest_first = sorted(self.special, key=lambda s: (-len(s), s))
        self.is_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.pieces = regex.compile(PIECES, regex.V1)
        self.pairs = Memory(REMEMBERED)  # the compatibility table, as far as it was needed
        self.by_piece = Memory(REMEMBERED)
        self.by_word = Memory(WORDS_REMEMBERED)  # words with a blank before them, by the word
        by_id = dict(zip(self.ids, self.texts)) | {i: s.encode() for s, i in self.special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.known = np.array([i in by_id for i in range(len(parts))])
        self.table = pa.array(parts, pa.binary())  # bytes of all tokens, one after the other, with their offsets

    def compatible(self, left: int, right: int) -> bool:
        """Do merges of the joint text leave exactly these two tokens?

        Takes the later of the two merges back, again and again, and looks for
        a merge across the border that would have come first.
        """
        before = len(self.texts)  # only merges of lower rank would have come first
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and left >= 256:
                    before, left = left, self.halves[left][1]
                    break
                if side == "right" and right >= 256:
                    before, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        n = len(piece)
        longest, lengths, shorter, pairs = [0] * n, self.lengths, self.shorter, self.pairs
        for end, r in self.automaton.iter(piece.decode("latin-1")):  # ends ascend: the longest comes last
            longest[end + 1 - lengths[r]] = r
        longest.append(-1)
        open_at = bytearray(b"\1") * (n + 1)
        found: list[int] = []
        at, token, fits = 0, longest[0], True
        while at < n:
            end = at + lengths[token]
            if found and open_at[end]:
                pair = found[-1], token
                fits = pairs.get(pair)
                if fits is None:
                    fits = self.compatible(*pair)
                    pairs.put(pair, fits)
            if fits and open_at[end]:
                found.append(token)
                at = end
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = found.pop()
                at -= lengths[token]
            fits = True
        return found

    def _pieces_of(self, text: str) -> bytes:
        """Ids of a text, cut in pieces by the pattern, as 32-bit numbers."""
        out = []
        for m in self.pieces.finditer(text):
            piece = m.group()
            ids = self.by_piece.get(piece)
            if ids is None:
                data = piece.encode()
                ids = self._coded(data)
                if len(data) <= REMEMBERED_BYTES:
                    self.by_piece.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def _coded(self, piece: bytes) -> bytes:
        return array("i", [self.ids[r] for r in self.encode_piece(piece)]).tobytes()

    def _spaced(self, word: str) -> bytes:
        """Ids of a word with a blank before it.

        Letters and the blank are one piece; so are a point or comma after them.
        """
        ids = self.by_word.get(word)
        if ids is not None:
            return ids
        if word.isalpha():
            ids = self._coded(b" " + word.encode())
        elif word[-1] in ",." and word[:-1].isalpha():
            stem = self.by_word.get(word[:-1])
            return (self._spaced(word[:-1]) if stem is None else stem) + self._word(word[-1])
        else:
            ids = self._pieces_of(" " + word)
        if len(word) <= REMEMBERED_BYTES:
            self.by_word.put(word, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        The pattern starts anew at a blank or line feed that follows a
        character which is not white space, or is followed by one.  Where that is
        so throughout, words with the blank before them are looked up whole.
        """
        if "\n\n\n" in text or text.endswith("\n\n"):
            return self._pieces_of(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self._word("\n"))
            if not line:
                continue
            words = line.split(" ")
            if words != line.split():  # other white space, or more than one in a row
                return self._pieces_of(text)
            out.append(self._word(words[0]))
            found = list(map(self.by_word.young.get, words[1:]))
            if None in found:
                found = [self._spaced(words[k]) if ids is None else ids for k, ids in enumerate(found, 1)]
            out += found
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.by_piece.get(word)
        return self._pieces_of(word) if ids is None else ids

    def encode(self, text: str) -> np.ndarray:
        if self.is_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = self.is_special.split(text)
        coded = [np.int32(self.special[x]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts)]
        return np.frombuffer(b"".join(coded), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of many tokens at once: a table of all tokens' bytes, taken from by its offsets."""
        out = []
        for start in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[start : start + DECODED_AT_ONCE]
            if part.min() < 0 or part.max() >= len(self.known) or not self.known[part].all():
                raise ValueError("there is no token of such an id")
            taken = self.table.take(pa.array(part))
            offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
            out.append(taken.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if offsets[-1] > offsets[0] else b"")
        return b"".join(out)


_LOADED: dict[str, Vocabulary] = {}


class Tokenizer:
    """Encoding and decoding as column functions, from a vocabulary file.

    The file is read once, by the driver, and broadcast; its size is checked.
    """

    def __init__(self, spark, path: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError("the vocabulary file is too large to be broadcast")
        with open(path, "rb") as file:
            data = file.read()
        self._key = hashlib.sha256(data).hexdigest()
        self._data = spark.sparkContext.broadcast(data)

    def _loader(self):
        key, data = self._key, self._data

        def load() -> Vocabulary:
            if key not in _LOADED:
                _LOADED[key] = Vocabulary(data.value)
            return _LOADED[key]

        return load

    def encode(self, text: Column) -> Column:
        """Token ids of each text; null counts as empty."""
        load = self._loader()

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            return _lists(load().encode(t.as_py()) for t in texts)

        return run(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Text of each list of ids; bad UTF-8 is replaced, null stays null."""
        load = self._loader()

        @F.arrow_udf("string")
        def run(lists: pa.Array) -> pa.Array:
            words = load()
            return pa.array(
                (None if one.values is None else words.decode(one.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for one in lists),
                pa.string(),
            )

        return run(ids)

    def round_trip(self, text: Column) -> Column:
        """Token ids of each text, and the text that they decode to."""
        load = self._loader()

        @F.arrow_udf("ids array<int>, decoded string")
        def run(texts: pa.Array) -> pa.Array:
            words = load()
            rows = [words.encode(t.as_py()) for t in texts]
            decoded = pa.array([words.decode(r).decode("utf-8", "replace") for r in rows], pa.string())
            return pa.StructArray.from_arrays([_lists(rows), decoded], ["ids", "decoded"])

        return run(F.coalesce(text, F.lit("")))


def _lists(rows: Iterable[np.ndarray]) -> pa.Array:
    parts = list(rows)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the token ids of each whole text, in an array column.

    Null and empty texts give an empty array; text of added tokens becomes
    those tokens.  Rows, repeats and all other columns stay; a column already
    called like the new one is replaced.
    """
    packed = docs.select(whole_row(docs).alias("row"))
    packed = packed.withColumn("ids", Tokenizer(docs.sparkSession, path).encode(F.col("row").getField(text)))
    return unpacked(packed, "row", docs.columns, **{ids: F.col("ids")})


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text of each list of ids.

    A null list gives null, an empty one the empty text; an id or an element
    that is no token is an error.  A column called like the new one is replaced.
    """
    decoded = Tokenizer(docs.sparkSession, path).decode(col(ids)).alias(text)
    return docs.select(*[col(c) for c in docs.columns if c.lower() != text.lower()], decoded)


def round_trip_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with token ids and the text that they decode to, encoded and decoded in one pass.

    What `encode_documents` and `decode_documents` give one after the other, null and
    empty texts, repeats, ties and very long texts included; an empty table stays empty.
    """
    packed = docs.select(whole_row(docs).alias("row"))
    packed = packed.withColumn("done", Tokenizer(docs.sparkSession, path).round_trip(F.col("row").getField(text)))
    packed = compute_once(packed, "done", F.col("done"))  # else every reader of the ids encodes anew
    return unpacked(packed, "row", docs.columns, **{ids: F.col("done.ids"), decoded: F.col("done.decoded")})
