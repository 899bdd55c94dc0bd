"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if at least one of its sentences is, so its score is the
noisy-or 1 - prod(1 - p) over its sentences' scores p.  A sentence's score is a
logistic sum of word weights.  The weights are trained from document labels
through the noisy-or, and then tell which sentences gave offence.

Any sentence has a score above zero, and enough harmless ones would make a long
document toxic.  So a floor is learnt too, the highest that judges next to no
more of the sample wrong.  Sentences below it add nothing; where all are below, the worst one counts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, saved, unpacked, whole_row

#: At most so many labelled documents of either class are learnt from, whole ones, and so many characters in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 4000, 30_000_000
#: Weights are learnt for words and beginnings of words in so many sampled documents.
LEAST_DOCUMENTS = 3
BEGINNINGS = (4, 5)
#: Rounds of training, first with a penalty that sets most weights to zero, then without on the rest.
ROUNDS, PENALTY, REFINED = 200, 5e-5, 60
#: Documents and sentences from this score on count as toxic.
LEAST_SCORE = 0.5
#: Floors that are tried, from the highest, and what part of the sample's toxic documents one may cost.
FLOORS, FLOOR_COST = tuple(x / 4 for x in range(-4, -61, -1)), 0.01
#: Words whose weight a worker remembers.
REMEMBERED = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<score: double, sentences: array<struct<start: int, end: int, score: double>>>"


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected and compound forms share."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has a word."""
    for m in _SENTENCE.finditer(text):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


def _hazard(z: float) -> float:
    """-log(1 - p) of a sentence."""
    return math.log1p(math.exp(-abs(z))) + max(z, 0.0)


@dataclass
class Model:
    """Weights of features, the sum that a sentence starts from, and the sum from which on it counts."""

    bias: float
    weights: dict[str, float]
    floor: float = -math.inf
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "floor": self.floor, "_known": {}}

    def word(self, word: str) -> float:
        known = self._known.get(word)
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            known = self._known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return known

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and its offending sentences (start, end, score)."""
        total, found, best = 0.0, [], None
        for start, end, words in sentences(text):
            z = self.bias + sum(map(self.word, sorted(words)))
            if z >= self.floor:
                total += _hazard(z)
            if best is None or z > best[2]:
                best = (start, end, z)
            if z >= 0:
                found.append((start, end, z))
        if best is not None and best[2] < self.floor:
            total = _hazard(best[2])
        score = -math.expm1(-total)
        if score >= LEAST_SCORE and not found:
            found = [best]
        return score, [(a, b, 1 / (1 + math.exp(-max(z, -700.0)))) for a, b, z in found]


def train(texts: list[str], labels: list[int], weights: list[float]) -> Model:
    """Fit the noisy-or to labelled documents by gradient descent (Adam).

    With no document, or none of one class, no word gets a weight and a
    sentence's score is next to 0, or next to 1 where all are toxic.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(30.0 if len(y) and y.min() == 1 else -30.0, {})
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update({f for _, _, words in sentences(text) for w in words for f in features(w)})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_DOCUMENTS))}
    del seen
    found, inside, owner = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):  # cut anew, as keeping all words takes many times the texts' memory
        for _, _, words in sentences(text):
            ids = [index[f] for w in sorted(words) for f in features(w) if f in index]
            found.extend(ids)
            inside.extend([len(owner)] * len(ids))
            owner.append(d)
    word, at, doc_of = (np.array(x, np.int64) for x in (found, inside, owner))
    share = np.array(weights, float) / np.mean(weights)
    n_words, n_sentences, n = len(index), len(owner), len(y)
    w, b = np.zeros(n_words), -4.0
    free = np.ones(n_words, bool)

    def gradient(w, b):
        z = b + np.bincount(at, w[word], minlength=n_sentences)
        loss = np.bincount(doc_of, np.logaddexp(0, z), minlength=n)
        clean = np.exp(-np.maximum(loss, 1e-9))
        each = share * ((1 - y) - y * clean / (1 - clean)) / n
        by_sentence = each[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.bincount(word, by_sentence[at], minlength=n_words), by_sentence.sum()

    for rounds, penalty, rate in ((ROUNDS, PENALTY, 0.1), (REFINED, 0.0, 0.05)):
        m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
        for i in range(1, rounds + 1):
            g, gb = gradient(w, b)
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c, e = 1 - 0.9**i, 1 - 0.999**i
            step = rate / (np.sqrt(v / e) + 1e-6)
            w = w - step * m / c
            w = np.where(free, np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0), 0.0)
            b -= rate * (mb / c) / (math.sqrt(vb / e) + 1e-8)
        free = w != 0
    z = b + np.bincount(at, w[word], minlength=n_sentences)
    return Model(float(b), {f: float(w[i]) for f, i in index.items() if w[i]}, _floor(z, doc_of, y, share))


def _floor(z: np.ndarray, doc_of: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The highest floor under which sentences can be left out with next to no more documents of the sample judged wrong."""
    hazards = np.logaddexp(0, z)
    worst = np.zeros(len(y))
    np.maximum.at(worst, doc_of, hazards)

    def wrong(floor: float) -> float:
        total = np.bincount(doc_of, np.where(z >= floor, hazards, 0.0), minlength=len(y))
        score = -np.expm1(-np.where(total > 0, total, worst))
        return float(share[(score >= LEAST_SCORE) != (y == 1)].sum())

    allowed = wrong(-math.inf) + FLOOR_COST * float(share[y == 1].sum())
    return next((f for f in FLOORS if wrong(f) <= allowed), -math.inf)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a bounded sample of the documents that have a label.

    Of either class those ids with the smallest hashes are taken, up to
    SAMPLE_TOXIC and SAMPLE_CLEAN, and weighted to the shares of the classes.  Texts are
    learnt from whole, short and long ones alike, as many as make SAMPLE_CHARS
    characters in the order of the hashes.  Null ids, texts and labels and labels
    other than 0 and 1 are not learnt from.
    """
    known = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = []
    for y, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        share = min(1.0, 4 * most / max(1, counts.get(y, 0)))  # sorting meets few rows of a large table
        hashed = known.filter(F.col("y") == y).withColumn("h", F.xxhash64("id"))
        picked.append(hashed.filter(F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 4096))).orderBy("h").limit(most))
    sample = picked[0].union(picked[1]).select("id", "y")
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("t")).filter("t is not null")
    # one row for each label, however often an id repeats: at most SAMPLE_TOXIC + SAMPLE_CLEAN
    rows = rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    rows = saved(rows.select("id", "y", "t", F.xxhash64("id").alias("h")), "sample")
    last, size = None, 0
    for r in rows.select("h", F.length("t").alias("n")).orderBy("h", "n").collect():
        size += r.n
        if last is not None and size > SAMPLE_CHARS:
            break
        last = r.h
    taken = [] if last is None else rows.filter(F.col("h") <= last).collect()
    taken.sort(key=lambda r: (r.y, r.t))
    used = Counter(r.y for r in taken)
    return train([r.t for r in taken], [r.y for r in taken], [counts[r.y] / used[r.y] for r in taken])


def judge(text: Column, model: Model) -> Column:
    """Struct of the score and the offending sentences of a text column."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        found = (model.score(t.as_py()) for t in texts)
        return pa.array([{"score": s, "sentences": [{"start": a, "end": b, "score": p} for a, b, p in bad]} for s, bad in found], kind)

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score`, `predicted` (1 from LEAST_SCORE on) and `sentences`,
    the offending ones by (start, end, score) in code points, end exclusive.

    A text without words, null and empty ones too, has no sentence and scores 0; an
    empty table stays empty.  A text is scored whole, however long; equal texts score
    alike.  Rows, repeats and other columns stay; columns called like the new ones are replaced.
    """
    rows = docs.select(whole_row(docs).alias("row"), judge(col(text), model).alias("found"))
    score = F.col("found.score")
    return unpacked(rows, "row", docs.columns, score=score, predicted=(score >= LEAST_SCORE).cast("int"), sentences=F.col("found.sentences"))
