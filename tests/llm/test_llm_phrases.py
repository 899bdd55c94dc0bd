import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from check import compare, duck
from veilframe.llm import phrases
from veilframe.llm.queries import QUERIES, read


def by_force(rows, lowest=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= lowest}
        kept = []
        for p, a in candidates.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= share * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def small_bitmap(monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 1 << 15)  # so full that rare phrases pass
    monkeypatch.setattr(phrases, "COUNTED_BYTES", 300)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "City", "the", "THE", "of", "é", "Ünï", "a-b", "x\x1cy", "1", "日本", "ÀB"]
    ends = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "\x0b", "? ", ":", " , "]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [(None, None), ("en", ""), ("fr", None), ("en", " \n.. "), ("en", "New york city " * 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting_all(spark, seed):
    rows = corpus(seed)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, prefix string, `a.b` int").repartition(5)
    assert found(phrases.collocations(table)) == by_force(rows)
    assert found(phrases.collocations(table, lowest=4, share=80, top=7)) == by_force(rows, 4, 80, 7)


def test_bits_that_are_shared_change_nothing(spark, small_bitmap):
    # tasks are other processes: the module's numbers there are those of the file, so stripes are made here
    rows = corpus(3, 40)
    known = []
    for length in range(3):
        parts = defaultdict(list)
        for lang, text in rows:
            parts["und" if lang is None else lang].append((text or "").encode().translate(phrases.TABLE) + b"\n")
        sums = Counter()
        for lang, texts in parts.items():
            for share in phrases._shares(b"".join(texts)):
                made = phrases._stripes(lang, share, length, known, known[-1] if known else None)
                for r in made.to_pylist() if made is not None else []:
                    for word, f in zip(r["nexts"].split(" ") if r["nexts"] else [], r["counts"].split(), strict=True):
                        sums[r["lang"], r["prefix"], word] += int(f)
        frequent = [(k, v) for k, v in sums.items() if v >= 10 and k[2] is not None]
        bits = phrases.Frequent({})
        for (lang, prefix, word), _ in frequent:
            row = [h for w in [*prefix.split(" "), word] if w for h in [phrases._hash([w.encode()], lang)]]
            at = int(phrases._place(phrases.reduce(phrases._mixed, row))[0])
            bits.bits[at >> 3] |= 1 << (at & 7)
        known.append(bits)
        want = Counter()
        for lang, text in rows:
            lower = (text or "").encode().translate(phrases.TABLE).decode()
            for piece in lower.split("\n"):
                w = piece.split(" ")
                w = [x for x in w if x]
                want.update(("und" if lang is None else lang, " ".join(w[i : i + length]), w[i + length]) for i in range(len(w) - length))
        assert dict(frequent) == {k: v for k, v in want.items() if v >= 10}


def test_bitmap_holds_what_it_was_made_of(spark):
    words = [f"w{i}" for i in range(5000)]
    table = spark.createDataFrame([("en", "", w) for w in words] + [("de", "", "solo")], "lang string, prefix string, next string")
    known = phrases.frequent(table, 1)
    assert known.has(phrases._hash([w.encode() for w in words], "en")).all()
    assert known.has(phrases._hash([b"solo"], "de")).all()
    assert known.has(phrases._hash([b"other%d" % i for i in range(5000)], "en")).mean() < 0.01
    pairs = spark.createDataFrame([("en", "a b", "c")], "lang string, prefix string, next string")
    three = [phrases._hash([w], "en") for w in (b"a", b"b", b"c")]
    assert phrases.frequent(pairs, 3).has(phrases._mixed(phrases._mixed(three[0], three[1]), three[2])).all()


def test_no_rows(spark, edge_rows, no_rows):
    assert phrases.collocations(no_rows).count() == 0
    rows = [(r.lang, r.text) for r in edge_rows.collect()]
    assert found(phrases.collocations(edge_rows)) == by_force(rows)


def test_large_products(spark):
    a, left, right = 10**14, 10**14 + 1, 10**15
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s"))
    assert df.first().s == 1000000 * a * a // (left * right)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), sf, "op13_phrases") is None
    rows = [(r.lang, r.text) for r in read(spark, sf, "documents", "lang", "text").collect()]
    assert found(QUERIES["op13_phrases"](spark, sf)) == by_force(rows)


def test_total_of_a_stripe_is_the_count_of_its_prefix(spark):
    texts = spark.createDataFrame(corpus(4), "lang string, text string").fillna({"lang": "und", "text": ""})
    ones = {(r.lang, r["next"]): r.f for r in phrases.merged(phrases.stripes(texts, 0, [])).filter("next is not null").collect()}
    known = spark.sparkContext.broadcast(phrases.Frequent({}))
    known.value.bits[:] = np.uint8(255)
    every = spark.sparkContext.broadcast(known.value)
    none = spark.sparkContext.broadcast(phrases.Frequent({}))
    found = []
    for hot in (every, none):  # in slices and whole
        rows = phrases.merged(phrases.stripes(texts, 1, [every], hot)).collect()
        assert {(r.lang, r.prefix): r.f for r in rows if r["next"] is None} == ones and len(ones) > 10
        found.append({(r.lang, r.prefix, r["next"], r.f) for r in rows})
        assert len(found[-1]) == len(rows)
    assert found[0] == found[1]
