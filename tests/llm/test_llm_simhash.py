import random
import re

import pytest
import xxhash

from veilframe.llm import simhash
from veilframe.llm.components import components


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    n = range(len(rows))
    near = [(i, j) for i in n for j in n if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(n, near)
    least = {}
    for i in n:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in n)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    texts = ["", " \n", "one", "One TWO", "a b c", "É Ä ß", "a " * 500, *("".join(rng.choice("aB \n\té\x0b\x1c.") for _ in range(rng.randint(0, 300))) for _ in range(60))]
    for text in texts:
        assert simhash.simhash(text) & (1 << 64) - 1 == brute_print(text)


@pytest.mark.parametrize(("distance", "full"), [(1, 64), (1, 2), (2, 64), (2, 3)])
def test_links_join_what_brute_force_joins(spark, distance, full):
    rng = random.Random(distance * 10 + full)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(25):
            p = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                p ^= 1 << b
            prints.add(p)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, full)
    got = [(r.fp, r.other) for r in df.collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert roots(signed, got) == roots(signed, near)
    if full == 64:
        assert len(got) == len(set(got)) and {tuple(sorted(e)) for e in got} <= set(near)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(180)] + [(0, i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots(nodes, edges) | {} if 7 in nodes else roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((100 + i, " ".join(text)))
    rows += [(200, ""), (201, None), (202, "w1"), (203, "w1 w2")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def test_edges(edge_rows, no_rows):
    got = simhash.near_duplicates(edge_rows).collect()
    assert len(got) == edge_rows.count()
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {None: 1, 1: 1, 5: 1, 6: 1}
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert simhash.near_duplicates(no_rows).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(edge_rows, max_distance=3)
