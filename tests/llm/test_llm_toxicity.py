import math
import random
import re
import zlib

from veilframe.llm import toxicity
from veilframe.llm.queries import QUERIES, held_out, toxicity_model


def made(n, seed):
    """Documents of clean sentences; in every third, one sentence has an offence."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 10))) for _ in range(rng.randint(1, 30))]
        bad = i % 3 == 0
        if bad:
            k = rng.randrange(len(text))
            text[k] += " " + rng.choice(["grubble", "snirkish", "snirkoid", "snirkette"])
        rows.append((i, ". ".join(text) + ".", int(bad)))
    return rows


def test_learns_words_and_beginnings_and_finds_sentences(spark):
    df = spark.createDataFrame(made(600, 1), "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    test = spark.createDataFrame(made(300, 2), "doc_id long, text string, toxic int")
    rows = toxicity.score_documents(test, model).collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 295
    for r in rows:
        if r.toxic and r.predicted:
            found = [r.text[s.start : s.end] for s in r.sentences]
            assert any("grubble" in s or "snirk" in s for s in found) and all(0 <= s.score <= 1 for s in r.sentences)
    assert model.score("A fresh snirkling came")[0] > 0.5


def test_held_out_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_toxicity"](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    bad, good = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.95 and sum(g >= 0.5 for g in good) <= 0.02 * len(good)


def test_edges(spark, edge_rows, no_rows):
    nothing = toxicity.fit(edge_rows, no_rows.selectExpr("doc_id", "none as toxic"))
    assert nothing.weights == {}
    rows = toxicity.score_documents(edge_rows, nothing).collect()
    assert len(rows) == edge_rows.count() and max(r.score for r in rows) < 0.01
    assert all(r.score == 0 and r.sentences == [] for r in rows if not (r.text or "").strip())
    assert toxicity.score_documents(no_rows, nothing).count() == 0
    one = spark.createDataFrame([(2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    assert toxicity.fit(edge_rows, one).score("anything")[0] > 0.99


def test_scores_are_the_noisy_or_of_sentences_from_the_floor_on():
    rows = made(400, 3)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], [1.0] * len(rows))
    assert -15 <= model.floor < 0
    for _, text, _ in made(200, 4):
        sums = []
        for sentence in re.split(r"[.!?\n]", text):
            words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
            if words:
                parts = [f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5) if len(w) >= n))]
                sums.append(model.bias + sum(model.weights.get(f, 0.0) for f in parts))
        counted = [z for z in sums if z >= model.floor] or [max(sums)]
        want = 1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in counted)
        assert abs(model.score(text)[0] - want) < 1e-9


def test_long_clean_texts_are_not_toxic(spark):
    """Clean sentences of the tables, a million and five million characters of them, with and without one that offends."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity_model(docs, spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(held_out())
    texts = docs.join(labels, "doc_id").select("text", "toxic").collect()
    clean = [r.text for r in texts if r.toxic == 0 and r.text and model.score(r.text)[0] < 0.05]
    bad = [r.text for r in texts if r.toxic == 1 and r.text]
    for size in (1_000_000, 5_000_000):
        parts, n = [], 0
        for i in range(10**6):
            if n >= size:
                break
            parts.append(clean[i % len(clean)])
            n += len(parts[-1]) + 1
        text = "\n".join(parts)
        assert model.score(text)[0] < 0.5
        offence = max((s for t in bad for s in model.score(t)[1]), key=lambda s: s[2])
        source = next(t for t in bad if offence in model.score(t)[1])
        planted = source[offence[0] : offence[1]]
        score, found = model.score(text + "\n" + planted + ".")
        assert score >= 0.5 and any((text + "\n" + planted)[a:b] == planted for a, b, _ in found)


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    rows = [(i, t + " filler text. " * 3000, y) for i, t, y in made(60, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(df, df).weights
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100_000)  # a few whole texts
    few = toxicity.fit(df, df)
    assert len(few.weights) < len(toxicity.train([r[1] for r in rows], [r[2] for r in rows], [1.0] * 60).weights)
