import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm import bpe
from veilframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


def texts():
    rng = random.Random(4)
    parts = [*"abc  \n\t'sthe1290é日語😀.,-=\\\x1c\x85\xa0՘₏", "<|endoftext|>", "\r\n", "   ", "'re", "\n\n", "กำ", "12", " The", "ing"]
    yield from ("", " ", "\n", "a\n", "a\n\n", "\n\n\na", "<|endoftext|><|endoftext|> b", "a" * 5000, " " * 3000 + "x", "=-" * 2000)
    yield from ("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000))
    yield from ("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x400, 0xD7FF), rng.randint(0x10000, 0x3FFFF)])) for _ in range(20)) for _ in range(1000))
    yield "".join(rng.choice("aehstion") for _ in range(20_000))


def test_equals_the_library_and_round_trips(vocabulary, library):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text).tolist() == ids, text[:200]
        assert vocabulary.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False) == text


def test_caches_may_run_full(vocabulary, library, monkeypatch):
    for memory in (vocabulary.pairs, vocabulary.by_piece, vocabulary.by_word):
        monkeypatch.setattr(memory, "size", 3)
    monkeypatch.setattr(bpe, "DECODED_AT_ONCE", 4)
    text = "The quick brown fox, jumped over 12 lazy dogs. " * 5
    assert vocabulary.decode(vocabulary.encode(text)).decode() == text
    assert vocabulary.encode(text).tolist() == library.encode(text).ids


def test_documents(edge_rows, no_rows, library):
    done = bpe.decode_documents(bpe.encode_documents(edge_rows, PATH), PATH, text="key")
    assert sorted(done.columns) == sorted([*edge_rows.columns, "token_ids"])
    rows = done.collect()
    assert len(rows) == edge_rows.count()
    for r in rows:
        assert r.token_ids == library.encode(r.text or "").ids and r["key"] == (r.text or "")
    for r in bpe.round_trip_documents(edge_rows, PATH, ids="row", decoded="key").collect():
        assert r["row"] == library.encode(r.text or "").ids and r["key"] == (r.text or "")
    assert bpe.encode_documents(no_rows, PATH).count() == bpe.round_trip_documents(no_rows, PATH).count() == 0


def test_query_equals_the_library(spark, library):
    """The query's own digests, on every document of the table."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_bpe"](spark, sf).collect()} == want


def test_lists_that_are_null_or_unknown(spark):
    df = spark.createDataFrame([(None,), ([],), ([464],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode_documents(df, PATH).collect()] == [None, "", "The"]
    with pytest.raises(Exception, match="no token of such an id"):
        bpe.decode_documents(spark.createDataFrame([([60000],)], "token_ids array<int>"), PATH).collect()


def test_other_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file, pytest.raises(ValueError):
        bpe.Vocabulary(file.read())
