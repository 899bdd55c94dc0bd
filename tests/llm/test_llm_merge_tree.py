import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veilframe.llm import merge_tree
from veilframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return merge_tree.Ranks(file.read())


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


def texts():
    rng = random.Random(7)
    parts = [*"abc  \n\t'sthe1290é日語😀.,-=\\\x1c\x1f\x85\xa0   　՘₏", "<|endoftext|>", "\r\n", "   ", "'re", "\n\n", "กำ", "12", " The", "ing"]
    yield from ("", " ", "\n", "a\n", "a\n\n", "\n\n\na", " a", "  a", "a" * 5001, " " * 3000 + "x", "=-" * 2001, "-" + "=-" * 3000, "\x1c a\x1d")
    yield from ("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000))
    yield from ("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x400, 0xD7FF), rng.randint(0x10000, 0x3FFFF)])) for _ in range(20)) for _ in range(1000))
    yield "".join(rng.choice("aehstion") for _ in range(20_000))


def test_equals_the_library_and_round_trips(ranks, library):
    for text in texts():
        ids = library.encode_ordinary(text)
        assert ranks.encode(text).tolist() == ids, text[:200]
        assert ranks.decode(np.array(ids, np.int64)) == text.encode()


def test_stretches_and_full_memories(ranks, library, monkeypatch):
    monkeypatch.setattr(merge_tree, "STRETCH", 11)
    monkeypatch.setattr(merge_tree, "LEAF", 3)
    for memory in (ranks.seams, ranks.parts, ranks.by_cell):
        monkeypatch.setattr(memory, "size", 2)
    for text in list(texts())[:600]:
        ids = library.encode_ordinary(text)
        assert ranks.encode(text).tolist() == ids and ranks.decode(np.array(ids, np.int64)) == text.encode()


def test_joining_is_associative_and_equals_merging(ranks):
    rng = random.Random(1)
    for alphabet in ("ab", "=-", "the in", "aehstion", "é日"):
        for _ in range(150):
            parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))).encode() for _ in range(3)]
            a, b, c = (ranks.merged(p) for p in parts)
            whole = ranks.merged(b"".join(parts))
            assert ranks.join(ranks.join(a, b), c) == ranks.join(a, ranks.join(b, c)) == whole
            assert ranks._merged_by_queue(b"".join(parts)) == whole
            assert not whole or ranks.reduced(b"".join(parts)) == whole


def test_a_token_that_no_merge_gives():
    lines = [*((bytes([b]), b) for b in range(256)), (b"abc", 256), (b"bc", 257)]
    own = merge_tree.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in lines))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(lines), special_tokens={})
    odd = merge_tree.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in lines[:257]))
    assert odd.encode("abc abc").tolist() == [256, 32, 97, 98, 99]
    for text in ("abc", "xabc", "abcabc", " abc"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        merge_tree.Ranks(base64.b64encode(b"a") + b" 0")


def test_documents(edge_rows, no_rows, library):
    done = merge_tree.decode_documents(merge_tree.encode_documents(edge_rows, PATH), PATH, decoded="key")
    assert sorted(done.columns) == sorted([*edge_rows.columns, "token_ids"])
    rows = done.collect()
    assert len(rows) == edge_rows.count()
    for r in rows:
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r["key"]) == (r.text or "").encode()
    for r in merge_tree.round_trip_documents(edge_rows, PATH, ids="key").collect():
        text = r.text or ""
        assert np.frombuffer(r["key"], "<i4").tolist() == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert merge_tree.encode_documents(no_rows, PATH).count() == merge_tree.round_trip_documents(no_rows, PATH).count() == 0
    again = merge_tree.encode_documents(merge_tree.encode_documents(edge_rows, PATH), PATH)
    assert again.columns.count("token_ids") == 1 and again.count() == edge_rows.count()


def test_lists_that_are_null_or_unknown(spark):
    df = spark.createDataFrame([(None,), ([],), ([464],)], "token_ids array<int>")
    assert [r.decoded for r in merge_tree.decode_documents(df, PATH).collect()] == [None, b"", b"The"]
    with pytest.raises(Exception, match="no token of the id"):
        merge_tree.decode_documents(spark.createDataFrame([([60000],)], "token_ids array<int>"), PATH).collect()


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    assert got == want
