import hashlib
import random
import struct
from collections import defaultdict

import pytest
import zstandard

from veilframe.llm import warc
from veilframe.workspace import workspace


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, `row` string")


def brute(rows):
    first = defaultdict(lambda: 10**9)
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first[h], i)
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        refers = first[h] if len(data) >= 100 and first[h] < 10**9 and first[h] != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def made(n):
    rng = random.Random(6)
    bodies = ["<p>" + " ".join(rng.choice(["été", "foo", "bar", "<b>x</b>", "\r\n\r\n"]) for _ in range(rng.randint(1, 200))) for _ in range(n // 2)]
    rows = [(i, rng.choice([None, "", f"http://h/{i}", "http://ü/ a\r\nb%20"]), rng.choice(bodies), "x") for i in range(n)]
    return rows + [(n, "u", None, None), (n + 1, "u", "", None), (None, None, bodies[0] * 40, None), (n + 2, "u", bodies[0] * 40, None), (n + 2, "u", bodies[0] * 40, None), (None, "u", "only " * 90, None), (None, "u", "only " * 90, None)]


@pytest.mark.parametrize("n", [4, 300])
def test_round_trip(spark, n):
    rows, path = made(n), workspace(spark, "warc-test")
    warc.write_warc(pages(spark, rows), path)
    got = warc.read_warc(spark, path).collect()
    number = lambda x: None if x is None else int(x)
    assert sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got), key=str) == brute(rows)
    texts = {(i, (h or "").encode()) for i, _, h, _ in rows}
    assert {(number(r.page_id), bytes(r.payload)) for r in got if r.record_type == "response"} <= texts
    assert {r.url for r in got} >= {None, "", "http://%C3%BC/%20a%0D%0Ab%20"} or n < 10


def test_archives_are_readable_by_other_decoders(spark):
    path = workspace(spark, "warc-test")
    warc.write_warc(pages(spark, made(300)).coalesce(1), path)
    (archive,) = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    magic, size = struct.unpack_from("<II", archive)
    assert magic == warc.DICTIONARY_FRAME
    words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(archive, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(list(warc.unpack(archive))) == 307
    packed = zstandard.ZstdCompressor().compress(archive[8 : 8 + size])
    assert list(warc.unpack(struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + archive[8 + size :])) == list(warc.unpack(archive))


def test_damage_is_noticed(spark):
    data = warc.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"payload\r", b"paYload\r"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.unpack(zstandard.ZstdCompressor().compress(data)[:-5]))


def test_edges(spark, edge_rows, no_rows):
    for df in (edge_rows, no_rows):
        path = workspace(spark, "warc-test")
        warc.write_warc(df, path)
        assert warc.read_warc(spark, path).count() == df.count()


def test_dictionary_from_different_pages(spark):
    """Copies do not crowd out the sample, and few pages are cut up."""
    rng = random.Random(7)
    few = [f"<html>{i}" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(300)) for i in range(5)]
    rows = [(i, "u", few[0 if i % 3 else i % 5], None) for i in range(3000)]
    words = warc.build_dictionary(pages(spark, rows), "html")
    assert words[:4] == struct.pack("<I", warc.DICTIONARY) and words == warc.build_dictionary(pages(spark, [(0, "u", t, None) for t in few]), "html")
    with pytest.warns(UserWarning, match="too little"):
        assert warc.train([b"x" * 50]) == b""
    assert warc.build_dictionary(pages(spark, []), "html") == b""


def test_archives_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 70_000)
    rng = random.Random(9)
    rows = [(i, "u", "".join(chr(rng.randrange(33, 1000)) for _ in range(rng.choice([10, 3000, 40_000]))), None) for i in range(60)]
    path = workspace(spark, "warc-test")
    warc.write_warc(pages(spark, rows).coalesce(2), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(files) > 8 and max(map(len, files)) < 70_000 + 80_000
    assert all(struct.unpack_from("<I", f)[0] == warc.DICTIONARY_FRAME for f in files)
    assert sorted((int(r.page_id), r.payload.decode()) for r in warc.read_warc(spark, path).collect()) == sorted((i, t) for i, _, t, _ in rows)
