import hashlib
import random
import re
from collections import Counter

from veilframe.llm import pii
from veilframe.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(kind, m.group()))


def base(row):
    return [(s.start, s.number, s.end, s.kind) for s in row.pii if s.number < 4]


def test_base_kinds_against_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "c-d", ".com", "1", "22", "255", "256.", ".", " ", "  ", "-", "+", "4111111111111111", "(", ")", "é", "😀", "\n", "4111 1111 1111 1111", "1.2.3.4", "%", "_", " 00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["1" * 20_000 + "x", "a" * 50_000 + "@", "4111 1111 1111 1111 " * 1500, "a@b.co " * 1500, "+1" * 5000, "-".join("1" * 20_000), "1." * 9000, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for r in pii.find_personal_data(df).collect():
        assert base(r) == brute(r.text), (r.text or "")[:200]
        assert [(s.start, s.number) for s in r.pii] == sorted((s.start, s.number) for s in r.pii)


def test_query_digests(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_pii"](spark, sf).collect():
        found = brute(texts[r.doc_id])
        n = Counter(k for *_, k in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        listed = [f"{k}:{a}:{b}" for a, _, b, k in found]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}


CASES = [
    ("DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", ["iban", "iban"]),
    ("DE88 3704 0044 0532 0130 00", []),
    ("BE68 5390 0754 7034 BANK", ["iban"]),
    ("NO93 8601 1117 947 AND FR14 2004 1010 0505 0001 3M02 606", ["iban", "iban"]),
    ("DE89370400440532013000X", []),
    ("ZZ68 5390 0754 7034", []),
    ('token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', ["secret"]),
    ("commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", []),
    ("api_key: AKzb4Qw9+/XyTr82LmPq==", ["secret"]),
    ("token aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", []),
    ("the token ofaverylongwordwithoutanynumbers", []),
    ("my SSN is 123-45-6789", ["ssn"]),
    ("part 123-45-6789", []),
    ("Passport AB1234567 and lot AB1234567", ["passport", "passport"]),
    ("lot AB1234567", []),
    ("call (736) 555-2678", ["local_phone"]),
    ("born 1990-01-02", ["birth_date"]),
    ("on 1990-01-02", []),
]


def test_checksums_and_context(spark):
    rows = pii.find_personal_data(spark.createDataFrame([(text,) for text, _ in CASES], "text string")).collect()
    assert {r.text: [s.kind for s in r.pii] for r in rows} == dict(CASES)


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(1, "card 4111111111111111"), (2, "4111111111111111")], "doc_id long, text string")
    score = {r.doc_id: r.pii[0].score for r in pii.find_personal_data(df).collect()}
    assert score[1] > score[2]


def test_running_sum(spark):
    df = spark.sql("select transform(sequence(1, 3000), x -> cast(x % 7 as long)) a union all select cast(array() as array<long>)")
    for r in df.select("a", pii.running_sum(df.a).alias("s")).collect():
        total, want = 0, []
        for x in r.a:
            total += x
            want.append(total)
        assert r.s == want


def test_edges(edge_rows, no_rows):
    rows = pii.find_personal_data(edge_rows).collect()
    assert len(rows) == edge_rows.count() and all(base(r) == brute(r.text) for r in rows) and rows[0]["a.b"] in (None, "dot")
    assert pii.find_personal_data(no_rows).count() == 0


def test_secrets_of_the_table(spark):
    """The planted lines are found, and nothing else is called a secret."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    found = {(r.doc_id, s.start, s.end) for r in pii.find_personal_data(docs).collect() for s in r.pii if s.kind == "secret"}
    assert found == want and want


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a@b.co", 1, 2)], ["te`xt", "a`b", "c.d"])
    (row,) = pii.find_personal_data(df, text="te`xt").collect()
    assert [s.kind for s in row.pii] == ["email"] and (row["a`b"], row["c.d"]) == (1, 2)


def test_long_runs_take_linear_time(spark):
    texts = ["token " + "a1B2" * 100_000, "DE89" * 50_000, "DE89 " * 50_000, "A" * 300_000]
    rows = pii.find_personal_data(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [len([s for s in r.pii if s.kind == "secret"]) for r in sorted(rows, key=lambda r: texts.index(r.text))] == [0, 0, 0, 0]
