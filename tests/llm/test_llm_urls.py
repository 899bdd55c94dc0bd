import random
import re
from collections import defaultdict

from veilframe.llm import urls
from veilframe.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.01"


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best and best[1], best and best[0]


def test_whole_table(spark):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op2_urls"](spark, SF).collect()
    assert len(rows) == len(given)
    for r in rows:
        host, path, rule, verdict = brute(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.purity >= urls.LEAST_PURITY else "allow"))


def test_labels_come_from_the_text(spark):
    """On the given pages the number in the address is that of the document shown."""
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents", "labels")}
    docs = tables["documents"].join(tables["labels"], "doc_id").selectExpr("text", "int(quality = 0 or toxic = 1) as bad")
    said, text = defaultdict(list), {r.doc_id: r.text for r in tables["documents"].collect()}
    same = lambda t: " ".join(re.findall(r"[^\W_]+", t or ""))
    for r in tables["labels"].collect():
        said[same(text.get(r.doc_id))].append(int(r.quality == 0 or r.toxic == 1))
    got = urls.with_labels(tables["pages"], docs).collect()
    assert len(got) == tables["pages"].count() and sum(r.bad is not None for r in got) > len(got) / 10
    for r in got:
        number = re.search(r"/([0-9]+)", r.url.split("://")[1])
        assert r.bad == max(said.get(same(text[int(number[1])]), [None]), key=lambda b: -1 if b is None else b)


def test_labels_of_odd_pages(spark, edge_rows, no_rows):
    pages = spark.createDataFrame([(None, 9), ("", 9), ("<p>", 9), ("<b>A&amp;B</b> c", 9), ("<script>x</script><article><h1>T</h1>a, b<!-- z --> c", 9), ("d", 9)] * 2, "html string, bad int")
    docs = spark.createDataFrame([("A b&c", 0), ("A B c", 0), ("a b c.", 1), ("a b c", 0), ("a b c", None), (None, 1), ("...", 1)], "text string, bad int")
    assert sorted(((r.html, r.bad) for r in urls.with_labels(pages, docs).collect()), key=str) == sorted(
        2 * [(None, None), ("", None), ("<p>", None), ("<b>A&amp;B</b> c", 0), ("<script>x</script><article><h1>T</h1>a, b<!-- z --> c", 1), ("d", None)], key=str
    )
    assert urls.with_labels(edge_rows, docs).count() == edge_rows.count() and urls.with_labels(no_rows, docs).count() == 0


def test_labels_by_id(spark):
    pages = spark.createDataFrame([("a b",), ("c",), ("d",), (None,)], "html string")
    docs = spark.createDataFrame([(1, "a, b"), (2, "a b!"), (3, "c"), (3, "c"), (None, "d"), (5, "d")], "n long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (3, 0), (None, 1), (9, 1)], "n long, bad int")
    got = urls.with_labels(pages, docs, labels=labels, on="n").collect()
    assert sorted(((r.html, r.bad) for r in got), key=str) == sorted([("a b", 1), ("c", 0), ("d", None), (None, None)], key=str)


def test_texts_do_not_travel_to_their_labels(spark, monkeypatch):
    """What is dealt out by a key holds no text, so the shuffle does not grow with the texts."""
    plans, save = [], urls.saved

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return save(df, name)

    monkeypatch.setattr(urls, "saved", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["op2_urls"](spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [given for plan in plans for given in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert any("key#" in given for given in dealt) and not any(re.search(r"\b(text|words|html)#", given) for given in dealt)


def test_odd_addresses(spark):
    odd = [None, "", "http:/x", "://", "a://B.NET", "a://b.net/", "a://Ünet/ÄB?x://y", "x://net/a#?", "a://b://c/d", "h://my.example.net/en/x?y", "h://xexample.com/de/", "h://org/fr/", "h://a.b.example.com/de/\nz"]
    rows = urls.judge_urls(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string"), RULES).collect()
    for r in rows:
        host, path, rule, verdict = brute(odd[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_templates(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        rows.append((f"http://a.x/user/{rng.randrange(10**6)}-{i}q/posts", None))  # names that vary
        rows.append((f"http://a.x/{rng.choice(['de', 'en', 'fr'])}/{i}.html", 0 if i % 4 == 0 else None))  # branches alike
        rows.append((f"http://a.x/spam/{i}", 1 if i % 3 == 0 else None))  # labelled bad
        rows.append((f"http://b.x/spam/{i}", None))  # another host has its own tree
    table = [(i, u, b, "r") for i, (u, b) in enumerate(rows)]
    got = urls.judge_urls(spark.createDataFrame(table, "page_id long, url string, bad int, `row` string"), (), labels="bad").collect()
    template = {r.url: r.template for r in got}
    assert {t for u, t in template.items() if "/user/" in u} == {"/user/*/posts"}
    assert {t for u, t in template.items() if ".html" in u} == {"/*/<n>.html"}
    assert {r.verdict for r in got if r.url.startswith("http://a.x/spam")} == {"block"}
    assert {r.verdict for r in got if not r.url.startswith("http://a.x/spam")} == {"allow"}
    assert all(r.rule is None for r in got)


def test_a_branch_that_is_labelled_differently_is_not_merged(spark):
    rows = [(f"http://a.x/{'de' if i % 2 else 'en'}/{i}", int(i % 2)) for i in range(80)]
    got = urls.judge_urls(spark.createDataFrame(rows, "url string, bad int"), (), labels="bad").collect()
    assert {(r.template, r.verdict) for r in got} == {("/de/<n>", "block"), ("/en/<n>", "allow")}


def test_deep_paths_and_edges(spark, edge_rows, no_rows):
    deep = spark.createDataFrame([("http://h/" + "/".join("abcdefghijkl"),)], "url string")
    assert urls.judge_urls(deep, RULES).first().template == "/" + "/".join("abcdefghijkl")
    # deep paths are judged as shallow ones are, and a lone path of very many segments costs nothing
    ends = [(f"{end}/page{i}", int(end == "spam")) for end in ("spam", "good") for i in range(100)]
    rows = [(f"http://{host}/{lead}{e}", bad) for host, lead in (("shallow", ""), ("deep", "a/b/c/d/e/f/g/h/i/")) for e, bad in ends]
    rows.append(("http://lone/" + "x/" * 3000, None))
    got = urls.judge_urls(spark.createDataFrame(rows, "url string, bad int"), (), labels="bad").collect()
    assert all((r.verdict == "block") == (r.bad == 1) for r in got)
    assert {r.template for r in got if "deep" in r.url} == {"/a/b/c/d/e/f/g/h/i/spam/*", "/a/b/c/d/e/f/g/h/i/good/*"}
    rows = urls.judge_urls(edge_rows, RULES).collect()
    assert len(rows) == edge_rows.count() and {r.template for r in rows if r.url is None} == {"/"}
    assert urls.judge_urls(no_rows, RULES).count() == 0
