import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `row` string, key string, id string, t string, h long, fp long,"
    " found string, `a.b` string, url string, html string, page_id long, none int, w string, spans string, stretch int, `next` string"
)
LONG = "Alpha beta gamma, delta. " * 12_000 + "\n" + "word\n" * 2_000


@pytest.fixture(scope="session")
def edge_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing names."""

    def row(doc_id, text, lang="en", source="a"):
        rest = ("r", "k", "i", "t", 1, 2, "f", "dot", "http://h.org/a/1", text, doc_id, 0, "w", "s", 1, "n")
        return (doc_id, text, lang, source, None if text is None else len(text), *rest)

    rows = [
        (None,) * 21, row(1, ""), row(2, "one two three"), row(2, "one two three"), row(2, "another text"), row(3, LONG), row(4, LONG),
        row(None, "one two three"), row(None, "no id here", None, None), row(5, " \t\n "), row(6, None), row(7, "a\nb\nc\nd"), row(8, "x\na\nb\nc\ny"), row(9, "😀 é\r\nü"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(edge_rows):
    return edge_rows.limit(0)
