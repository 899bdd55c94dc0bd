"""URL filters: listed rules, and a tree of path templates for what no rule fits.

Each host has a tree of path segments.  Segments that look variable become
wildcards, nodes with many rare children too, and branches that continue alike
and are labelled alike are merged into one.  Each leaf is a template; it is
rejected if the smoothed share of bad ones among its labelled addresses is high.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, row_key, saved, unpacked, whole_row
from veilframe.operators.skew import join_many_to_one
from veilframe.operators.steps import compute_once

#: (verdict, host, path) in a CASE expression; longer lists belong in a table.
MAX_RULES = 500
#: A node's children are generalised if there are so many and they have fewer addresses each.
LEAST_CHILDREN, MOST_EACH = 20, 4
#: Branches are merged up to this Jensen-Shannon divergence in bits (with allowance
#: for their size) and so many standard errors between shares.
MOST_DIVERGENCE, MOST_ERRORS = 0.05, 2.0
#: Smoothing: labelled addresses assumed beside the real ones, and the bad among them.
ASSUMED, ASSUMED_BAD = 4.0, 2.0
#: Templates from this purity on are rejected.
LEAST_PURITY = 0.8

#: Segments that are wildcards already.
VARIABLE = r"^(<[nh]>.*|\*)$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of an address; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of two equally long rules the one that comes first in the list wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules fit in an expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments of a path, those that look variable as wildcards.

    Numbers and long hexadecimal names are `<n>` and `<h>`, with the ending of a
    file kept.  Empty segments are left out.
    """
    def general(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
        stem = F.left(s, F.length(s) - F.length(ending))
        return (
            F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("<n>"), ending))
            .when(stem.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("<h>"), ending))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _generalised(nodes: DataFrame, level: int) -> DataFrame:
    """Children of nodes with many rare ones become `*` at one level."""
    at = nodes.withColumn("parent", F.array_join(F.slice("now", 1, level - 1), "/")).withColumn("seg", F.get("now", F.lit(level - 1)))
    literal = F.col("seg").isNotNull() & ~F.col("seg").rlike(VARIABLE)
    children = at.filter(literal).groupBy("host", "parent", "seg").agg(F.sum("n").alias("n"))
    open_ended = children.groupBy("host", "parent").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter((F.col("c") >= LEAST_CHILDREN) & (F.col("n") < MOST_EACH * F.col("c")))
    marked = at.join(saved(open_ended.select("host", "parent", F.lit(True).alias("open")), "open-nodes"), ["host", "parent"], "left")
    now = F.when(F.col("open") & literal, _put(level, "*")).otherwise(F.col("now"))
    return saved(marked.select("host", "shape", now.alias("now"), "n", "labelled", "bad"), "nodes")


def _put(level: int, text: str) -> Column:
    return F.transform("now", lambda s, i: F.when(i == level - 1, text).otherwise(s))


def _merged(nodes: DataFrame, level: int) -> DataFrame:
    """Literal siblings that are alike become `*` at one level.

    Siblings with the same most frequent continuation are pooled, and a branch is
    held against its pool, not against each of its siblings.
    """
    at = nodes.withColumns({
        "parent": F.array_join(F.slice("now", 1, level - 1), "/"), "seg": F.get("now", F.lit(level - 1)),
        "tail": F.array_join(F.slice("now", F.lit(level + 1), F.size("now")), "/"),
    }).filter(F.col("seg").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    branches = saved(at.groupBy("host", "parent", "seg", "tail").agg(*sums), "branches")
    totals = saved(branches.groupBy("host", "parent", "seg").agg(
        *[F.sum(c).alias(f"b_{c}") for c in ("n", "labelled", "bad")], F.count("*").alias("tails"), F.max_by("tail", F.struct("n", "tail")).alias("main")
    ), "totals")
    group = ["host", "parent", "main"]
    known = branches.join(totals, ["host", "parent", "seg"])
    pool = saved(known.groupBy(*group, "tail").agg(F.sum("n").alias("pool")), "pools")
    whole = saved(totals.groupBy(*group).agg(F.sum("b_n").alias("all"), F.sum("b_labelled").alias("all_labelled"), F.sum("b_bad").alias("all_bad")), "groups")
    p, q = F.col("n") / F.col("b_n"), F.col("pool") / F.col("all")
    joined = known.join(pool, [*group, "tail"]).join(whole, group)
    half = (p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q))) / 2
    tested = joined.groupBy("host", "parent", "seg").agg(
        (F.sum(half) + (1 - F.sum(q)) / 2).alias("divergence"), *[F.max(c).alias(c) for c in ("b_n", "b_labelled", "b_bad", "tails", "all", "all_labelled", "all_bad")]
    )

    def apart(hits: str, of: str) -> Column:
        """Standard errors between the smoothed shares of a branch and its siblings."""
        a, n, b, m = F.col(f"b_{hits}"), F.col(f"b_{of}"), F.col(f"all_{hits}") - F.col(f"b_{hits}"), F.col("all" if of == "n" else f"all_{of}") - F.col(f"b_{of}")
        share_a, share_b = (a + ASSUMED_BAD) / (n + ASSUMED), (b + ASSUMED_BAD) / (m + ASSUMED)
        both = (a + b + ASSUMED_BAD) / (n + m + ASSUMED)
        error = F.sqrt(both * (1 - both) * (1 / (n + ASSUMED) + 1 / (m + ASSUMED)))
        return F.abs(share_a - share_b) / error

    alike = tested.filter(
        (F.col("all") > F.col("b_n"))
        & (F.col("divergence") <= MOST_DIVERGENCE + F.col("tails") / (2 * F.col("b_n")))
        & (apart("labelled", "n") <= MOST_ERRORS) & (apart("bad", "labelled") <= MOST_ERRORS)
        & ~F.col("seg").rlike(VARIABLE)
    )
    marks = saved(alike.select("host", "parent", "seg", F.lit(True).alias("alike")), "alike")
    rows = nodes.withColumns({"parent": F.array_join(F.slice("now", 1, level - 1), "/"), "seg": F.get("now", F.lit(level - 1))})
    now = F.when(F.col("alike"), _put(level, "*")).otherwise(F.col("now"))
    return saved(rows.join(marks, ["host", "parent", "seg"], "left").select("host", "shape", now.alias("now"), "n", "labelled", "bad"), "nodes")


def _busy(nodes: DataFrame) -> list[int]:
    """Levels at which some host has segments to be told apart, in order.

    Where all of a host's addresses agree, or no other one goes so deep, nothing can
    be generalised or merged; a lone deep path costs no rounds.
    """
    segments = nodes.select("host", F.posexplode("shape").alias("at", "seg")).groupBy("host", "at").agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    return sorted(r.at + 1 for r in segments.filter("a <> b").select("at").distinct().collect())


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from host, shape (array) and `bad` (null: not labelled)."""
    nodes = saved(urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad")
    ).withColumn("now", F.col("shape")), "nodes")
    levels = _busy(nodes)
    for level in levels:
        nodes = _generalised(nodes, level)
    for level in reversed(levels):
        nodes = _merged(nodes, level)
    named = nodes.withColumn("template", F.concat(F.lit("/"), F.array_join("now", "/")))
    judged = named.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    purity = saved(judged.select("host", "template", ((F.col("b") + ASSUMED_BAD) / (F.col("l") + ASSUMED)).alias("purity")), "purities")
    return saved(named.select("host", "shape", "template").join(purity, ["host", "template"]).select("host", "shape", "template", "purity"), "templates")


#: Entities of HTML; the ampersand comes last, as its own may spell another.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """The text of a page's article: what follows its heading, or all where it has none, without markup."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(?:\s*<h1\b.*?</h1>)?(.*?)(?:</article>|$)", 1)
    plain = F.regexp_replace(F.when(article == "", bare).otherwise(article), "<[^>]*>", " ")
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def only_words(text: Column) -> Column:
    """A text's runs of letters and digits, one space between them; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def with_labels(
    pages: DataFrame, docs: DataFrame, html: str = "html", text: str = "text", bad: str = "bad", name: str = "bad", keep: list[str] | None = None,
    labels: DataFrame | None = None, on: str = "doc_id",
) -> DataFrame:
    """`pages` with the label of the document that has the same words, null where none has.

    `docs` has texts and their labels (1 bad, 0 good; null ones don't count), or `labels`
    has them by `on`, a column of both; only 128 bits of a text meet them then.  Of equal
    texts one that is bad makes all bad.  Texts are compared whole, by 128 bits of their
    words; pages and documents without letters and digits have no label.  Rows and
    repeats stay, an empty table stays empty.  `keep` names the columns to be carried
    along (by default all); one called like the new one is replaced.

    Pages are counted by their words before they meet the labels, and a text that very
    many pages have is spread over tasks.
    """
    names = pages.columns if keep is None else keep
    label = col(bad).cast("int").alias("bad")
    texts = docs.select(label if labels is None else col(on).alias("on"), col(text).alias("words"))
    if labels is None:
        texts = texts.filter("bad is not null")
    said = compute_once(texts, "words", only_words(F.col("words"))).filter("words <> ''").withColumn("key", row_key(F.col("words"))).drop("words")
    if labels is not None:
        said = said.join(labels.select(col(on).alias("on"), label).filter("bad is not null"), "on")
    labelled = said.groupBy("key").agg(F.max("bad").alias("bad"))
    keyed = saved(pages.select(F.struct(*[col(n) for n in names]).alias("row"), row_key(only_words(page_text(col(html)))).alias("key")), "keyed-pages")
    known = saved(keyed.groupBy("key").agg(F.lit(1).alias("one")).join(labelled, "key", "left").select("key", "bad"), "text-labels")
    return unpacked(join_many_to_one(keyed, known, ["key"]), "row", names, **{name: F.col("bad")})


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", labels: str | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict, template and purity.

    The verdict is that of the longest rule that fits, else `block` for a rejected
    template and `allow` for any other.  A template is learnt from the addresses
    that have a label: the column `labels` (1 bad, 0 good) if it is named and not
    null, else the verdict of a rule.  Templates without labels are not rejected.

    A null address, or one without `://`, has an empty host and path and the
    template `/`.  Rows, repeats and other columns stay; columns called like the
    new ones are replaced.
    """
    host, path = host_and_path(col(url))
    known = F.lit(None).cast("int") if labels is None else col(labels).cast("int")
    parsed = pages.select(whole_row(pages).alias("row"), host.alias("host"), path.alias("path"), known.alias("known"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("row", "host", "path", "known", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    bad = F.coalesce("known", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    found = templates(ruled.select("host", "shape", bad.alias("bad")))
    joined = ruled.join(found, ["host", "shape"], "left")
    method = F.when(F.col("purity") >= LEAST_PURITY, "block").otherwise("allow")
    return unpacked(
        joined, "row", pages.columns,
        host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.coalesce("ruled", method), template=F.col("template"), purity=F.col("purity"),
    )
