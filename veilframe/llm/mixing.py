"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import col, saved, unpacked, whole_row
from veilframe.operators.skew import join_many_to_one

SEED = "mix-1"
#: The steps of all sources are broadcast if there are so many at most (8 MB), and joined with salt if there are more.
BROADCAST_STEPS = 1_000_000
#: Rates above this one are refused; a source's steps grow with the square root of its rate, to 760,000 here.
MAX_RATE = 1e9
#: From this rate on steps begin twelve standard deviations below it, and not at none.
FROM_ZERO = 5_000.0
#: Copies are numbered in two steps of so many.
COPIES_AT_ONCE = 4096


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 that only depends on the parts: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _name(source: Column) -> Column:
    """A source as a join key; null is a source of its own."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def source_rates(docs: DataFrame, targets: dict[str | None, float] | None, source: str, text: str, total: float | None) -> DataFrame:
    """(source_key, rate): how often a document of each source is to be repeated on average.

    The size of a source is its characters and one more per document.
    """
    sizes = docs.groupBy(_name(col(source)).alias("source_key")).agg(
        F.sum(F.coalesce(F.length(col(text)), F.lit(0)).cast("double") + 1).alias("size")
    )
    if targets is None:
        weighted = sizes.withColumn("weight", F.sqrt("size"))
    else:
        rows = [(name is None, name or "", float(w)) for name, w in targets.items()]
        asked = docs.sparkSession.createDataFrame(rows, "none boolean, name string, weight double")
        asked = asked.select(F.struct("none", "name").alias("source_key"), "weight")
        weighted = sizes.join(asked, "source_key", "left").fillna(0.0, ["weight"])
    sums = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    whole = F.col("sizes") if total is None else F.lit(float(total))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return weighted.crossJoin(F.broadcast(sums)).select("source_key", (share * whole / F.col("size")).alias("rate"))  # one row of sums


def _log_factorial(k: Column) -> Column:
    """ln(k!) of large k, by Stirling's series."""
    return k * F.ln(k) - k + 0.5 * F.ln(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3)))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """For each source (source_key, rate) `least`, and the probabilities of at most least, least + 1 … copies, as an array.

    As far as the steps are above the grain of the uniform numbers; of the spread of
    a large rate, twelve standard deviations to either side.
    """
    spread = 12 * F.sqrt("rate") + 60
    asked = rates.select(
        "source_key", F.when(F.col("rate") > MAX_RATE, F.raise_error(F.lit(f"a document would be repeated over {MAX_RATE:.0f} times"))).otherwise(F.col("rate")).alias("rate")
    )
    least = F.when(F.col("rate") > FROM_ZERO, F.floor(F.col("rate") - spread)).otherwise(0)
    most = F.ceil(F.col("rate") + spread)
    steps = asked.select("source_key", "rate", least.alias("least"), F.explode(F.sequence(least, most)).alias("k"))
    up_to = Window.partitionBy("source_key").orderBy("k")
    before = F.when(F.col("least") > 0, _log_factorial(F.col("least").cast("double"))).otherwise(0.0)
    log_factorial = before + F.sum(F.when(F.col("k") > F.col("least"), F.ln(F.greatest("k", F.lit(1)))).otherwise(0.0)).over(up_to)
    power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.ln("rate"))
    log_p = F.when(F.col("rate") > 0, power - F.col("rate") - log_factorial).when(F.col("k") == 0, 0.0)
    each = steps.select("source_key", "rate", "least", "k", F.coalesce(F.exp(log_p), F.lit(0.0)).alias("p"))
    summed = each.select("source_key", "rate", "least", "k", F.sum("p").over(up_to).alias("c"))
    listed = summed.groupBy("source_key").agg(
        F.max("rate").alias("rate"), F.max("least").alias("least"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("steps")
    )
    return listed.select("source_key", "rate", "least", F.col("steps.c").alias("steps"))


def mix_sources(
    docs: DataFrame,
    targets: dict[str | None, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total: float | None = None,
    seed: str = SEED,
) -> DataFrame:
    """`docs` replicated so that sources have the target weights, in random order.

    A document is repeated as often as a Poisson distribution says at a number
    hashed from seed and id; the mean is the rate of its source: target share
    times `total` (characters, by default as many as there are) over its size.
    Adds `copy` (1, 2, …) and `shuffle_key`; rows are dealt out by the key and
    lie sorted by it, which is one exchange of the text and the same on every run.

    Without targets, weights are the square roots of the sizes.  With targets, a
    source that is not named gets none; None names the null source.  A null id
    is replaced by the text's digest.  Rows with the same id have the same
    number of copies.  Null and empty texts count one character; a very long text
    travels once per copy.  Columns called `copy` or `shuffle_key` are replaced.  An
    empty table stays empty.  A source so small that its documents would be repeated
    over MAX_RATE times is an error.
    """
    rates = saved(poisson_steps(source_rates(docs, targets, source, text, total)), "rates")
    ident = F.coalesce(col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(col(text), F.lit("")))))
    rows = docs.select(_name(col(source)).alias("source_key"), ident.alias("ident"), whole_row(docs).alias("row"))
    if (rates.agg(F.sum(F.size("steps") + 8)).first()[0] or 0) <= BROADCAST_STEPS:
        rated = rows.join(F.broadcast(rates), "source_key")
    else:
        rated = join_many_to_one(rows, rates, ["source_key"])
    draw = uniform(F.lit(seed), F.lit("n"), F.col("ident"))
    copies = F.col("least") + F.size(F.filter("steps", lambda c: c <= F.col("u")))
    drawn = rated.select("row", "ident", "steps", "least", draw.alias("u")).select("row", "ident", copies.alias("copies"))
    tens = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_AT_ONCE}"))).alias("ten")
    begun = drawn.filter("copies > 0").select("row", "ident", "copies", tens)
    ones = F.sequence(F.col("ten") * COPIES_AT_ONCE + 1, F.least("copies", (F.col("ten") + 1) * COPIES_AT_ONCE))
    copied = begun.select("row", "ident", F.explode(ones.cast("array<int>")).alias("copy"))
    keyed = copied.select("row", "copy", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "ident", "copy")).alias("shuffle_key"))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unpacked(dealt, "row", docs.columns, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))


ORACLE = f"""
with recursive sizes as (
  select source, sum(length(text) + 1)::double as size from documents group by source),
rates as (
  select source, sqrt(size) / (select sum(sqrt(size)) from sizes) * (select sum(size) from sizes) / size as rate from sizes),
steps(source, rate, k, log_p) as (
  select source, rate, 0, -rate from rates
  union all
  select source, rate, k + 1, log_p + ln(rate) - ln(k + 1) from steps where k < ceil(rate + 12 * sqrt(rate) + 60)),
summed as (select source, k, sum(exp(log_p)) over (partition by source order by k) as c from steps),
draws as (
  select doc_id, source, text,
         ('0x' || substr(md5('{SEED}|n|' || doc_id), 1, 13))::bigint::double / 4503599627370496.0 as u
  from documents),
counted as (
  select d.doc_id, d.source, d.text, (select count(*) from summed s where s.source = d.source and s.c <= d.u) as copies
  from draws d),
copied as (select doc_id, source, text, unnest(range(1, copies + 1)) as copy from counted)
select doc_id, source, text, copy::int as copy, md5('{SEED}|order|' || doc_id || '|' || copy) as shuffle_key from copied
"""
