"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

All of it is SQL functions.  A regex is run over a text as a split and as an
extraction; both find the same matches, and the lengths of pieces and matches
add up to the places of the matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, unpacked
from veilframe.operators.steps import compute_once

#: Spans of an added kind are kept from this score on.
LEAST_SCORE = 0.5
#: Shannon entropy of a secret's characters; 40 random hexadecimal digits have about 3.7.
LEAST_BITS = 3.0
#: A context word within so many characters of a span adds so much.
NEAR, CONTEXT_GAIN = 40, 0.4
#: Pieces of a text (matches have 5 characters or more) that hold NEAR characters for sure.
PIECES = 2 * NEAR // 5 + 1
#: Elements that a running sum handles at a time.
RUN = 512


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Do the digits of a number have a valid Luhn sum?"""
    def weigh(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    terms = F.transform(F.split(F.reverse(digits(number)), ""), weigh)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Is the number, its first four characters put last, 1 modulo 97?"""
    plain = F.upper(F.replace(iban, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def varied(secret: Column) -> Column:
    """Does a string look drawn at random: letters and digits mixed, LEAST_BITS of entropy by character?"""
    size = F.length(secret).cast("double")

    def weigh(total: Column, c: Column) -> Column:
        share = (size - F.length(F.replace(secret, c, F.lit("")))) / size
        return total - share * F.log2(share)

    # two classes first: long words of letters need no count
    mixed = secret.rlike("[0-9]") & secret.rlike("[A-Za-z]")
    return F.when(mixed, F.aggregate(F.array_distinct(F.split(secret, "")), F.lit(0.0), weigh) >= LEAST_BITS).otherwise(F.lit(False))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _octets(ip: Column) -> Column:
    return ip.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    The pattern matches what the kind's plain definition does, leftmost and
    without overlap, but in time linear in the text: it starts only where a run
    starts, and gives nothing back.  `hint` is text that each match holds.
    """

    name: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None = None
    context: str = ""
    hint: str = ""
    base: bool = False


#: Fixed values of the IBAN registry: countries by the length of their numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As many characters as the country's numbers have, in fours, so that the word after a number is not taken."""
    ways = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = rf"(?:\x20?[A-Z0-9]{{{rest}}})" if rest else ""
        ways.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(ways)})(?![A-Za-z0-9])"


_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base kinds in the order of the report, then those that the method adds.
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", 0.9, hint="@", base=True, context="mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", 0.6, _octets, base=True, context=r"\bip\b|host|server|address|adresse"),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+", 0.6,
        lambda m: _between(F.length(digits(m)), 12, 19) & luhn(m), base=True, context="card|visa|karte|carte|tarjeta|credit|kredit",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, lambda m: _between(F.length(digits(m)), 9, 15), hint="+", base=True, context="tel|phone|call|mobil|fax"),
    Kind("iban", _iban_pattern(), 0.8, mod_97, context="iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, context="ssn|social security", hint="-"),
    Kind("passport", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", 0.2, context="passport|reisepass|passeport|pasaporte"),
    Kind(
        "local_phone", r"(?<![0-9+(])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])", 0.2,
        context="tel|phone|call|mobil|fax|telefon|téléphone|teléfono",
    ),
    Kind(
        "birth_date", r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])", 0.2,
        context=r"\bborn\b|birth|\bdob\b|geboren|geburts|\bnée?\b|naissance|nacid|nacimiento",
    ),
    Kind(
        "secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+", 0.2, varied,
        context=r"token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|passwor|passwd|credential|bearer|authorization",
    ),
)


def running_sum(lengths: Column) -> Column:
    """Sums of an array up to each element; `lengths` must be a plain column.

    In blocks, as growing one array by one element at a time would take the
    square of its length.
    """
    def grown(values: Column) -> Column:
        empty = F.array().cast("array<long>")
        step = F.aggregate(
            values, F.struct(F.lit(0).cast("long").alias("sum"), empty.alias("all")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")),
        )
        return step["all"]

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(RUN))
    blocks = F.transform(starts, lambda s: F.slice(lengths, s, F.lit(RUN)))
    before = F.concat(F.array(F.lit(0).cast("long")), grown(F.transform(blocks, total)))
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(starts)), lambda b, o: F.transform(grown(b), lambda x: x + o)))


def _matches(text: Column, kind: Kind) -> Column:
    there = text.rlike(kind.pattern)
    if kind.hint:
        there = F.contains(text, F.lit(kind.hint)) & there
    return F.when(there, F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("gaps")))


def _spans(number: int, kind: Kind) -> Column:
    """Array of (start, number, end, kind, score) from the matches and their ends."""
    found, ends, cut = F.col("found")[kind.name], F.col("ends")[kind.name], F.col("cut")[kind.name]
    rows = F.transform(F.arrays_zip(found["m"].alias("m"), ends.alias("e")), lambda r, i: F.struct(r["m"].alias("text"), r["e"].alias("end"), i.alias("i")))
    if kind.valid is not None:
        rows = F.filter(rows, lambda r: kind.valid(r["text"]))

    def span(r: Column) -> Column:
        # the match is piece 2 i + 2 of the text; so many pieces on either side hold NEAR characters
        here = 2 * r["i"] + 2
        before = F.slice(cut["tails"], F.greatest(here - PIECES, F.lit(1)), F.least(here - 1, F.lit(PIECES)))
        after = F.slice(cut["heads"], here + 1, F.lit(PIECES))
        near = F.lower(F.concat(F.right(F.array_join(before, ""), F.lit(NEAR)), F.lit(" "), F.left(F.array_join(after, ""), F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            (r["end"] - F.length(r["text"])).alias("start"), F.lit(number).alias("number"), r["end"].alias("end"),
            F.lit(kind.name).alias("kind"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"),
        )

    spans = F.transform(rows, span)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(found.isNotNull(), spans).otherwise(F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string,score:double>>"))


def report(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `pii`: an array of (start, number, end, kind, score) by start, then kind.

    Places are in code points, the end exclusive.  A span of a base kind is kept
    if its check holds; one of another kind needs LEAST_SCORE too, which only a
    checksum or a context word nearby gives.  Spans of different kinds may
    overlap.  A match that fails its check is dropped and not tried again from
    further on.

    Null and empty texts have an empty array, an empty table stays empty, and very
    long texts are searched whole, in time linear in them.  Rows and repeats stay.  `keep`
    names the columns to be carried along (by default all); one called `pii` is
    replaced.
    """
    names = docs.columns if keep is None else keep
    slim = docs.select(F.struct(*[col(n) for n in names]).alias("row"), F.coalesce(col(text), F.lit("")).alias("t"))
    found = compute_once(slim, "found", F.struct(*[_matches(F.col("t"), k).alias(k.name) for k in kinds])).drop("t")

    def lengths(k: Kind) -> Column:
        f = F.col("found")[k.name]
        return F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["m"])), f["m"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))

    def cut(k: Column, part) -> Column:
        pieces = F.flatten(F.zip_with(k["gaps"], k["m"], lambda g, m: F.array_compact(F.array(g, m))))
        return F.when(k.isNotNull(), F.transform(pieces, lambda p: part(p, F.lit(NEAR))))

    found = compute_once(found, "cut", F.struct(*[
        F.struct(cut(F.col("found")[k.name], F.right).alias("tails"), cut(F.col("found")[k.name], F.left).alias("heads")).alias(k.name) for k in kinds
    ]))
    measured = compute_once(found, "sizes", F.struct(*[lengths(k).alias(k.name) for k in kinds]))
    placed = compute_once(measured, "ends", F.struct(*[F.when(F.col("sizes")[k.name].isNotNull(), running_sum(F.col("sizes")[k.name])).alias(k.name) for k in kinds]))
    spans = F.array_sort(F.concat(*[_spans(i, k) for i, k in enumerate(kinds)]))
    done = compute_once(placed.select("row", "found", "cut", "ends"), "pii", spans)
    return unpacked(done, "row", names, pii=F.col("pii"))
