"""Column functions that rewrite text: one token per match, replaced in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.catalog import TRANSFORM_NAMES


def consistent_token(salt: str, type_: Column, value: Column) -> Column:
    """First 16 hex digits of the salted hash; equal values give equal tokens."""
    return F.substring(F.sha2(F.concat_ws("_", F.lit(salt), type_, value), 256), 1, 16)


def fresh_token(nonce: str, key: Column, position: Column) -> Column:
    """Eight hex digits that differ per document and position.

    A hash of the run's nonce, not a random draw, so a retried task writes the
    same text as the lost one.
    """
    seed = F.concat_ws("_", F.lit(nonce), key.cast("string"), position.cast("string"))
    return F.substring(F.sha2(seed, 256), 1, 8)


def check_method(method: str) -> str:
    """The name itself; ValueError if it names no transformation."""
    if method not in TRANSFORM_NAMES:
        raise ValueError(f"Unknown transformation method: {method}")
    return method


def flat_matches(findings: Column) -> Column:
    """array<struct(type, value, pos)> of all matches in replacement order."""
    flat = F.flatten(
        F.transform(
            findings,
            lambda f: F.transform(
                f["matches"],
                lambda m: F.struct(F.coalesce(f["type"], F.lit("PII")).alias("type"), m.alias("value")),
            ),
        )
    )
    return F.transform(
        flat, lambda p, i: F.struct(p["type"].alias("type"), p["value"].alias("value"), i.alias("pos"))
    )


def _tagged(type_: Column, token: Column) -> Column:
    return F.concat(F.lit("["), type_, F.lit("_"), token, F.lit("]"))


def token_for(method: str | Column, pair: Column, key: Column, salt: str, nonce: str | None) -> Column:
    """What replaces one match.  Unknown or missing names mean pseudonymize."""
    made = {
        "anonymize": lambda: F.concat(F.lit("["), pair["type"], F.lit("_ANONYMIZED]")),
        "tokenize": lambda: _tagged(pair["type"], fresh_token(nonce, key, pair["pos"])),
        "mask": lambda: F.repeat(F.lit("*"), F.length(pair["value"])),
    }

    def pseudonym() -> Column:
        return _tagged(pair["type"], consistent_token(salt, pair["type"], pair["value"]))

    if isinstance(method, str):
        return made.get(method, pseudonym)()
    return (
        F.when(method == "anonymize", made["anonymize"]())
        .when(method == "tokenize", made["tokenize"]())
        .when(method == "mask", made["mask"]())
        .otherwise(pseudonym())
    )


def replacements(findings: Column, token) -> Column:
    """array<struct(pos, value, token)> in replacement order."""
    return F.transform(
        flat_matches(findings),
        lambda p: F.struct(p["pos"].alias("pos"), p["value"].alias("value"), token(p).alias("token")),
    )


def replace_in_order(text: Column, pairs: Column) -> Column:
    """Replace every occurrence of each match, one match after the other."""
    folded = F.aggregate(pairs, text, lambda acc, pair: F.replace(acc, pair["value"], pair["token"]))
    return F.when(F.size(pairs) > 0, folded).otherwise(text)
