"""Texts for people: specifications in words, messages in parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = {"<": "below", "<=": "at most", ">": "above", ">=": "at least"}
OUTSIDE = r"(?![^<>]*(?:>|</))"  # neither in a tag nor between a flat tag and its end


def described(clauses: Column, direction: Column) -> Column:
    """An array of (indicator, op, threshold, within_days) and a direction as one sentence."""
    op = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])

    def one(c: Column) -> Column:
        reach = F.when(c["within_days"] > 0, F.concat(F.lit(" within "), c["within_days"].cast("string"), F.lit(" days"))).otherwise("")
        return F.concat(F.replace(c["indicator"], F.lit("_"), F.lit(" ")), F.lit(" "), op[c["op"]], F.lit(" "), F.format_number(c["threshold"], 2), reach)

    return F.concat(direction, F.lit(" when "), F.array_join(F.transform(clauses, one), " and "))


def message_parts(text: Column, limit: int = 3500) -> Column:
    """The text as an array of parts of at most `limit` characters; null gives null, the empty text an empty array.

    A part ends, in order of preference, at the last blank line, line end or blank within the limit that lies outside flat markup,
    else at the limit.  Line ends at the seams go; nothing else is lost.
    """
    part = f".{{1,{limit}}}"
    ways = [rf"{part}\z", rf"{part}(?=\n\n){OUTSIDE}", rf"{part}(?=\n){OUTSIDE}", rf"{part}(?<= ){OUTSIDE}", part]
    found = F.regexp_extract_all(text, F.lit("(?s)\\n*(" + "|".join(ways) + ")"), F.lit(1))
    return F.filter(found, lambda p: F.length(F.trim(p, F.lit("\n"))) > 0)


def escaped(text: Column) -> Column:
    """For markup: the three characters that would be read as such."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unfenced(text: Column) -> Column:
    """What a code fence around the whole text holds, else the text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n?(.*?)\s*```\s*$", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text), F.lit(" \n\r\t"))


def masked(text: Column, *secrets: str) -> Column:
    """The text without the secrets, none of which may be empty."""
    for secret in secrets:
        if not secret:
            raise ValueError("an empty secret")
        text = F.replace(text, F.lit(secret), F.lit("***"))
    return text
