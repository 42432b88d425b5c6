"""Names of organisations and places in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B, E

#: Long forms and their abbreviations.
ABBREVIATIONS = (("street", "st"), ("avenue", "ave"), ("drive", "dr"), ("road", "rd"), ("court", "ct"))
LEGAL_FORM = r"(?i)" + B + r"(LLC|L\.L\.C\.|Inc\.|Incorporated|Corp\.|Corporation|Company|Co\.|LP|LLP|PLLC)"


def address(text: Column) -> Column:
    out = F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("."), F.lit("")), F.lit(","), F.lit(" ")), r"\s+", " ")
    for long, short in ABBREVIATIONS:
        out = F.regexp_replace(out, f"{B}{long}{E}", short)
    return F.trim(out)


def organisation(text: Column) -> Column:
    """Lower case, without a legal form at the end, other signs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+(llc|inc|corp|corporation|co\.?)$", ""), "[^a-z0-9]+", " "))


def legal_form(text: Column) -> Column:
    found = F.replace(F.regexp_extract(text, LEGAL_FORM, 1), F.lit("."), F.lit(""))
    return F.when(found != "", found)


def overlap(a: Column, b: Column) -> Column:
    """Whether b holds at least three, or all if fewer, of the words of over two letters of address a."""
    words = F.array_distinct(F.filter(F.split(address(a), " "), lambda w: F.length(w) > 2))
    hits = F.size(F.filter(words, lambda w: address(b).contains(w)))
    return (F.size(words) > 0) & (hits >= F.least(F.lit(3), F.size(words)))
