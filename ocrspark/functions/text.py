"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ocrspark import pins

PUNCT = r"[\p{P}\p{S}]"


def norm(text: Column, punct: bool = True, cap: bool = True) -> Column:
    """Form in which two words are compared: without punctuation, without case."""
    if punct:
        text = F.regexp_replace(text, PUNCT, "")
    return F.lower(text) if cap else text


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    space = pins.TRIM_CLASS
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def parse_int(text: Column) -> Column:
    """Leading integer of a string, NULL if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def parse_float(text: Column) -> Column:
    """Leading decimal number of a string, NULL if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def smart_quotes(text: Column) -> Column:
    """Straight quotes to curly: opening at the start or after a blank or bracket, else closing."""
    text = F.regexp_replace(text, r"(^|[\s(\[{])" + '"', "$1“")
    text = F.regexp_replace(text, '"', "”")
    text = F.regexp_replace(text, r"(^|[\s(\[{\x{201c}])'", "$1‘")
    return F.regexp_replace(text, "'", "’")


def capitalise(text: Column) -> Column:
    """First letter upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
