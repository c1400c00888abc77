"""Column functions for text, identity and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


# What extraction leaves in a text, in the order in which it is mended.
REPAIRS = [
    (r"\r\n?", "\n"),  # line ends
    ("\u00a0", " "),  # hard spaces
    (r"(?U)(\w)-\n(\w)", "$1$2"),  # words broken by a hyphen at a line's end
    (r"(?U)\n\s*\d+\s*\n", "\n"),  # lines with a page number only
    ("[.·…]{3,}", " "),  # dot leaders
    (r"(?U)(?:\n\s*\.\s*){2,}\n", "\n"),  # leaders spread over lines
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


def normalise_document(c: Column) -> Column:
    """The text with what ``REPAIRS`` lists mended, and trimmed."""
    for pattern, to in REPAIRS:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def is_substantive(c: Column, least: int = 80, share: float = 0.45) -> Column:
    """Enough letters, and enough of them among all characters, to be prose."""
    n = letters(c)
    return (n >= least) & (n >= share * F.greatest(F.length(c), F.lit(1)))


@F.pandas_udf(StringType())
def nfkd(c: pd.Series) -> pd.Series:
    """Unicode's compatibility decomposition, which Spark has no function for."""
    return c.str.normalize("NFKD")


def fold_quote(c: Column) -> Column:
    """Decomposed (only texts that are not ASCII are sent to a Python worker for it, as
    others are null there), curly quotes and dashes to ASCII, other punctuation to
    space, spaces collapsed, lower case."""
    c = F.coalesce(nfkd(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)
    c = F.when(c.rlike("[‘’“”–—]"), F.translate(c, "‘’“”–—", "''\"\"--")).otherwise(c)
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_'\"-]+", " ")))  # white space is among these


#: Words that are no terms.
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "be", "as", "by", "with"]


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def content_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def safe_title(c: Column, default: str = "Untitled document", most: int = 200) -> Column:
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?i)\.pdf$", "")
    base = F.substring(collapse_whitespace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")), 1, most)
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(default))


def section_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(Section [0-9]+[A-Z]?)", 1), F.lit(""))
