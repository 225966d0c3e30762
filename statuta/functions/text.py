"""Column builders on text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One run of whitespace, with line breaks, tabs and no-break spaces.
BLANKS = r"(?U)\s+"
#: What separates words: a word is a longest run of letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"


def squeezed(text: Column) -> Column:
    """Every run of whitespace becomes one blank and the ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def words(text: Column) -> Column:
    """The lower-cased words in order; an empty array for null, empty and wordless texts."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def approx_tokens(text: Column, factor: float = 1.35) -> Column:
    """floor(factor x whitespace-separated words), at least 1."""
    plain = squeezed(F.coalesce(text, F.lit("")))
    count = F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))
    return F.greatest(F.lit(1), F.floor(count * F.lit(factor)).cast("int"))


def file_stem(path: Column) -> Column:
    """A file's name without directories, trimmed and lower-cased; null if nothing is left."""
    name = F.lower(F.trim(F.regexp_extract(F.regexp_replace(path, BLANKS, " "), r"([^/\\]*)$", 1)))
    return F.when(name != "", name)
