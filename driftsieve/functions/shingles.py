"""Text to shingles, as column expressions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, with the four separators U+001C to U+001F.
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: Characters whose full case folding is another single character than their lower case.
_SINGLE = {c: c.casefold() for c in map(chr, range(0x20000)) if c.casefold() != c.lower() and len(c.casefold()) == 1 and c.lower() == c}


@F.pandas_udf(T.StringType())
def _exact_fold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def text_or_empty(c: Column) -> Column:
    """Null is the empty text; other types are written out."""
    return F.coalesce(c.cast("string"), F.lit(""))


def casefold(c: Column, exact: bool = False) -> Column:
    """Full case folding. Without exact, the letters that fold to several are taken as they are but for sharp s, and the
    expression stays in the JVM."""
    if exact:
        return _exact_fold(c)
    folded = F.translate(F.lower(c), "".join(_SINGLE), "".join(_SINGLE.values()))
    return F.replace(folded, F.lit("ß"), F.lit("ss"))


def normalized(c: Column, exact: bool = False) -> Column:
    """Case-folded, runs of white space made one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(text_or_empty(c), exact), WHITE, " "))


def char_shingles(text: Column, size: int) -> Column:
    """All windows of `size` code points; a shorter text is its own window. The look-ahead is linear in the text;
    each match takes a whole code point."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def word_shingles(text: Column, size: int) -> Column:
    """All runs of `size` words, joined by spaces; a shorter text is one shingle."""
    # The words are bound to a lambda's variable, else they would be split anew for each run.
    runs = F.transform(
        F.array(F.split(text, " ", -1)),
        lambda w: F.when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))),
    )
    return F.element_at(runs, 1)


def shingles_of_normal(text: Column, kind: str, size: int) -> Column:
    """Shingles of a column that is normalized already."""
    if kind not in ("char", "word"):
        raise ValueError(f"unknown kind of n-gram: {kind}")
    return (char_shingles if kind == "char" else word_shingles)(text, size)


def shingles(c: Column, kind: str = "char", size: int = 20, exact: bool = False) -> Column:
    """Shingles of a raw text column, never none."""
    return shingles_of_normal(normalized(c, exact) if kind in ("char", "word") else c, kind, size)


def sanitized(c: Column) -> Column:
    """A release's name as a file name: [A-Za-z0-9_.=-], others become _, an empty one becomes shard."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(c, WHITE, " ")), r"[^A-Za-z0-9_.=-]", "_")
    return F.when(clean == "", F.lit("shard")).otherwise(clean)
