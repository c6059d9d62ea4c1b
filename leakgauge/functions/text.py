"""Text as columns: normal forms, tokens and grams. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Unicode letters and numbers; matches what Python's word class takes.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def collapsed(c: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def word_tokens(c: Column) -> Column:
    """Words of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def n_grams(tokens: Column, n: int) -> Column:
    """Number of contiguous word n-grams, repeated ones counted."""
    return F.greatest(F.lit(0), F.size(tokens) - (n - 1))


def gram_keys(tokens: Column, n: int) -> Column:
    """64-bit key of every contiguous n-gram, in order; none where there are too few words.

    The key hashes the words themselves, so no gram text is ever built.
    """
    keys = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(n))))
    return F.when(F.size(tokens) >= n, keys).otherwise(F.array().cast("array<bigint>"))


def char_grams(c: Column, n: int) -> Column:
    """Set of contiguous character n-grams; empty for shorter text."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))


def coverage(target: Column, output: Column) -> Column:
    """Share of the set ``target`` that is in ``output``; 0 for an empty target."""
    return F.when(F.size(target) > 0, F.size(F.array_intersect(target, output)) / F.size(target)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def qa_normal(nfc: Column) -> Column:
    """Normal form for answer matching, of a text that is composed (NFC) already."""
    s = F.regexp_replace(nfc, r"[*#_`>]", " ")
    s = F.trim(F.regexp_replace(F.lower(s), SPACE, " "))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s.,:°/%-]", " ")
    return F.trim(F.regexp_replace(s, SPACE, " "))


def numbers(c: Column) -> Column:
    """Numbers with inner points or commas, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))


def legacy_normal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), SPACE, " "), r"""^[ .,;:!?"']+|[ .,;:!?"']+$""", "")


def letter_of(index: Column) -> Column:
    """0 is A, 1 is B, ...; null for null."""
    return F.when(index.between(0, 25), F.chr(index + 65))
