"""Similarity measures as expressions over two text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels
from .text import let


def chars(text: Column) -> Column:
    """The characters of a text; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ngrams(text: Column, n: Column) -> Column:
    """All n-grams of a text in order; none where it is shorter.

    Slices of the array of characters: a substring would walk from the text's start.
    """
    return let(chars(text), lambda c: F.when((F.size(c) >= n) & (n >= 1), F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>")))


def gram_set(text: Column, n: Column) -> Column:
    """The distinct n-grams of a text as 64-bit hashes: set functions on longs use a
    hash set, those on texts compare all with all."""
    return F.array_distinct(F.transform(ngrams(text, n), lambda g: F.xxhash64(g)))


def gram_count(text: Column, n: int) -> Column:
    """How many distinct n-grams a text has; of null none.  An Arrow function: built-in ones make each gram a text."""
    return F.pandas_udf(lambda s: s.map(lambda t: kernels.gram_count(t or "", n)), "long")(text)


def ngram_size(length: Column, use: str) -> Column:
    """The n-gram length for texts of a length."""
    low, high, sizes = (50, 200, (2, 3, 4)) if use == "overlap" else (100, 500, (3, 5, 7))
    return F.when(length < low, sizes[0]).when(length < high, sizes[1]).otherwise(sizes[2])


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of n-gram sets; n shrinks to half the shorter text."""
    size = F.least(F.lit(n), F.floor(F.least(F.length(a), F.length(b)) / 2)).cast("int")
    sets = F.struct(gram_set(a, size).alias("x"), gram_set(b, size).alias("y"))

    def measure(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["x"], s["y"]))
        return shared / (F.size(s["x"]) + F.size(s["y"]) - shared)

    plain = F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0) | (size < 1), 0.0)
    return plain.otherwise(let(sets, measure))


def inclusion(a: Column, b: Column) -> Column:
    """Characters of the shorter text found in the longer one, over the longer length."""
    first = F.length(a) >= F.length(b)
    longer, shorter = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    known = F.array_distinct(chars(longer))
    hits = F.size(F.filter(chars(shorter), lambda c: F.array_contains(known, c)))
    return F.when(F.length(longer) == 0, 1.0).otherwise(hits / F.length(longer))


def char_frequency(a: Column, b: Column) -> Column:
    """Common characters with their counts, over those of a plus those only in b (A2)."""
    x, y = chars(a), chars(b)
    count = lambda whole, c: F.size(F.filter(whole, lambda d: d == c))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, c: acc + F.least(count(x, c), count(y, c)))
    extra = F.size(F.filter(y, lambda c: ~F.array_contains(x, c)))
    total = F.size(x) + extra
    return F.when(total > 0, common / total).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the Levenshtein distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def suspicious_rewrite(before: Column, after: Column) -> Column:
    """Whether a rewritten text strays: similarity below .5 or length ratio off."""
    ratio = F.length(after) / F.length(before)
    return (edit_similarity(before, after) < 0.5) | (ratio < 0.8) | (ratio > 1.5)
