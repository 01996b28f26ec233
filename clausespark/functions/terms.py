"""Tokens, word n-grams and in-word character n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausespark.functions.text import bind

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def word_ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of ``lo`` to ``hi`` tokens, joined by one space."""

    def of_size(bound: Column, n: int) -> Column:
        if n == 1:
            return bound
        starts = F.slice(bound, F.lit(1), F.greatest(F.size(bound) - (n - 1), F.lit(0)))
        return F.transform(
            starts,
            lambda first, i: F.concat_ws(" ", first, *[F.get(bound, i + k) for k in range(1, n)]),
        )

    if (lo, hi) == (1, 1):
        return tokens
    return bind(tokens, lambda bound: F.concat(*[of_size(bound, n) for n in range(lo, hi + 1)]))


def word_char_ngrams(word: Column, lo: int, hi: int) -> Column:
    """Character n-grams of one word padded with a space on each side.

    A padded word no longer than ``n`` gives itself once and no longer n-grams after that.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)

    def of_size(n: int) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(size - n, F.lit(0)) + 1),
            lambda i: F.substring(padded, i, F.lit(n)),
        )
        if n == lo:
            return grams
        return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    parts = [of_size(n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def counted(terms: Column) -> Column:
    """Distinct terms of an array with their counts, as an array of (term, tf).

    The array is sorted; a term's count is the distance to the start of the next one. A text is
    thus counted inside its own row, before any term row is made.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

        def measured(at: Column) -> Column:
            return F.transform(
                at,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(at, k + 1), n) - start).cast("long").alias("tf"),
                ),
            )

        return F.when(n > 0, bind(starts, measured))

    return bind(F.sort_array(terms), runs)
