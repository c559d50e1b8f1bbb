"""Similarity of short strings, as column expressions.

``ratio`` is 200 times the longest common subsequence over the sum of the lengths.  The subsequence
is counted bit-parallel in one fold: each dictionary word carries a map from
character to the bits of its places (``masks``), BITS places a number, so a pair costs one step for each
character of the other string and number of the word.  Strings may have any length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Places in a number: two of them and a carry still fit in 63 bits.
BITS = 62


def _power(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _numbers(length: Column) -> Column:
    """0, 1, ... for each number that ``length`` places take, 0 at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(length / BITS).cast("int") - 1, F.lit(0)))


def masks(word: Column) -> Column:
    """Character -> bits of its places in the word, as an array of numbers."""
    chars, none = characters(word), F.lit(0).cast("long")
    bits = lambda c, k: F.aggregate(F.transform(F.slice(chars, k * BITS + 1, BITS), lambda d, i: F.when(d == c, _power(i)).otherwise(none)), none, lambda a, b: a.bitwiseOR(b))
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.transform(_numbers(F.size(chars)), lambda k: bits(c, k)))))


def common_length(text: Column, mask: Column, length: Column, wide: bool = True) -> Column:
    """Length of the longest common subsequence of ``text`` and the word behind ``mask``.

    Without ``wide`` words have BITS characters at most (see ``any_wide``), which makes the expression smaller.
    """
    none = F.lit(0).cast("long")

    def step(s, c):
        u = s.bitwiseAND(F.coalesce(F.get(F.try_element_at(mask, c), F.lit(0)), none))
        return (s + u).bitwiseOR(s - u).bitwiseAND(full)

    full = _power(length) - 1
    short = F.bit_count(full) - F.bit_count(F.aggregate(characters(text), full, step))

    if not wide:
        return short
    # longer words: one number after the other, with the carry of the addition
    full_ones = F.transform(_numbers(length), lambda k: _power(F.least(F.lit(BITS), length - k * BITS)) - 1)

    def add(s, m):
        def one(acc, k):
            own = F.get(s, k)
            u = own.bitwiseAND(F.get(m, k))
            total = own + u + acc["carry"]
            return F.struct(F.shiftright(total, BITS).alias("carry"), F.array_append(acc["out"], total.bitwiseOR(own - u).bitwiseAND(F.get(full_ones, k))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), F.struct(none.alias("carry"), F.array().cast("array<long>").alias("out")), one)["out"]

    def wide_step(s, c):
        m = F.try_element_at(mask, c)
        return F.when(m.isNull(), s).otherwise(add(s, m))

    left = F.aggregate(F.aggregate(characters(text), full_ones, wide_step), F.lit(0), lambda n, x: n + F.bit_count(x))
    return F.when(length <= BITS, short).otherwise(length - left)


def any_wide(words: DataFrame, column: str) -> bool:
    """Is a word of more than BITS characters among them?"""
    return not words.where(F.length(column) > BITS).isEmpty()


def ratio(text: Column, word: Column, mask: Column | None = None, wide: bool = True) -> Column:
    """0 to 100; 100 for two empty strings."""
    total = F.length(text) + F.length(word)
    lcs = common_length(text, masks(word) if mask is None else mask, F.length(word), wide)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs / total)


def may_reach(text: Column, word: Column, least: float) -> Column:
    """A cheap condition that holds for every pair whose ratio is at least ``least``:
    bounds by the lengths, and by the edit distance, which insertions and deletions bound."""
    a, b = F.length(text), F.length(word)
    share = least / (200 - least)
    return (F.least(a, b) >= share * F.greatest(a, b) - 1e-9) & (F.levenshtein(text, word) <= F.floor((100 - least) * (a + b) / 100 + 1e-9))


def partial_ratio(text: Column, word: Column, wide: bool = True) -> Column:
    """The best ratio of the shorter string with a window of the longer one, windows
    that hang over either end included."""
    short, long = F.when(F.length(text) <= F.length(word), text).otherwise(word), F.when(F.length(text) <= F.length(word), word).otherwise(text)
    pair = F.struct(short.alias("s"), long.alias("l"), F.length(short).alias("m"), F.length(long).alias("n"), masks(short).alias("k"))

    def best(p):
        at = F.sequence(1 - p["m"], p["n"] - 1)
        window = lambda i: F.substring(p["l"], F.greatest(i, F.lit(0)) + 1, F.least(i + p["m"], p["n"]) - F.greatest(i, F.lit(0)))
        score = lambda w: F.lit(200.0) * common_length(w, p["k"], p["m"], wide) / (p["m"] + F.length(w))
        return F.array_max(F.transform(at, lambda i: score(window(i))))

    return F.when(F.length(short) == 0, F.when(F.length(long) == 0, 100.0).otherwise(0.0)).otherwise(F.get(F.transform(F.array(pair), best), F.lit(0)))


def partial_may_reach(text: Column, word: Column, least: float) -> Column:
    """A cheap condition that holds for every pair whose partial ratio is at least ``least``: so many characters of the
    shorter string must be found in the longer one."""
    first = F.length(text) <= F.length(word)
    short, long = F.when(first, text).otherwise(word), F.when(first, word).otherwise(text)
    return F.size(F.filter(characters(short), lambda c: F.contains(long, c))) >= least / (200 - least) * F.length(short) - 1e-9


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 0 if either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def common_characters(a: Column, b: Column) -> Column:
    """Characters that both strings have, with repeats: no matching blocks can hold more."""

    def take(acc, c):
        at = F.position(c, acc["rest"])
        rest = F.concat(F.left(acc["rest"], at - 1), F.substr(acc["rest"], at + 1))
        return F.when(at > 0, F.struct((acc["n"] + 1).alias("n"), rest.alias("rest"))).otherwise(acc)

    return F.aggregate(characters(a), F.struct(F.lit(0).alias("n"), b.alias("rest")), take)["n"]


def blocks_may_reach(a: Column, b: Column, least: float) -> Column:
    """A cheap condition that holds wherever ``matching_blocks_ratio`` is at least ``least``: lengths first, then characters."""
    total = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= least * total - 1e-9) & (2 * common_characters(a, b) >= least * total - 1e-9)


def matching_characters(a: str, b: str) -> int:
    """Characters in matching blocks: those of the longest common substring (the first in ``a``, then in ``b``), and
    of the parts to its left and to its right alike."""
    found, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        lo, hi, left, right = parts.pop()
        size, at, to, before = 0, lo, left, {}
        for i in range(lo, hi):
            runs = {}
            for j in range(left, right):
                if a[i] == b[j]:
                    runs[j] = k = before.get(j - 1, 0) + 1
                    if k > size:
                        size, at, to = k, i - k + 1, j - k + 1
            before = runs
        if size:
            found += size
            parts += [(lo, at, left, to), (at + size, hi, to + size, right)]
    return found


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over the sum of lengths, 1 for two empty strings."""
    share = lambda x, y: 2.0 * matching_characters(x, y) / (len(x) + len(y)) if x or y else 1.0
    return pd.Series([None if x is None or y is None else share(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_masks(words: DataFrame, column: str) -> DataFrame:
    """A dictionary with the bit masks of its lower-cased words."""
    return words.withColumn("low", F.lower(column)).withColumn("mask", masks(F.col("low")))
