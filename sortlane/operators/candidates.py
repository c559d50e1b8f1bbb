"""Pairs of texts and dictionary words that may be near, found by equi-joins.

If a text is at most D edits away from a word and the word is cut into D + 1 segments, one segment is
untouched and stands in the text, at a place that the edits can have shifted it to.  So words are indexed
by their segments, texts are probed by the pieces that segments would be, and one hash join brings
both together; the caller's kernel then judges what is left.  ``Edits`` and ``Ratio`` tell how
many edits two lengths allow.  For windows of a longer string (``contained``), the shorter string's
segments are looked for anywhere in the longer one.

A dictionary of at most ``MOST_WORDS`` words is broadcast instead, after its size has been checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 10_000


def is_small(words: DataFrame) -> bool:
    return words.limit(MOST_WORDS + 1).count() <= MOST_WORDS


@dataclass(frozen=True)
class Edits:
    """At most ``most`` insertions, deletions and replacements."""

    most: int

    def edits(self, n: Column, m: Column) -> Column:
        return F.lit(self.most)

    def lengths(self, n: Column) -> tuple[Column, Column]:
        return n - self.most, n + self.most


@dataclass(frozen=True)
class Ratio:
    """A ratio of ``least`` percent at least: insertions and deletions up to a share of both lengths."""

    least: float

    def edits(self, n: Column, m: Column) -> Column:
        most = F.floor((n + m) * (100 - self.least) / 100 + 1e-9).cast("int")
        return most - F.pmod(n + m - most, F.lit(2))  # as even or odd as the lengths together

    def lengths(self, n: Column) -> tuple[Column, Column]:
        share = self.least / (200 - self.least)
        return F.ceil(n * share - 1e-9), F.floor(n / share + 1e-9)


@dataclass(frozen=True)
class Share:
    """Edits up to ``1 - least`` of the longer length."""

    least: float

    def edits(self, n: Column, m: Column) -> Column:
        return F.floor((1 - self.least) * F.greatest(n, m) + 1e-9).cast("int")

    def lengths(self, n: Column) -> tuple[Column, Column]:
        return F.floor(n * self.least), F.ceil(n / self.least)


def _between(low: Column, high: Column) -> Column:
    low, high = F.greatest(low.cast("int"), F.lit(0)), high.cast("int")
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def _start(i: Column, m: Column, s: Column) -> Column:
    """Where segment ``i`` of ``s`` begins in a word of ``m`` characters."""
    return F.floor(i * m / s).cast("int")


def candidates(texts: DataFrame, words: DataFrame, near: Edits | Ratio | Share) -> DataFrame:
    """Distinct ``t, w`` of ``texts`` (t) and ``words`` (w): every pair that ``near`` allows, and some others."""
    # lengths are few, so a pair of lengths is told once for each text and each word
    m, n, s, i = F.col("m"), F.col("n"), F.col("s"), F.col("i")
    cut = words.where("w is not null").distinct().withColumn("m", F.length("w"))
    cut = cut.withColumn("n", _between(*near.lengths(m))).withColumn("s", near.edits(n, m) + 1)
    index = cut.where(s <= m).select("w", "m", "s").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), s - 1)))
    index = index.select("w", "m", "s", "i", F.expr("substring(w, cast(floor(i * m / s) as int) + 1, cast(floor((i + 1) * m / s) as int) - cast(floor(i * m / s) as int))").alias("g"))
    asked = texts.where("t is not null").distinct().withColumn("n", F.length("t"))
    asked = asked.withColumn("m", _between(*near.lengths(n))).withColumn("s", near.edits(n, m) + 1)
    probe = asked.where(s <= m).withColumn("i", F.explode(F.sequence(F.lit(0), s - 1)))
    start, size = _start(i, m, s), _start(i + 1, m, s) - _start(i, m, s)
    shift = (n - m - (s - 1)) / 2, (n - m + (s - 1)) / 2
    probe = probe.withColumns({"start": start, "size": size}).withColumn("p", _between(F.ceil(F.col("start") + shift[0]), F.least(F.floor(F.col("start") + shift[1]), n - F.col("size"))))
    probe = probe.select("t", "m", "s", "i", F.expr("substring(t, p + 1, size)").alias("g")).distinct()
    found = probe.join(index, ["m", "s", "i", "g"]).select("t", "w")
    # words shorter than the segments needed: by length alone
    short = asked.where(s > m).select("t", "m", "n").join(cut.where(s > m).select("w", "m", "n"), ["m", "n"]).select("t", "w")
    return found.unionByName(short).distinct()


def contained(texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Distinct ``t, w`` where a window of the longer string may reach a ratio of ``least`` with the shorter one.

    ``least`` is 67 at least; the shorter the segments (2 characters for 75 percent), the more pairs
    remain for the kernel.
    """
    if least < 67:
        raise ValueError("segments need a ratio of 67 at least")
    share = (100 - least) / 50
    longest = int(1 / share) + 1

    def patterns(rows: DataFrame, c: str) -> DataFrame:
        m = F.length(c)
        cut = rows.where(m > 0).select(c, m.alias("m")).withColumn("s", F.floor(F.col("m") * share + 1e-9).cast("int") + 1)
        cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        return cut.select(c, "m", F.expr(f"substring({c}, cast(floor(i * m / s) as int) + 1, cast(floor((i + 1) * m / s) as int) - cast(floor(i * m / s) as int))").alias("g")).distinct()

    def grams(rows: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        every = rows.where(n > 0).select(c, n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n")))))
        every = every.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1)))
        return every.select(c, "n", F.expr(f"substring({c}, p, k)").alias("g")).distinct()

    texts, words = texts.where("t is not null").distinct(), words.where("w is not null").distinct()
    forth = patterns(texts, "t").join(grams(words, "w"), "g").where("m <= n").select("t", "w")
    back = patterns(words, "w").join(grams(texts, "t"), "g").where("m <= n").select("t", "w")
    return forth.unionByName(back).distinct()
