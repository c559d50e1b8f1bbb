"""Quality rules of documents and of hosts.

Each document gets rule figures.  Failures are summed by host, each host's rate is
shrunk towards the mean with a beta prior whose two parameters are fitted to the
hosts' rates by moments, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged

_WORD, _SYMBOL, _WINDOW = re.compile(WORD_PATTERN), re.compile(r"[#*$%&|<>]"), 5
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: A host goes when its shrunk failure rate is at least this.
HOST_RATE = 0.6
#: Verdicts of at most this many hosts are broadcast (a few MB); more are joined by shuffle.
BROADCAST_HOSTS = 20_000


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 5-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    dup = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen = set()
            for x in lines:
                if x in seen:
                    dup += 1
                elif _WORD.search(x):
                    seen.add(x)
    repeat = 0
    if n > _WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for x in windows:
                (twice if x in seen else seen).add(x)
            end = 0
            for i, x in enumerate(windows):
                if x in twice:
                    repeat += i + _WINDOW - max(i, end)
                    end = i + _WINDOW
    return n, chars, symbols, dup, repeat


def document_figures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host`` and the rule figures of each row; null text has none (all 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(map(figures, b.column(2).to_pylist()))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "host", *(x.split()[0] for x in FIGURES.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, host string, {FIGURES}")


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> F.Column:
    """What counts against a host: the base rules, a symbol in ten words, a repeated line
    in thirty words, or words of an unusual mean length."""
    n = F.col("n_words")
    return base_failed() | (10 * F.col("n_symbols") > n) | (30 * F.col("n_dup_lines") > n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)


def host_verdicts(rows: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, shrunk, host_ok`` from rows with ``host`` and ``failed``.

    The prior is fitted over hosts with the method of moments: the spread of their rates,
    less what sampling alone would spread them by.  Where nothing is left (or there are fewer
    than two hosts), the prior weighs nothing but the mean.  A null host is a host of its own.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    r = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count("*").alias("k"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.sum(1 / F.col("n_docs")).alias("inverse")).first()
    mean = prior.f / prior.n if prior.n else 0.0
    centre = prior.s1 / prior.k if prior.k else 0.0
    spread = (prior.s2 - prior.k * centre * centre) / (prior.k - 1) if prior.k and prior.k > 1 else 0.0
    spread -= mean * (1 - mean) * prior.inverse / prior.k if prior.k else 0.0
    strength = max(mean * (1 - mean) / spread - 1, 0.0) if spread > 1e-12 else 1e9
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk", shrunk).withColumn("host_ok", F.col("shrunk") < rate)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """Figures of each row with ``base_failed`` and ``kept``.

    Nulls in any column, repeated rows and empty tables are allowed; each row
    is judged by itself and by its host.  A very long text is read whole, with an entry for each of its
    words in one task's memory; columns besides key, text and host are not looked at, whatever their names.
    """
    rows = staged(document_figures(docs, key, text, host).withColumn("base_failed", base_failed()), "figures")
    verdicts = staged(host_verdicts(rows.withColumn("failed", rule_failed()), rate).select(F.col("host").alias("__host"), "host_ok"), "hosts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).select(F.col("doc_id").alias(key), *(x.split()[0] for x in FIGURES.split(", ")), "base_failed", "kept")
