"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces, found with the
forward algorithm; a text's is the product over its words (pieces never cross
words).  The piece probabilities are fitted by expectation maximisation: Spark
counts words by language, tasks find the expected pieces of their words, and the
driver gets sums of at most (pieces x languages) numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

MARK, WORD = "▁", re.compile(r"[^\W\d_]+")
#: The classifier is fitted on about this many labelled rows at most, chosen by a hash of the key.
MAX_TRAINING_ROWS = 4000
#: It knows so many labels at most, those with the most words in these rows.
MAX_LANGUAGES = 500
UNKNOWN, SMOOTHING, ITERATIONS, LONG, BLOCK = 1e-7, 200.0, 2, 40, 4000
#: Bytes of a worker's memo of words, of the forward sums of a block of words, and languages whose sums the driver takes at once.
MEMO_BYTES, FORWARD_BYTES, AT_ONCE = 64 << 20, 32 << 20, 32


class Lattice:
    """All places where pieces of the vocabulary match in words."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.automaton = ahocorasick.Automaton()
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and p == p.lower():
                if len(p) > 255:
                    raise ValueError("a piece of more than 255 characters")
                self.automaton.add_word(p, i << 8 | len(p))
        self.automaton.make_automaton()

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of each match; piece ``size`` is one character of any kind."""
        marked = [MARK + w for w in words]
        lengths = np.array([len(x) for x in marked])
        ends = np.cumsum(lengths + 1)
        got = np.array(list(self.automaton.iter("\n".join(marked))), np.int64).reshape(-1, 2)
        word = np.searchsorted(ends, got[:, 0], side="right")
        end = got[:, 0] - (ends[word] - lengths[word] - 1) + 1
        piece, n = got[:, 1] >> 8, got[:, 1] & 255
        w2 = np.repeat(np.arange(len(words)), lengths)
        e2 = np.arange(len(w2)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        word, end, n = np.concatenate([word, w2]), np.concatenate([end, e2]), np.concatenate([n, np.ones(len(w2), np.int64)])
        piece = np.concatenate([piece, np.full(len(w2), self.size)])
        return word, end - n, end, piece, lengths

    def forward(self, words: list[str], theta: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each word under each column of ``theta`` (pieces + 1, columns).

        With ``expected`` (weights of the words, one column) the expected number of
        uses of each piece is returned instead.
        """
        word, start, end, piece, lengths = self.matches(words)
        top, order = int(lengths.max()), np.argsort(end, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        bounds = np.searchsorted(end, np.arange(1, top + 2))
        f = np.zeros((top + 1, len(words), theta.shape[1]))
        f[0] = 1.0
        for e in range(1, top + 1):
            at = slice(bounds[e - 1], bounds[e])
            w, gain = word[at], f[start[at], word[at]] * theta[piece[at]]
            for c in range(theta.shape[1]):
                f[e, :, c] = np.bincount(w, gain[:, c], len(words))
        total = f[lengths, np.arange(len(words))]
        if expected is None:
            with np.errstate(divide="ignore"):
                return np.log(total)
        b = np.zeros((top + 1, len(words)))
        b[lengths, np.arange(len(words))] = 1.0
        order = np.argsort(-start, kind="stable")
        bounds = np.searchsorted(-start[order], -np.arange(top, -2, -1))
        for k, s in enumerate(range(top, -1, -1)):
            at = order[bounds[k] : bounds[k + 1]]
            if len(at):
                b[s] += np.bincount(word[at], b[end[at], word[at]] * theta[piece[at], 0], len(words))
        uses = f[start, word, 0] * theta[piece, 0] * b[end, word] * (expected / total[:, 0])[word]
        return np.bincount(piece, uses, self.size + 1)

    def long_word(self, text: str, theta: np.ndarray) -> np.ndarray:
        """The same for one word of any length, with rescaling."""
        text = MARK + text
        by_end: dict[int, list[tuple[int, int]]] = {}
        for end, code in self.automaton.iter(text):
            by_end.setdefault(end + 1, []).append((code >> 8, code & 255))
        f, scale = {0: np.ones(theta.shape[1])}, 0.0
        for e in range(1, len(text) + 1):
            x = f[e - 1] * theta[self.size]
            for piece, n in by_end.get(e, ()):
                x = x + f[e - n] * theta[piece]
            f[e] = x
            f.pop(e - 256, None)
            if (m := float(x.max())) < 1e-100:
                scale += math.log(m)
                f = {k: v / m for k, v in f.items()}
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(f[len(text)]), -1e6) + scale

    def long_uses(self, text: str, theta: np.ndarray) -> dict[int, float]:
        """Expected number of uses of each piece in one word of any length, in logarithms (``theta`` has one column)."""
        text, log = MARK + text, np.log(theta[:, 0]).tolist()
        by_end: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for e in range(1, len(text) + 1):
            by_end[e].append((self.size, e - 1))
        for end, code in self.automaton.iter(text):
            by_end[end + 1].append((code >> 8, end + 1 - (code & 255)))
        f = [0.0]
        for e in range(1, len(text) + 1):
            f.append(_log_sum([f[s] + log[piece] for piece, s in by_end[e]]))
        b: list[list[float]] = [[] for _ in text] + [[0.0]]
        uses: Counter = Counter()
        for e in range(len(text), 0, -1):  # all that begins at e is summed by now
            behind = _log_sum(b[e])
            for piece, s in by_end[e]:
                b[s].append(log[piece] + behind)
                uses[piece] += math.exp(f[s] + log[piece] + behind - f[-1])
        return uses


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


@dataclass
class LanguageModel:
    languages: list[str]
    theta: np.ndarray  # (pieces + 1, languages)
    path: str

    def scores(self, words: list[str]) -> np.ndarray:
        lat, out = lattice(self.path), np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        block = max(1, min(BLOCK, FORWARD_BYTES // (8 * (LONG + 2) * len(self.languages))))
        for lo in range(0, len(short), block):
            at = short[lo : lo + block]
            out[at] = lat.forward([words[i] for i in at], self.theta)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = lat.long_word(w, self.theta)
        return out


def letters(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    words = WORD.findall(low)
    return words if low.isascii() else [w for w in words if w.isascii() or any(map(str.isalpha, w))]


def train(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAINING_ROWS, iterations: int = ITERATIONS) -> LanguageModel:
    """Fit on rows with text and label; rows with null text or label are skipped.

    At most about ``max_rows`` rows are used: those whose key hash is below the
    share that gives this number.  Without such rows the model knows no language.
    Repeated rows count as often as they stand there, texts are taken whole, other columns
    are not looked at.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    share = min(1.0, max_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(y, Counter()).update(letters(x))
        for y, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = staged(counted, "words")
    most = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    languages = sorted(r.lang for r in most.collect())
    size = lattice(vocabulary).size
    theta = np.full((size + 1, max(1, len(languages))), 1.0 / size)
    theta[size] = UNKNOWN
    context = docs.sparkSession.sparkContext
    for _ in range(iterations if languages else 0):
        now = context.broadcast(theta)  # pieces x languages numbers

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lat, sums = lattice(vocabulary), np.zeros_like(now.value)
            for b in batches:
                langs, texts, ns = (np.array(c.to_pylist(), t) for c, t in zip(b.columns, (object, object, float), strict=True))
                for k, name in enumerate(languages):
                    at = np.flatnonzero(langs == name)
                    for lo in range(0, len(at), BLOCK):
                        part = at[lo : lo + BLOCK]
                        short = part[[len(w) <= LONG for w in texts[part]]]
                        if len(short):
                            sums[:, k] += lat.forward(list(texts[short]), now.value[:, k : k + 1], ns[short])
                        for i in part[[len(w) > LONG for w in texts[part]]]:
                            for piece, n in lat.long_uses(texts[i], now.value[:, k : k + 1]).items():
                                sums[piece, k] += n * ns[i]
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(sums[piece, k])], ["piece", "k", "n"])

        sums = staged(words.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")), "expected")
        counts = np.zeros_like(theta)
        for lo in range(0, len(languages), AT_ONCE):
            got = sums.where(F.col("k").between(lo, lo + AT_ONCE - 1)).toPandas()
            counts[got["piece"], got["k"]] = got["n"]
        dropped(docs.sparkSession, sums)
        counts[size] = 0
        shared = counts.sum(1, keepdims=True) + 0.01
        shared[size] = 0
        theta = (counts + SMOOTHING * shared / shared.sum()) / (counts.sum(0) + SMOOTHING)
        theta[size] = UNKNOWN
    dropped(docs.sparkSession, words)
    return LanguageModel(languages, theta, vocabulary)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of each row; ``und`` and 0 without a letter (or text).

    ``score`` is the posterior of the predicted language with equal priors; ties go
    to the first name in alphabetical order.  Null and repeated keys are kept, each row is
    judged by its whole text, and other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.languages)
        place: dict[str, int] = {}
        values = np.zeros((max(1, MEMO_BYTES // (8 * max(1, width))), max(1, width)))

        def sums_of(texts: list[list[str]]) -> np.ndarray:
            """The sum over the words of each text; more words than the memo holds are taken in parts."""
            nonlocal place
            new = list({w for x in texts for w in x if w not in place})
            if len(place) + len(new) > len(values):  # the memo is full: begin again
                place, new = {}, list({w for x in texts for w in x})
            if len(new) > len(values):
                if len(texts) > 1:
                    return np.concatenate([sums_of([x]) for x in texts])
                return sum(sums_of([texts[0][lo : lo + len(values)]]) for lo in range(0, len(texts[0]), len(values)))
            if new:
                values[len(place) : len(place) + len(new)] = m.scores(new)
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            return np.array([sum_rows(x) for x in texts])

        def sum_rows(x: list[str]) -> np.ndarray:
            at = np.fromiter(map(place.__getitem__, x), np.int64, len(x))
            return sum(values[at[lo : lo + len(values)]].sum(0) for lo in range(0, len(at), len(values)))

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                texts = [letters(x) if width else [] for x in b.column(1).to_pylist()]
                total = sums_of([x for x in texts if x]) if any(texts) else np.zeros((0, 1))
                best, row = total.argmax(1), iter(range(len(total)))
                top = np.take_along_axis(total, best[:, None], 1)
                score = 1.0 / np.exp(total - top).sum(1)
                at = [next(row) if x else None for x in texts]
                langs = ["und" if i is None else m.languages[best[i]] for i in at]
                scores = [0.0 if i is None else float(score[i]) for i in at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
