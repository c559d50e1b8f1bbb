"""Masked pseudo-likelihood of documents with a bidirectional window network.

The network predicts every word from the two words on either side: the
embeddings of the four neighbours, one hidden layer, and a two-step softmax (group of the
word, then the word in its group).  The vocabulary is the corpus' most frequent words,
counted over all documents; rarer words fall into classes by their length, and a byte model
divides the class among its spellings, so the probabilities of all words sum to one.  It is trained
in numpy, data-parallel: documents are dealt into shards by a hash of key and text, a
shard is small whatever the corpus, each improves the start weights on its documents, and
Spark averages the weights by block.  A document's score is the sum of the
conditional log-probabilities of all its words.

Neither shards nor the order within depend on how the input is partitioned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, no_cycle_collection, staged
from .dealing import parts_for

GROUPS, SIDE, DIMS, TAIL = 64, 2, 16, 64
WORDS = GROUPS * GROUPS
KNOWN = WORDS - TAIL
EDGE = WORDS  # the id of places outside the text
#: Training: rounds of averaging, rate, words a step, shards summed at once, weights a block.
ROUNDS, RATE, STEP, FAN, BLOCK = 1, 0.08, 1 << 14, 64, 1 << 14
SHAPES = {"embed": (2 * SIDE, WORDS + 1, DIMS), "hidden": (DIMS, DIMS), "group": (GROUPS, DIMS), "word": (WORDS, DIMS), "bias": (WORDS + GROUPS,)}
#: Bytes of text of a shard.
SHARD_BYTES = 16 << 20
#: Rows whose softmax is taken at once.
ROWS = 1 << 11
#: Logits stay below this, so that sums of exponentials are finite.
MOST_LOGIT = np.float32(60)
#: No weight moves further in one step.
MOST_STEP = np.float32(0.25)


#: Bytes of words: all but white space and A to Z; weight of a byte's share beside the counts of pairs.
LETTERS = np.array([x for x in range(256) if x not in b" \t\n\r\x0b\x0c" and not 65 <= x <= 90])
FIRST, PRIOR = 256, 32.0


class Vocabulary(dict):
    """Ids of known words; any other word (in UTF-8) gets the class of its length."""

    def ids(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(found < 0)
        length = np.fromiter(map(len, map(words.__getitem__, rare.tolist())), np.int32, len(rare))
        found[rare] = KNOWN + np.minimum(length, TAIL) - 1
        return found


class Spelling:
    """Probability of a word's bytes, given that it is not known and its class.

    Each byte depends on the one before (FIRST: none).  The last class holds all words of
    TAIL bytes and more: behind TAIL bytes a word ends with the same probability at each.  What
    known words would take of a class is given to the others.
    """

    def __init__(self, pairs: np.ndarray | None = None, ended: int = 0, went_on: int = 0, known: list[bytes] = ()):
        pairs = np.zeros((FIRST + 1, 256)) if pairs is None else pairs
        share = np.zeros(256)
        share[LETTERS] = pairs[:, LETTERS].sum(0) + 0.5
        share /= share.sum()
        with np.errstate(divide="ignore"):
            self.steps = np.log((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)).ravel()
        self.ends = np.log((ended + 1) / (ended + went_on + 2))
        self.goes_on = np.log((went_on + 1) / (ended + went_on + 2))
        self.left = np.zeros(TAIL)
        if known:
            taken = np.bincount(np.minimum([len(x) for x in known], TAIL) - 1, np.exp(self.log_probabilities(list(known))), TAIL)
            self.left = np.log1p(-np.minimum(taken, 1 - 1e-9))

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of each word; words are not empty."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0)
        out = np.add.reduceat(self.steps[steps_of(words, length)], np.cumsum(length) - length)
        long = length >= TAIL
        out[long] += self.ends + (length[long] - TAIL) * self.goes_on
        return out - self.left[np.minimum(length, TAIL) - 1]


def steps_of(words: list[bytes], length: np.ndarray) -> np.ndarray:
    """All bytes of the words, each as 256 times the byte before (FIRST: none) plus itself."""
    now = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(length) - length] = FIRST
    return before * 256 + now


@dataclass
class Model:
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    weights: dict[str, np.ndarray] = field(default_factory=lambda: start())
    spelling: Spelling = field(default_factory=Spelling)


def start(counts: np.ndarray | None = None, seed: int = 0) -> dict[str, np.ndarray]:
    """Start weights; the biases give each word its share of ``counts`` (equal shares without)."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    w["hidden"] += np.eye(DIMS, dtype=np.float32)
    n = (np.zeros(WORDS) if counts is None else counts).reshape(GROUPS, GROUPS) + 0.5
    w["bias"][:WORDS], w["bias"][WORDS:] = np.log(n / n.sum(1, keepdims=True)).ravel(), np.log(n.sum(1) / n.sum())
    return w


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A to Z in lower case, cut at ASCII white space."""
    return text.lower().split() if text else []


def contexts(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of the words of some texts, one after the other, the ids of the neighbours of each: two before, two behind."""
    at = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(count) + 1), count)  # a gap of SIDE places before each text
    padded = np.full(len(ids) + SIDE * (len(count) + 1), EDGE, np.int32)
    padded[at] = ids
    return np.stack([padded[at + d] for d in range(-SIDE, SIDE + 1) if d])


def ids_of(texts: list[bytes | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The ids of all words of the texts, the number of words of each text, and the words."""
    with no_cycle_collection():
        each = list(map(words_of, texts))
        words = list(chain.from_iterable(each))
        return vocabulary.ids(words), np.array(list(map(len, each)), np.int64), words


def _exp(logits: np.ndarray) -> np.ndarray:
    np.minimum(logits, MOST_LOGIT, out=logits)
    return np.exp(logits, out=logits)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each value of sorted numbers begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _order(ids: np.ndarray) -> np.ndarray:
    return np.argsort(ids.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix


def _hidden(w: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pre = w["embed"][0][around[0]]
    for i in range(1, 2 * SIDE):
        pre += w["embed"][i][around[i]]
    return pre, np.tanh(pre @ w["hidden"])


def _with_ones(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _weighed(h: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of ``h`` (with ones) at once, and the exponentials of their logits."""
    inward = np.concatenate([weight, bias[:, None]], 1).T
    free = np.abs(inward).sum(0).max() < MOST_LOGIT  # no number of h is beyond 1
    for lo in range(0, len(h), ROWS):
        at = slice(lo, min(lo + ROWS, len(h)))
        p = h[at] @ inward
        yield at, np.exp(p, out=p) if free else _exp(p)


def _log_shares(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithms of a softmax at the targets."""
    out, rows, ones = np.empty(len(h), h.dtype), np.arange(ROWS), np.ones(len(weight), h.dtype)
    for at, p in _weighed(h, weight, bias):
        out[at] = np.log(p[rows[: len(p)], target[at]] / (p @ ones))
    return out


def _expected(h: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a softmax: the mean of the weights in each row, and the sums of ``h`` (with ones) by output."""
    back, sums, outward = np.empty((len(h), weight.shape[1]), h.dtype), np.zeros((len(weight), h.shape[1]), h.dtype), _with_ones(weight)
    for at, p in _weighed(h, weight, bias):
        x = p @ outward
        share = 1 / x[:, -1:]
        np.multiply(x[:, :-1], share, out=back[at])
        sums += p.T @ (h[at] * share)
    return back, sums


def log_probabilities(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word given its neighbours."""
    order = _order(ids)
    ids = ids[order]
    h = _with_ones(_hidden(w, around[:, order])[1])
    bounds = np.searchsorted(ids, np.arange(0, WORDS + 1, GROUPS))
    out = _log_shares(h, w["group"], w["bias"][WORDS:], ids // GROUPS)
    for g in range(GROUPS):
        at, own = slice(bounds[g], bounds[g + 1]), slice(g * GROUPS, (g + 1) * GROUPS)
        if bounds[g] < bounds[g + 1]:
            out[at] += _log_shares(h[at], w["word"][own], w["bias"][own], ids[at] - g * GROUPS)
    back = np.empty(len(ids), np.float64)
    back[order] = out
    return back


def gradients(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray) -> Iterator[tuple[str, object, np.ndarray]]:
    """The gradient of the negative sum of log-probabilities: name, place in the weights, values.

    By rows, weights and biases it is what the softmax expects less what is there.
    """
    order = _order(ids)
    ids, around = ids[order], around[:, order]
    group, bounds = ids // GROUPS, np.searchsorted(ids, np.arange(0, WORDS + 1, GROUPS))
    pre, plain = _hidden(w, around)
    h = _with_ones(plain)
    back, by_group = _expected(h, w["group"], w["bias"][WORDS:])
    by_word = np.zeros((WORDS, h.shape[1]), h.dtype)
    for g in range(GROUPS):
        at, own = slice(bounds[g], bounds[g + 1]), slice(g * GROUPS, (g + 1) * GROUPS)
        if bounds[g] < bounds[g + 1]:
            more, by_word[own] = _expected(h[at], w["word"][own], w["bias"][own])
            back[at] += more
    back -= w["group"][group]
    back -= w["word"][ids]
    for sums, target in ((by_group, group), (by_word, ids)):
        first = _starts(target)
        sums[target[first]] -= np.add.reduceat(h, first, axis=0)
    found = [("group", slice(None), by_group[:, :-1]), ("bias", slice(WORDS, None), by_group[:, -1]), ("word", slice(None), by_word[:, :-1]), ("bias", slice(WORDS), by_word[:, -1])]
    back *= 1 - plain * plain
    inward = back @ w["hidden"].T
    found.append(("hidden", slice(None), pre.T @ back))
    for i in range(2 * SIDE):  # sums by word
        place = _order(around[i])
        sorted_ids = around[i][place]
        first = _starts(sorted_ids)
        found.append(("embed", (i, sorted_ids[first]), np.add.reduceat(inward[place], first, axis=0)))
    yield from found


def improve(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray, rate: float = RATE) -> None:
    """One step of gradient descent on a batch."""
    scale = np.float32(rate / np.sqrt(len(ids)))
    for name, at, values in gradients(w, ids, around):
        values *= scale
        w[name][at] -= np.clip(values, -MOST_STEP, MOST_STEP, out=values)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def count_words(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray, Spelling]:
    """The KNOWN most frequent words of all rows (ties by the word), how often each id occurs,
    and the spelling of all other words; the driver gets those numbers and counts of pairs of bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(words_of(x))
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = staged(found, "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    lengths = counted.groupBy(F.least(F.length("word"), F.lit(TAIL)).alias("size")).agg(F.sum("n").alias("n")).collect()
    known = {bytes(r.word) for r in top}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FIRST + 1) * 256, np.int64)
        ended = went_on = 0
        for b in batches:
            rare = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in known]
            if rare:
                words, n = [w for w, _ in rare], np.array([n for _, n in rare], np.int64)
                length = np.fromiter(map(len, words), np.int64, len(words))
                np.add.at(sums, steps_of(words, length), np.repeat(n, length))
                ended += int(n[length >= TAIL].sum())
                went_on += int((n * np.maximum(length - TAIL, 0)).sum())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*sums[at].tolist(), ended, went_on], pa.int64())], ["step", "n"])

    spelled = counted.mapInArrow(spell, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()  # at most 257 x 256 counts
    dropped(docs.sparkSession, counted)
    ends, steps = dict(zip(spelled["step"], spelled["n"], strict=True)), spelled[spelled["step"] >= 0]
    pairs = np.zeros((FIRST + 1) * 256)
    pairs[steps["step"].to_numpy()] = steps["n"]
    spelling = Spelling(pairs.reshape(-1, 256), int(ends.get(-1, 0)), int(ends.get(-2, 0)), sorted(known))
    counts = np.zeros(WORDS)
    for r in lengths:
        counts[KNOWN + r["size"] - 1] += r.n
    for i, r in enumerate(top):
        counts[i] = r.n
        counts[KNOWN + min(len(r.word), TAIL) - 1] -= r.n
    return Vocabulary({bytes(r.word): i for i, r in enumerate(top)}), counts, spelling


def _learner(shared, known):
    """What a shard does: improve the shared weights on its documents; one row a block of weights."""

    def learn(group: pa.Table) -> pa.Table:
        own, seen, rng = _shaped(shared.value.copy()), 0, np.random.default_rng(0)
        texts = group.sort_by([("o", "ascending"), ("text", "ascending")]).column("text").cast(pa.large_binary())
        for lo in range(0, len(texts), 256):
            ids, count, _ = ids_of(texts.slice(lo, 256).to_pylist(), known.value)
            around = contexts(ids, count)
            order = rng.permutation(len(ids))
            for i in range(0, len(ids), STEP):
                at = order[i : i + STEP]
                improve(own, ids[at], around[:, at])
            seen += len(ids)
        flat = _flat(own)
        parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)] if seen else []
        n, shard = len(parts), group.column("shard")[0].as_py() if group.num_rows else 0
        return pa.Table.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int64()), pa.array([float(seen)] * n, pa.float64()), pa.array(parts, pa.binary())], ["block", "shard", "n", "w"])

    return learn


def _added(group: pa.Table) -> pa.Table:
    """The mean of a block's weights over some shards, weighed by their words."""
    group = group.sort_by("shard")
    n = group.column("n").to_numpy()
    mean = sum(np.frombuffer(x.as_py(), np.float32) * (k / n.sum()) for x, k in zip(group.column("w"), n.tolist(), strict=True))
    return pa.Table.from_arrays([group.column("block")[:1], group.column("up")[:1], pa.array([float(n.sum())]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["block", "shard", "n", "w"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    """A model trained on every word of every row with text.

    Null text is skipped, repeated rows count as often as they stand there, texts are taken
    whole, other columns are not looked at; without words the start weights come back.
    """
    words, context = docs.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("o"), F.col(text).alias("text")), docs.sparkSession.sparkContext
    shards = parts_for(words, SHARD_BYTES)
    vocabulary, counts, spelling = count_words(words)
    model = Model(vocabulary, start(counts), spelling)
    known = context.broadcast(model.vocabulary)  # KNOWN words
    dealt = words.withColumn("shard", F.pmod(F.xxhash64("o"), F.lit(shards)))
    for _ in range(rounds):
        shared = context.broadcast(_flat(model.weights))  # fixed size
        schema, left = "block int, shard long, n double, w binary", shards
        sums = dealt.groupBy("shard").applyInArrow(_learner(shared, known), schema)
        while left > 1:
            sums, left = sums.withColumn("up", F.floor(F.col("shard") / FAN)).groupBy("block", "up").applyInArrow(_added, schema), -(-left // FAN)
        got = sorted(sums.collect(), key=lambda r: r.block)  # as many numbers as weights
        if not got:
            break
        model.weights = _shaped(np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in got]))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, log_prob`` (sum over all words) and ``mean_log_prob`` of every row.

    Null text and text without words have 0 words, sum 0 and a null mean; repeated rows get
    the same score; texts are taken whole, other columns are not looked at.
    """
    context = docs.sparkSession.sparkContext
    shared, known = context.broadcast(_flat(model.weights)), context.broadcast((model.vocabulary, model.spelling))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (vocabulary, spelling) = _shaped(shared.value), known.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ids, n, words = ids_of(b.column(1).cast(pa.binary()).to_pylist(), vocabulary)
                around = contexts(ids, n)
                p = np.concatenate([log_probabilities(w, ids[i : i + 32_768], around[:, i : i + 32_768]) for i in range(0, len(ids), 32_768)] or [np.zeros(0)])
                rare = np.flatnonzero(ids >= KNOWN)
                p[rare] += spelling.log_probabilities([words[i] for i in rare.tolist()])
                total = np.bincount(np.repeat(np.arange(len(n)), n), p, len(n)).astype(np.float64)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(total), mean], ["key", "n_words", "log_prob", "mean_log_prob"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, log_prob double, mean_log_prob double").withColumnRenamed("key", key)
