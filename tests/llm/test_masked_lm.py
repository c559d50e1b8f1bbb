"""The masked language model against a scorer that loops over words, and its gradients against differences."""

import math
import random

import numpy as np
import pytest
from conftest import DATA

from sortlane.llm import masked_lm as m
from sortlane.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, n_words int, shard int, o string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Ünï", "x" * 90, "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))), 1, 2, "x") for i in range(40)]
    rows += [(900, None, None, None, None), (None, "no id here", 1, 1, None), rows[3], (3, "other text, same id", 1, 1, ""), (901, " \t\n", 0, 0, ""), (902, "long " * 30000, 1, 1, "")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def slow_spelling(model, word):
    """Log-probability of an unknown word's bytes, byte by byte."""
    s, before, total = model.spelling, m.FIRST, 0.0
    for i, x in enumerate(word):
        total += s.steps[256 * before + x] + (s.goes_on if i >= m.TAIL else 0.0)
        before = x
    return total + (s.ends if len(word) >= m.TAIL else 0.0) - s.left[min(len(word), m.TAIL) - 1]


def slow_score(model, text):
    """Sum of log-probabilities, word by word, from the definition."""
    ids, w = [model.vocabulary.get(x, m.KNOWN + min(len(x), m.TAIL) - 1) for x in m.words_of((text or "").encode())], {k: v.astype(float) for k, v in model.weights.items()}
    total = 0.0
    for i, word in enumerate(ids):
        near = [ids[i + d] if 0 <= i + d < len(ids) else m.EDGE for d in (-2, -1, 1, 2)]
        h = np.tanh(sum(w["embed"][k, x] for k, x in enumerate(near)) @ w["hidden"])
        group = w["group"] @ h + w["bias"][m.WORDS :]
        at = word // m.GROUPS * m.GROUPS
        inner = w["word"][at : at + m.GROUPS] @ h + w["bias"][at : at + m.GROUPS]
        if word >= m.KNOWN:
            total += slow_spelling(model, m.words_of(text.encode())[i])
        total += group[word // m.GROUPS] - math.log(np.exp(group).sum()) + inner[word - at] - math.log(np.exp(inner).sum())
    return total


def test_scores_equal_brute_force(spark, docs):
    model = m.train(docs)
    rows = m.score(docs, model).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in rows:
        assert any(r.n_words == len((t or "").split()) and r.log_prob == pytest.approx(slow_score(model, t), rel=1e-3, abs=1e-3) for t in texts[r.doc_id])
        assert r.mean_log_prob == (pytest.approx(r.log_prob / r.n_words) if r.n_words else None)


def test_query_equals_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model, texts = m.train(table), {r.doc_id: r.text for r in table.collect()}
    rows = QUERIES["op6_masked_lm"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert r.log_prob == pytest.approx(slow_score(model, texts[r.doc_id]), rel=1e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in m.start(rng.integers(0, 50, m.WORDS)).items()}
    ids = np.array([5, 70, 71, 5, m.KNOWN + 3, 9, 70, 70])
    around = m.contexts(ids, np.array([5, 0, 1, 2]))
    edge = m.EDGE
    assert around.T.tolist()[4:7] == [[71, 5, edge, edge], [edge, edge, edge, edge], [edge, edge, 70, edge]]
    loss = lambda: -m.log_probabilities(w, ids, around).sum()
    total = {k: np.zeros_like(v) for k, v in w.items()}
    for name, at, values in m.gradients(w, ids, around):
        total[name][at] += values
    for name in w:
        used = np.flatnonzero(total[name].ravel())
        for at in rng.choice(used, 6):
            x, e = w[name].reshape(-1), 1e-5
            x[at] += e
            high = loss()
            x[at] -= 2 * e
            low = loss()
            x[at] += e
            assert total[name].ravel()[at] == pytest.approx((high - low) / (2 * e), rel=1e-3, abs=1e-6), name


def test_probabilities_sum_to_one(docs):
    model = m.train(docs)
    around = np.repeat(np.array([[1], [2], [3], [m.EDGE]]), m.WORDS, 1)
    assert np.exp(m.log_probabilities(model.weights, np.arange(m.WORDS), around)).sum() == pytest.approx(1, abs=1e-3)


def test_spellings_share_their_class(spark, monkeypatch):
    monkeypatch.setattr(m, "KNOWN", 40)
    rng = random.Random(7)
    common = [f"{a}{b}" for a in "abcdefgh" for b in "uvxyz"]
    rare = ["".join(rng.choice(["ba", "ne", "ro", "ti"]) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    text = " ".join(common * 20 + rare + ["q" * k for k in range(60, 90)])
    model = m.train(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    s, letters = model.spelling, [bytes([x]) for x in m.LETTERS]
    assert set(model.vocabulary) == {w.encode() for w in common}
    for words in (letters, [a + b for a in letters for b in letters]):  # all words of a class that are not known
        assert np.exp(s.log_probabilities([w for w in words if w not in model.vocabulary])).sum() == pytest.approx(1, abs=1e-9)
    row = s.steps.reshape(m.FIRST + 1, 256)
    assert np.exp(row).sum(1) == pytest.approx(1) and np.isneginf(row[:, [9, 10, 32, 65, 90]]).all()
    assert np.exp(s.ends) + np.exp(s.goes_on) == pytest.approx(1)
    shuffled = ["".join(rng.choice("jkwxz0189%") for _ in w) for w in rare]
    plain = spark.createDataFrame([(1, " ".join(rare)), (2, " ".join(shuffled)), (3, " ".join(common))], "doc_id long, text string")
    score = {r.doc_id: r.mean_log_prob for r in m.score(plain, model).collect()}
    assert score[2] < score[1] - 5 and score[2] < score[3]
    assert m.Spelling().log_probabilities([b"ab", "é".encode()]) == pytest.approx(-2 * np.log(len(m.LETTERS)))


def test_training_learns_from_every_row_whatever_the_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BYTES", 40_000)  # several shards
    monkeypatch.setattr(m, "FAN", 2)
    a, b = m.train(docs), m.train(docs.repartition(1).orderBy("doc_id"))
    assert a.vocabulary == b.vocabulary and all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
    plain = m.Model(a.vocabulary, m.start())
    better = sum(slow_score(a, r.text) - slow_score(plain, r.text) for r in docs.where("doc_id < 40").collect())
    assert better > 0
    one = m.train(spark.createDataFrame([(None, "one two three four " * 50)], "doc_id long, text string"))
    assert set(one.vocabulary) == {b"one", b"two", b"three", b"four"} and not np.array_equal(one.weights["word"], m.start()["word"])


def test_empty(spark, docs):
    empty = docs.limit(0)
    model = m.train(empty)
    assert m.score(empty, model).count() == 0 and not model.vocabulary
    assert {r.n_words for r in m.score(docs.where("doc_id = 900"), model).collect()} == {0}


def test_rows_in_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in m.start(rng.integers(0, 50, m.WORDS)).items()}
    ids = rng.integers(0, 200, 90).astype(np.int32)
    around = m.contexts(ids, np.array([50, 0, 40]))
    for scale in (1, 300):  # logits beyond the bound too
        w["word"] *= scale
        whole, total = m.log_probabilities(w, ids, around), list(m.gradients(w, ids, around))
        with monkeypatch.context() as patch:
            patch.setattr(m, "ROWS", 8)
            assert m.log_probabilities(w, ids, around) == pytest.approx(whole)
            for (_, _, a), (_, _, b) in zip(total, m.gradients(w, ids, around), strict=True):
                assert np.allclose(a, b)
