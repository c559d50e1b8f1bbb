"""Ranked search and hard negatives against brute force, on odd rows and in many blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sortlane.llm import negatives, ranked


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(key, Counter(terms(t))) for key, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df, out = Counter(t for _, b in bags for t in b), []
    for item, text in items:
        scores = []
        for key, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def words(rng, n, size):
    return " ".join(f"w{min(int(rng.expovariate(1 / size)), 400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randint(1, 120), 40)) for i in range(700)]
    items = [(i, words(rng, rng.randint(1, 30), 60)) for i in range(40)]
    docs += [(700 + i, f"{words(rng, 5, 40)} {items[i % 12][1]} {words(rng, 8, 40)}") for i in range(60)]  # passages of items
    docs += [(1000 + i, "The SAME copy, w1 w2 W3!") for i in range(300)]  # ties
    docs += [(None, "no key w1 w2"), (None, None), (900, None), (901, ""), (902, "..."), (903, "x" * 100_000 + " w5 " * 50_000), (5, docs[5][1]), (5, "w7 w7"), (904, "Ärger ΑΣ été w3"), (905, "\x00a\x7fb{w4}")]
    items += [(None, "w1 no key"), (50, None), (51, "!"), (52, "ÄRGER Ärger été unseen"), (53, "w7 w7 w7"), (53, "w3 copy"), (54, "w5 a b " * 300)]
    return docs, items


def test_search_equals_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    rows = spark.createDataFrame([(k, t, "e", 1) for k, t in docs], "doc_id long, text string, item string, score int").repartition(4)
    asked = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, length int")
    want = brute_search(docs, items)
    for bucket, first, entries, block in ((1024, 4096, 1 << 20, 4 << 20), (16, 32, 400, 300)):
        for name, x in (("BUCKET", bucket), ("FIRST", first), ("ENTRIES", entries), ("BLOCK_BYTES", block)):
            monkeypatch.setattr(ranked, name, x)
        got = ranked.search(rows, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert ranked.search(rows.limit(0), asked).count() == ranked.search(rows, asked.limit(0)).count() == 0
    assert ranked.search(rows.where("text is null"), asked).count() == 0


def test_bounds_prune_and_keep_what_counts(corpus):
    """Feasible ranges drop rows, but none that reaches the angle."""
    rng, w = np.random.default_rng(5), np.full(30, 900, np.int64)
    dropped = 0
    held = [np.sort(rng.choice(30, rng.integers(1, 5), replace=False)) for _ in range(3000)]
    impact = [rng.integers(1, 10**6, len(x)) for x in held]
    length = np.array([math.sqrt(sum(900 * float(y) ** 2 for y in x)) for x in impact])
    order = np.argsort(-length)
    for lo in range(0, 3000, 50):
        part = order[lo : lo + 50]
        bucket = ranked.Bucket(length[part], np.cumsum([0, *(len(held[i]) for i in part)]), np.concatenate([held[i] for i in part]), np.concatenate([impact[i] for i in part]), w)
        query = ranked.Query(np.sort(rng.choice(30, 2, replace=False)), rng.integers(1, 4, 2), w)
        score = bucket.scores(query)
        for least in np.quantile(score, [0.5, 0.9, 1.0]):
            fits = bucket.feasible(query, least / (query.length * bucket.longest) - ranked.SLACK)
            if fits is not None:
                assert fits[score >= max(least, 1)].all()
                dropped += int((~fits).sum())
    assert dropped > 1000


def brute_negatives(rows, k=5, percent=80):
    fine = [(i, key, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, (key, v, label) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, order = [], lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, key, v, label in fine:
        if key is None or key % 100:
            continue
        others = [(sum(a * b for a, b in zip(v, u, strict=True)), o, same == label) for j, o, u, same in fine if j != i and len(u) == len(v)]
        for top, positive in sorted(((s, o) for s, o, same in others if same), key=order)[:k]:
            hard = sorted(((s, o) for s, o, same in others if not same and percent * top <= 100 * s <= 100 * top), key=order)[:k]
            out += [(key, positive, r + 1, o, top, s) for r, (s, o) in enumerate(hard)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * rng.uniform(0.1, 1.5)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(900)]
    rows += [(900 + i, rows[3][1], i % 3) for i in range(200)]  # copies: ties
    rows += [(1100 + i, [0.0] * 16, i % 2) for i in range(30)] + [(1200, None, 1), (1300, [float("nan")] * 16, 1), (1400, [None] * 16, 1), (1500, rows[7][1], None), (None, rows[8][1], 1), (1600, [], 1), (1601, [], 2), (1602, [], 1)]
    rows += [(1700, [0.5] * 4, 1), (1701, [0.5] * 4, 1), (1702, [0.48] * 4, 2), (100, rows[100][1], rows[100][2]), (1800, [-x for x in rows[8][1]], 2), (1900, [float("inf")] * 16, 1)]
    return rows


def test_negatives_equal_brute_force(spark, vectors, monkeypatch):
    table = spark.createDataFrame([(k, v, label, "x", 1.0) for k, v, label in vectors], "vec_id long, embedding array<float>, label int, row string, length double").repartition(4)
    want = brute_negatives(vectors)
    for bucket, first, block in ((1024, 4096, 16 << 20), (32, 50, 500)):
        for name, x in (("BUCKET", bucket), ("FIRST", first), ("BLOCK_BYTES", block)):
            monkeypatch.setattr(negatives, name, x)
        assert sorted(map(tuple, negatives.mine(table).collect()), key=str) == want
    assert negatives.mine(table.limit(0)).count() == 0
    assert negatives.mine(table.where("vec_id % 100 <> 0")).count() == 0


def test_feasible_ranges_prune_and_keep_what_counts():
    rng, dropped = np.random.default_rng(2), 0
    import pyarrow as pa

    for _ in range(30):
        v = np.floor(rng.normal(size=(80, 8)) * rng.uniform(0.2, 1, 8) * 256).astype(np.int64)
        length = np.linalg.norm(v, axis=1)
        part = pa.RecordBatch.from_pydict({"row": range(80), "id": range(80), "label": [1] * 80, "v": v.tolist(), "dims": [8] * 80, "length": length})
        bucket = negatives.Bucket(part)
        a = np.floor(rng.normal(size=8) * 256).astype(np.int64)
        unit = a / np.linalg.norm(a)
        focus = [(int(f), float(unit[f])) for f in np.argsort(-np.abs(unit))[: negatives.FOCUS]]
        score = bucket.scores(a, np.arange(80))
        assert score.tolist() == (v @ a).tolist()
        for least in np.quantile(score, [0.7, 0.95, 1.0]):
            rows = bucket.feasible(focus, least / (np.linalg.norm(a) * bucket.longest) - negatives.SLACK)
            if rows is not None:
                assert set(np.flatnonzero(score >= least)) <= set(rows.tolist())
                dropped += 80 - len(rows)
    assert dropped > 300
    with pytest.raises(OverflowError):
        bucket.scores(np.full(8, 1 << 60), np.arange(80))
