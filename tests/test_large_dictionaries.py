"""Matching against 20,000 words: equal to brute force, and no nested loop in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from sortlane.functions import similarity as sim
from sortlane.operators import candidates, match


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(line[j] + 1 if c == d else max(new[-1], line[j + 1]))
        line = new
    return line[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    s, long = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    return max(ratio(s, long[max(i, 0) : min(i + len(s), len(long))]) for i in range(1 - len(s), len(long))) if s else 0.0


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(line[j] + (c != d), line[j + 1] + 1, new[-1] + 1))
        line = new
    return line[-1]


def spoiled(rng, word):
    x = list(word)
    for _ in range(rng.randint(0, 4)):
        i, what = rng.randrange(len(x) + 1), rng.random()
        if what < 0.4:
            x.insert(i, rng.choice("aeinorst"))
        elif x and what < 0.7:
            x.pop(i - 1)
        elif x:
            x[i - 1] = rng.choice("aeinorst")
    return "".join(x)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(12)
    syllables = ["ma", "bu", "lo", "san", "ta", "gar", "ri", "no", "pal", "ay", "tung", "ko", "zon", "x", "e"]
    out = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(60_000)))[:20_000]
    assert len(out) == 20_000
    return out


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(13)
    return [spoiled(rng, rng.choice(words)) for _ in range(15)] + ["", "a", "mab", "zzzzzz", words[5].upper(), " " + words[6], None]


def tables(spark, words, texts):
    return spark.createDataFrame([*enumerate(texts)], "i int, x string"), spark.createDataFrame([*enumerate(words)], "pos int, word string").repartition(3)


def flat(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return {r[0]: r[1] for r in df.collect()}


def test_ratio(spark, words, texts):
    t, d = tables(spark, words, texts)
    got = flat(match.best_ratio(t, "x", d).select("i", "matched"))
    for i, x in enumerate(texts):
        scores = [(ratio((x or "").lower(), w), -p, w) for p, w in enumerate(words) if x is not None and abs(len(w) - len(x)) <= len(x)]
        best = max(scores, default=(0, 0, None))
        assert got[i] == (best[2] if best[0] >= 80 else None), x


def test_edit_distance(spark, words, texts):
    short, upper = [x for x in texts if x is None or len(x) < 14], [w.upper() for w in words]
    t, d = tables(spark, upper, short)
    for most in (2, 5):
        got = flat(match.nearest_edit(t, "x", d, most).select("i", "matched"))
        for i, x in enumerate(short):
            y = (x or "").strip(" ").upper()
            best = min(((edits(y, w), p, w) for p, w in enumerate(upper) if abs(len(y) - len(w)) <= most), default=(99, 0, None)) if y else (99, 0, None)
            assert got[i] == (best[2] if best[0] <= most else None), (most, x)


def test_variations_and_codes(spark, words, texts):
    t, d = tables(spark, [w.upper() for w in words], texts)
    got = flat(match.best_variation(t, "x", d.select(F.col("word").alias("variation"), F.lower("word").alias("canonical"), "pos")).select("i", "matched"))
    for i, x in enumerate(texts):
        y = (x or "").strip(" ")
        scores = [(1 - edits(y.lower(), w) / max(len(y), len(w)), -p, w) for p, w in enumerate(words) if y and abs(len(w) - len(y)) <= 0.3 * max(len(w), len(y))]
        best = max(scores, default=(0, 0, None))
        assert got[i] == (best[2] if best[0] > 0.7 + 1e-12 else None), x
    at = texts.index(words[5].upper())
    assert flat(match.best_code(t, "x", d).select("i", "matched"))[at] == words[5].upper()
    assert flat(match.first_ratio(t, "x", d).select("i", "matched"))[at] is not None


def test_partial_ratio(spark, words, texts):
    some = [w for w in words if len(w) <= 12][:120]
    t, d = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(w,) for w in some], "w string")
    for least in (75, 85):
        pairs = candidates.contained(t, d, least)
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {tuple(r) for r in pairs.where(sim.partial_ratio(F.col("t"), F.col("w")) >= least).collect()}
        assert got == {(x, w) for x in texts if x for w in some if partial(x, w) >= least}


def test_keyword_and_name_scores(spark, words, texts):
    lines = [" ".join(x for x in texts[i : i + 5] if x) for i in range(0, 15, 5)]
    t = spark.createDataFrame([*enumerate(lines)], "k int, x string")
    names = spark.createDataFrame([(w,) for w in words[:11_000]], "word string")
    got = flat(match.name_score(t, "k", "x", names).select("k", F.round("score", 9)))
    for i, line in enumerate(lines):
        tokens = line.split()
        hits = [any(ratio(x, w) >= 85 for w in words[:11_000] if abs(len(w) - len(x)) <= 5) for x in tokens]
        assert got[i] == pytest.approx(sum(hits) / len(hits)), line
    codes = spark.createDataFrame([(i, "-".join(words[3 * i : 3 * i + 3]).upper()) for i in range(4000)], "pos int, word string")
    scored = match.keyword_scores(t, "k", "x", codes, least=1)
    assert "NestedLoop" not in scored._jdf.queryExecution().sparkPlan().toString()
    for r in scored.collect():
        assert r.top_score == sum(any(edits(x.upper(), p) <= 2 for x in lines[r.k].split()) for p in r.top_code.split("-"))


def test_strings_of_any_length(spark):
    rng = random.Random(1)
    sizes = [0, 1, 61, 62, 63, 64, 80, 124, 125, 200, 300]
    rows = [("".join(rng.choice("abcdé ") for _ in range(n)), "".join(rng.choice("abcde") for _ in range(m))) for n in sizes for m in sizes]
    rows += [(a, a) for a, _ in rows[::11]] + [(a, "".join(c for c in a if rng.random() < 0.8) + "xyz") for a, _ in rows[::5]]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", sim.ratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(ratio(r.a, r.b))
    for r in df.where("length(a) < 130 and length(b) < 90").sample(0.1, 3).select("a", "b", sim.partial_ratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(100.0 if not r.a and not r.b else partial(r.a, r.b) if r.a and r.b else 0.0)
