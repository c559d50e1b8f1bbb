"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from sortlane.llm import embeddings, jaccard, language, packing, piece_codec, quality, secret_scan, substrings  # noqa: E402
from sortlane.llm.components import components  # noqa: E402

ODD = ["", "  a\n b\t", " ", "日本語 ▁x <s> </s>", "\x00a", "a​b﻿c", "ﬁ ＡＢ é", "a   b\n\n c \n d  ", "x" * 300, "a\r\nb  c", "hello<|endoftext|>x 's don't I'LL  ", "\n", "a\n", "ΑΣ ΣΑΣ.", "a" * 140, "\n\n　s▁Σ,Σ\t '1#"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept int, n int"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioukst") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = [prose(rng.randint(30, 120)) for _ in range(25)], prose(60)
    out = list(base) + [base[0], base[0], base[3]] + [" ".join(w if rng.random() > 0.01 else "zz" for w in x.split()) for x in base[:8]]
    out += [f"{prose(15)} {passage} {prose(9)}" for _ in range(4)] + [prose(6000), "one", "two words", "A b C d", "a B c D"]
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t), "x", 1, 2) for i, t in enumerate(texts())]
    rows += [(900, None, None, None, None, None, None, None), (None, "no id here at all", "en", None, 3, None, None, None), rows[1]]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_piece_model_equals_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceModel(path), random.Random(3)
    for x in texts() + ["".join(rng.choice("ab  \n\t.,'sé▁Σ1#　") for _ in range(rng.randint(1, 40))) for _ in range(800)]:
        ids = np.frombuffer(m.encode(x), "<i4").tolist()
        assert ids == sp.encode(x) and m.decode(ids) == sp.decode(ids)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(1, 9))]
        assert m.decode(ids) == sp.decode(ids)
    m.cuts = False
    assert np.frombuffer(m.encode("whole text as one chunk, twice"), "<i4").tolist() == sp.encode("whole text as one chunk, twice")


def test_piece_codec_rows(spark, docs, empty):
    path = P.path("piece_bpe_32k.model")
    ids = piece_codec.encode(docs, path)
    assert ids.count() == docs.count() and ids.where("doc_id = 900").first().ids == [2]
    back = {r.doc_id: r.text for r in piece_codec.decode(ids, path).collect()}
    assert back[1] == texts()[1] and back[900] == ""
    assert piece_codec.encode(empty, path).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    bins = packing.local_search([[0, 3], [1, 4], [2, 5], [6]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))


def test_local_search_stops_where_no_exchange_helps():
    rng, size = np.random.default_rng(6), 100
    for lengths in (rng.integers(34, 50, 201), np.concatenate([rng.integers(52, 66, 90), np.full(60, 2)]), rng.integers(21, 45, 200), np.array([60, 31, 29, 30, 5, 4])):
        n = packing.local_search([[i] for i in range(len(lengths))] if len(lengths) == 6 else packing.best_fit(lengths, size), lengths, size)
        assert sorted(i for b in n for i in b) == list(range(len(lengths)))
        fill = [int(lengths[b].sum()) for b in n]
        assert max(fill) <= size
        if len(n) == -(-int(lengths.sum()) // size):
            continue
        some = lambda b, most: {0} | {int(lengths[i]) for i in b} | ({int(lengths[i] + lengths[j]) for i in b for j in b if i < j} if most == 2 else set())
        for k, a in enumerate(n):
            for m, b in enumerate(n):
                if k != m and fill[k] <= fill[m] < size:
                    gains = {x - y for x, y in [*((x, y) for x in some(a, 2) for y in some(b, 1)), *((x, y) for x in some(a, 1) for y in some(b, 2))]}
                    assert not any(1 <= g <= size - fill[m] for g in gains if g)


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    at = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(at)


def test_quality(spark, docs, empty):
    for t in [*ODD, "a b c d e f a b c d e g\nx\nx\n\n", " ".join("abcde" * 4), None]:
        assert quality.figures(t) == figures(t)
    rows = quality.judge(docs)
    assert rows.count() == docs.count() and not rows.where("doc_id = 900").first().kept
    assert quality.judge(empty).count() == 0
    verdicts = quality.host_verdicts(spark.createDataFrame([("a", i < 95) for i in range(100)] + [("b", i < 5) for i in range(100)] + [(None, False)], "host string, failed boolean"))
    assert {r.host: r.host_ok for r in verdicts.collect()} == {"a": False, "b": True, None: True}


def test_secrets(spark, empty):
    cases = ['x token = "abcdefgh1234" y', "token: secret: abcdefgh", "AKIAABCDEFGHIJKL AKIAshort AKIAAAAAAAAAAAAAA9", "f" * 31 + " " + "0a" * 16, "PassWord='aaaabbbb' é🙂 api_key:zzzzzzzzz", None, "", "login: bob1 pwd: hunter2hunter2", "login: bob1", "login: bob1 " + "x " * 300 + "pwd: hunter2hunter2", "login: bob1\n\npwd: hunter2hunter2", "a\n\n\nlogin: bob1\nlogin: bob2\npwd: hunter2hunter2"]
    rows = spark.createDataFrame(list(enumerate(cases)) + [(0, cases[0]), (None, cases[0])], "doc_id long, text string")
    got = secret_scan.scan(rows).collect()
    assert len(got) == len(cases) + 2
    kinds = {"assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32)}
    for r in got:
        text = cases[r.doc_id or 0] or ""
        want = sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m))
        assert [(s.start, s.no, s.kind, s.end) for s in r.spans if s.kind in kinds] == want
    weak = {r.doc_id: {s.kind for s in r.spans} for r in got}
    assert weak[7] == {"weak_access", "weak_secret"} and not weak[8] and not weak[9]
    assert not weak[10] and weak[11] == {"weak_access", "weak_secret"}  # an empty line parts two scopes
    masked = {r.doc_id: r.text for r in secret_scan.masked(rows.where("doc_id > 0")).collect()}
    assert masked[4] == "[SECRET]' é🙂 [SECRET]" and masked[5] is None and masked[8] == cases[8] and len(masked) == len(cases) - 1
    assert secret_scan.scan(empty).count() == 0 and secret_scan.masked(empty).count() == 0


def test_language_memo_in_parts(spark, docs, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    model = language.train(docs, path)
    whole = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, model).collect()}
    monkeypatch.setattr(language, "MEMO_BYTES", 7 * 8 * 2)  # seven words of two languages
    monkeypatch.setattr(language, "FORWARD_BYTES", 1)
    monkeypatch.setattr(language, "AT_ONCE", 1)
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, model).collect()} == whole
    again = language.train(docs, path)
    assert np.allclose(again.theta, model.theta)


def test_language_ties_and_clashing_names(spark):
    path = P.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "same words here", "b", 1.0, "x"), (2, "same words here", "a", 2.0, "y"), (2, None, "a", 0.0, None)], "key long, text string, lang string, score double, lang_pred string")
    model = language.train(rows, path, key="key")
    got = language.predict(rows.withColumnRenamed("key", "doc_id"), model).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == [(1, "a", 0.5), (2, "a", 0.5), (2, "und", 0.0)]


def test_language_uses_of_long_words():
    """In words of any length the expected uses are those of the plain sums; a long word is not cut."""
    lat, rng = language.lattice(P.path("piece_bpe_32k.model")), np.random.default_rng(4)
    theta = rng.random((lat.size + 1, 1)) / lat.size
    theta[lat.size] = language.UNKNOWN
    for word in ("international", "unbelievablyso", "日本語", "a"):
        plain, logs = lat.forward([word], theta, np.ones(1)), lat.long_uses(word, theta)
        assert {k: pytest.approx(v) for k, v in logs.items()} == {k: plain[k] for k in np.flatnonzero(plain)}
    long = lat.long_uses("donaudampfschiff" * 200, theta)
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sum(n * (1 if k == lat.size else len(sp.id_to_piece(k))) for k, n in long.items()) == pytest.approx(3201)


def test_language(spark, docs, empty):
    path = P.path("piece_bpe_32k.model")
    train = spark.createDataFrame([(i, ("der und die nicht mit einer " if i % 2 else "the and of with that this ") * 5, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = language.train(train, path)
    rows = spark.createDataFrame([(1, "die und der"), (2, "THE and This"), (3, "123 !"), (4, None), (5, ""), (6, "und" * 400), (6, "und" * 400), (None, "²")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language.predict(rows, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de"), (None, "und")], key=str)
    assert {r.lang_pred for r in language.predict(rows, language.train(empty, path)).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_forward_sums_all_segmentations():
    lat = language.lattice(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    theta = rng.random((lat.size + 1, 2)) * 0.01
    words = ["under", "a", "xyzß", "ing"]
    ids = {}
    for w in words:
        for end, code in lat.automaton.iter(language.MARK + w):
            ids[(w, end + 1 - (code & 255), end + 1)] = code >> 8

    def total(w, at, c):
        text = language.MARK + w
        if at == len(text):
            return 1.0
        out = theta[lat.size, c] * total(w, at + 1, c)
        return out + sum(theta[p, c] * total(w, e, c) for (x, s, e), p in ids.items() if x == w and s == at)

    got = lat.forward(words, theta)
    for i, w in enumerate(words):
        for c in range(2):
            assert got[i, c] == pytest.approx(np.log(total(w, 0, c)))
        assert lat.long_word(w, theta) == pytest.approx(got[i])


def test_substring_dedup(spark, docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = substrings.brute_force([(r.doc_id, r.text) for r in rows.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup(rows).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 100
    assert substrings.dedup(docs).count() == docs.count()
    twice = [r.kept for r in substrings.dedup(docs).where("doc_id = 1").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert substrings.dedup(empty).count() == 0
    assert "row" in substrings.dedup(docs, whole_rows=True).columns


def brute_components(rows, links):
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {k: root(k) for k in rows}


def test_jaccard(spark, docs, empty):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {r.doc_id: grams(r.text) for r in docs.collect() if r.doc_id is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = jaccard.similar(docs).collect()
    assert len(got) == docs.count() and links
    for r in got:
        assert (r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id])) if r.doc_id is not None else r.component_id is None
    assert jaccard.similar(empty).count() == 0


def test_jaccard_blocks_and_chains(spark, monkeypatch):
    """Many near copies, with blocks much smaller than the group, and chains of links."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(sets, links)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items()) and {k for k in want if any(k in e and e[0] != e[1] for e in edges)} == set(got)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + 0.12 * rng.normal(size=(40, 16))
    x[150] = x[151] = x[3]
    rows = [(i, [float(v) for v in r], i % 7) for i, r in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, [1.0, 2.0], 0), (None, [1.0] * 16, 0), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    links = [(a, b) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0.9]
    want = brute_components(range(300), links)
    got = embeddings.near(df).collect()
    assert len(got) == len(rows)
    true = np.bincount(np.array(links).ravel(), minlength=300)
    for r in got:
        if r.vec_id is None or r.vec_id >= 300:
            assert r.n_links == 0
        elif r.vec_id != 5:
            assert r.n_links == true[r.vec_id] and r.component_id == want[r.vec_id] and r.kept == (want[r.vec_id] == r.vec_id)
    assert embeddings.near(df.limit(0)).count() == 0


def test_embeddings_clusters_with_full_lists(spark, monkeypatch):
    """Two tight clusters fill all lists of each other's members, yet link with one another."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 16))
    a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    for at, centre in ((40, a), (60, 0.93 * a + np.sqrt(1 - 0.93**2) * b)):
        x[at : at + 12] = centre + 0.015 * rng.normal(size=(12, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    links = [(i, j) for i in range(260) for j in range(i + 1, 260) if s[i, j] >= 0.9]
    want, true = brute_components(range(260), links), np.bincount(np.array(links).ravel(), minlength=260)
    assert s[40:52, 40:52].min() > s[40:52, 60:72].max() and want[60] == 40
    for searches in (embeddings.MOST_SEARCHES, 0):  # 0: the comparison in blocks that follows the last search
        monkeypatch.setattr(embeddings, "MOST_SEARCHES", searches)
        monkeypatch.setattr(embeddings, "BLOCK", 512 if searches else 64)
        assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near(df).collect()} == {i: (true[i], want[i]) for i in range(260)}


def test_embeddings_of_several_lengths(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want, true = [], {}, {}
    for dims, n in ((16, 60), (12, 50), (7, 20)):
        x = rng.normal(size=(n, dims))
        x[10:20] = x[0] + 0.1 * rng.normal(size=(10, dims))
        x[5] = 3 * x[4]
        at = len(rows)
        rows += [(at + i, [float(v) for v in r]) for i, r in enumerate(x)]
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = np.argwhere(np.triu(y @ y.T >= 0.9, 1)) + at
        want |= brute_components(range(at, at + n), links.tolist())
        true |= dict(enumerate(np.bincount(links.ravel(), minlength=at + n)[at:], at))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (512, 32):  # 32: the second length gets a search of its own
        monkeypatch.setattr(embeddings, "BLOCK", block)
        assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near(df).collect()} == {i: (true[i], want[i]) for i in want}


def test_embeddings_of_a_large_group(spark):
    """A group of 2,000 different near copies among others, with ties, extra columns and repeated rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2600, 12))
    x[300:2300] = x[0] + 0.1 * rng.normal(size=(2000, 12))
    x[2400:2410] = x[2300]
    rows = [(i, [float(v) for v in r], i, "v", 1.0) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<double>, id long, h string, sim double")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.triu(y @ y.T >= 0.9, 1)
    want, true = brute_components(range(2600), np.argwhere(links).tolist()), links.sum(0) + links.sum(1)
    got = embeddings.near(df).collect()
    assert len(got) == 2601
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id != 7} == {i: (int(true[i]), want[i]) for i in range(2600) if i != 7}


def test_jaccard_sketch_bounds_the_difference_and_spares_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 3, 200, 397, 900, 20_000, 40_000):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        y = np.unique(np.concatenate([x[n // 6 :], rng.integers(0, 2**64, n // 7 + 1, np.uint64)]))
        raw = [jaccard.sketch(x), jaccard.sketch(y)]
        least = jaccard.least_differences(raw, np.array([0, 1, 0]), np.array([1, 0, 0])).tolist()
        assert least[0] == least[1] <= len(np.setxor1d(x, y)) and least[2] == 0
        if n in (200, 397, 900):
            assert least[0] > 0.7 * len(np.setxor1d(x, y))
    # groups of 40 texts that share three quarters of their shingles link nowhere: few pairs travel
    words, rows = [f"w{k}" for k in range(4000)], []
    for g in range(3):
        shared = rng.choice(words, 300).tolist()
        rows += [(100 * g + i, " ".join(shared + rng.choice(words, 45).tolist())) for i in range(40)]
    made, plain = [], jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, label: made.append((label, out := plain(df, label), out.count())) or out)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k, _ in rows}
    assert sum(n for label, _, n in made if label in ("likely", "open")) < 50


def test_substring_dedup_sends_a_text_once_and_never_by_broadcast(spark, docs):
    rows = substrings.dedup(docs, whole_rows=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    below = plan[plan.index("Join") :].split("\n")[1]
    assert "struct(" in below and "AS text" not in below and below.count("AS doc_id") == 0
