"""Token records and packing against the tokenizers library, loaded afresh from its file."""

import random
import zlib

import numpy as np
import pytest
from conftest import DATA

P = pytest.importorskip("public_tokenizers")
from sortlane.llm import packing, records, tokens  # noqa: E402
from sortlane.llm.queries import QUERIES  # noqa: E402

ODD = ["", "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "  a\n b\t", " ", "日本語 ▁x <s> </s>", "\x00a", "a​b﻿c", "ﬁ ＡＢ é", "a   b\n\n c \n d  ", "x" * 300, "a\r\nb  c", "'s don't I'LL  ", "ΑΣ ΣΑΣ.", "İı ŉ ſ", "a\x0b\x0cb\x1cc\x85d\xa0e", "1234 12a ² ½ ª º µ", "é ­- --- ...!?", "été ÀÉ ß œuvre “q” – — … € 5"]
COLUMNS = "doc_id long, text string, ids string, length int, path string"


def fresh(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def random_texts(n):
    rng = random.Random(4)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", "_", "<|endoftext|>", "…", "ß", "don't", "—", "²", "日", "́", "\xa0", "\x1c", "$", "-", "the", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    prose = ["".join(rng.choice("aeioukst  .,") for _ in range(rng.randint(2, 900))) for _ in range(40)]
    rows = [(i, t, "x", 1, "p") for i, t in enumerate(ODD + prose + ["so long " * 9000, "blank" + " " * 1_000_000 + "text", "lines" + "\n" * 1_000_000 + "text"])]
    rows += [(900, None, None, None, None), (None, "no id here at all", "x", 2, "p"), rows[1], (1, "another text of the same id", None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    e, want = tokens.Encoder(P.path(name)), fresh(name)
    assert e.table is not None and len(e.table) >= e.size - 3
    for x in ODD + random_texts(3000):
        assert e.encode(x).tolist() == want(x), x


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\t \n"])
def test_white_space_of_any_length(run):
    e, want = tokens.Encoder(P.path("byte_bpe_50k.json")), fresh("byte_bpe_50k.json")
    for x in ("a" + run * (1_200_000 // len(run)) + "b", "a" + run * (tokens.LONG_SPACE // len(run) - 1) + "b c"):
        assert e.encode(x).tolist() == want(x)


def test_every_token_ends_as_itself():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("a", "bc"): 3}
    assert tokens._ends_as_itself(["a", "b", "c"], "abc", ranks)
    assert not tokens._ends_as_itself(["b", "a"], "ba", ranks)


def test_records(spark, docs):
    path, want, start = P.path("word_bpe_49k.json"), [], 0
    ids_of, manifest = fresh("word_bpe_49k.json"), records.write_records(docs, P.path("word_bpe_49k.json"))
    got = sorted((tuple(r) for r in records.read_records(manifest).collect()), key=lambda r: r[1])
    for r, (k, at, n, ids) in zip(sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)), got, strict=True):
        assert k == r.doc_id and at == start and n == len(ids)
        want.append(ids_of(r.text) + [2])
        start += n
    assert sorted(map(tuple, want)) == sorted(tuple(r[3]) for r in got)
    shuffled = [tuple(r) for r in records.read_shuffled(manifest, 7).collect()]
    assert sorted(shuffled, key=lambda r: r[1]) == got and [r[1] for r in shuffled] != sorted(r[1] for r in shuffled)
    assert records.read_records(records.write_records(docs.limit(0), path)).count() == 0
    raw = records.frame(b"abc")
    assert records.unframe(raw)[0] == b"abc"
    with pytest.raises(ValueError):
        records.unframe(raw[:-5] + b"X" + raw[-4:])


def test_records_query(spark):
    """Starts, lengths and checksums of the query over a whole table."""
    sf, ids_of, start = f"{DATA}/sf0.001", fresh("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in QUERIES["op2_token_records"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids, x = ids_of(r.text) + [2], got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def check_layout(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= size
    return len(bins)


def test_packing(spark, docs):
    path, ids_of = P.path("byte_bpe_50k.json"), fresh("byte_bpe_50k.json")
    rows = packing.pack_documents(docs.where("doc_id is null or doc_id <> 1"), path, size=64, with_ids=True).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.start == len(whole.setdefault(r.doc_id, [])) and (r.piece == 0 or r.length == 64)
        whole[r.doc_id] += r.ids
    assert whole == {r.doc_id: ids_of(r.text) + [2] for r in docs.where("doc_id is null or doc_id <> 1").collect()}
    n, total = check_layout(rows, 64), sum(map(len, whole.values()))
    assert n <= 1.03 * -(-total // 64) + 1
    every = packing.pack_documents(docs, path, size=64).collect()
    assert sum(r.piece == 0 for r in every) == docs.count()
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_query(spark):
    """Pieces, starts and checksums of the query over a whole table, and as many sequences as the total needs or few more."""
    sf, ids_of, total = f"{DATA}/sf0.001", fresh("byte_bpe_50k.json"), 0
    rows = QUERIES["op9_packing"](spark, sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, end = ids_of(r.text) + [2], 0
        total += len(ids)
        for i, x in enumerate(sorted(by_doc.pop(r.doc_id), key=lambda x: x.piece)):
            assert (x.piece, x.start) == (i, end) and x.ids_crc32 == zlib.crc32(np.array(ids[end : end + x.length], "<u4").tobytes())
            assert x.length == 1024 or i == 0
            end += x.length
        assert end == len(ids)
    assert not by_doc and check_layout(rows, 1024) <= 1.02 * -(-total // 1024) + 1


def test_piece_codec_query(spark):
    """Counts and digests of the query over a whole table equal the library's."""
    import hashlib

    from sentencepiece import SentencePieceProcessor

    sf, model = f"{DATA}/sf0.001", SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op1_piece_codec"](spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, x = [*model.encode(r.text or ""), model.eos_id()], got.pop(r.doc_id)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert not got


def test_a_secret_at_the_end_of_a_very_long_text(spark):
    from sortlane.llm.secret_scan import scan

    text = "plain words go on " * 60_000 + "\n\npassword = Zk39dkQmw82x"
    rows = spark.createDataFrame([(1, text, "k", 3), (2, None, "k", 3)], "doc_id long, text string, spans string, key int")
    got = {r.doc_id: r.spans for r in scan(rows).collect()}
    assert got[2] == [] and [(s["kind"], s["start"], s["end"]) for s in got[1]] == [("assign", text.index("password"), len(text))]
