"""SentencePiece encoding and decoding with a merge-type prefix table.

Byte-pair merging has a local property: a sequence of pieces is the result for a
text exactly if each piece results for its own text and each adjacent pair
results for the text of that pair.  So every prefix of a text has one last
piece: the piece that ends there and is compatible with the last piece of the
prefix in front of it.  An automaton gives the pieces that end at each place,
the table keeps the one that passes the pair test, and the ids are read
backwards from the end of the table.

No piece holds a blank mark after another character, and none holds a line
feed, so merges never cross those places; the text is cut there and equal
chunks are encoded once per task (bounded memo).  Both facts are checked on the
model; without them the whole text is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

MARK = "▁"
MEMO, PAIRS, LONGEST_KEY = 500_000, 500_000, 64


class PieceModel:
    """The vocabulary of a BPE model with byte fallback and its merge order."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id, self.unknown_id = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        reserved = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(sp.vocab_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not reserved[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.adjacent = adjacent
        self.cuts = not any((x[1] == MARK and x[0] != MARK) or "\n" in x for x in adjacent)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p) == [p]:  # others never result
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pair_memo = Memo(PAIRS)
        self.chunk_memo = Memo(MEMO)
        # decoding: bytes over 127 pass through as lone surrogates
        self.shown = [""] * len(self.pieces)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
            elif sp.is_unknown(i):
                self.shown[i] = " ⁇ "
            elif not sp.is_control(i):
                self.shown[i] = p.replace(MARK, " ")
        self.first_blank = {i for p, i in self.ids.items() if p[0] == MARK}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, leftmost on ties."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Does merging the text of the two pieces give just these two?"""
        if a[-1] + b[0] not in self.adjacent:
            return True
        if (x := self.pair_memo.get((a, b))) is None:
            self.pair_memo.put((a, b), x := self.merged(a + b) == [a, b])
        return x

    def table(self, text: str) -> list[str]:
        """Pieces of a text: fill the prefix table, then walk it backwards."""
        if len(text) == 1:
            return [text]
        last: list[str | None] = [None] * len(text)
        pairs, ids = self.pair_memo.young, self.ids
        for end, piece in self.automaton.iter(text):
            if last[end] is not None:
                continue
            start = end - len(piece)
            if start < 0:
                last[end] = piece
                continue
            if (before := last[start]) is None:
                before = last[start] = text[start]  # no piece of the vocabulary ends here
            ok = pairs.get((before, piece))
            if ok if ok is not None else self.compatible(before, piece):
                last[end] = piece
        out, i = [], len(text) - 1
        while i >= 0:
            piece = last[i] or text[i]
            out.append(piece)
            i -= len(piece)
        out.reverse()
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.unknown_id)
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        if len(text) > 2 and text[-1] in ",." and text[-2:] not in self.adjacent and text[-2] != " ":
            # no piece spans this place
            got = (self.chunk_memo.get(text[:-1]) or self.chunk(text[:-1])) + (self.chunk_memo.get(text[-1]) or self.chunk(text[-1]))
            if len(text) <= LONGEST_KEY:
                self.chunk_memo.put(text, got)
            return got
        got = np.array(self.piece_ids(self.table(text.replace(" ", MARK))), "<i4").tobytes()
        if len(text) <= LONGEST_KEY:
            self.chunk_memo.put(text, got)
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = " " + text.replace(MARK, " ")
        if not self.cuts:
            return self.chunk(text)
        parts = _CHUNK.findall(text)
        out = list(map(self.chunk_memo.young.get, parts))
        if None in out:
            get = self.chunk_memo.get
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = get(parts[i]) or self.chunk(parts[i])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        if ids and ids[0] in self.first_blank:
            text = text[1:]
        if _RAW.search(text):
            text = _RAW.sub(_text_of_bytes, text)
        return text


_CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_RAW = re.compile("[\udc80-\udcff]+")


def _text_of_bytes(m: re.Match) -> str:
    """UTF-8 characters; each byte that belongs to none gives U+FFFD."""
    raw, out = bytes(ord(c) - 0xDC00 for c in m[0]), []
    while raw:
        n = 2 if 0xC2 <= raw[0] <= 0xDF else 3 if 0xE0 <= raw[0] <= 0xEF else 4
        try:
            out.append(raw[:n].decode())
            raw = raw[n:]
        except UnicodeDecodeError:
            out.append("�")
            raw = raw[1:]
    return "".join(out)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row of ``docs``.

    Null text counts as empty; an empty text has the end id alone.  A null or
    repeated key is kept as it is, an empty table gives an empty result, other
    columns are not looked at.  A very long text is cut where no piece reaches across, so its length
    costs time in proportion; all of its ids are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        tail = np.array([model.end_id] if end else [], "<i4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                rows = [model.encode(x or "") + tail for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), lists_of(rows)], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row; control ids give nothing, null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                texts = [x.as_py() and model.decode(x.values.to_numpy().tolist()) if not x.is_valid or not len(x) else model.decode(x.values.to_numpy().tolist()) for x in b.column(1)]
                texts = ["" if isinstance(t, list) else t for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def lists_of(rows: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids of each row as an Arrow list column."""
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), "<i4")))
