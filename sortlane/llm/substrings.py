"""Substring dedup by level-wise doubling.

A window of ``4 * SEED`` words can repeat only if the windows of half and of a quarter
of its length inside it repeat.  So seeds of a quarter are looked at first; the
windows of twice that length around seeds that repeat come next, and only around
those that repeat again are windows of full length compared.

Not every place needs a seed: the window's smallest seed hash (on ties every place of it)
is at the same places in each of its copies, so only such places are seeds.  Each
full window contains the half-length window that begins at its seed or the one
that ends with it, so both are kept with the seed and looked at where the seed repeats.

Both comparisons go by ranges of the hash space (see ``dealing``).  A task settles what
repeats among its own rows and sends each distinct window once, so a passage that a third
of all documents hold sends an entry a chunk.  Windows of full length are compared by more
than 96 bits of a 128-bit hash; shorter ones only choose what is compared, and hashes
of 16 to 50 bits do for that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import WORD_PATTERN, Memo, mixed, no_cycle_collection, scratch, staged, window_hashes
from .dealing import arrow_schema, batch_of, cuts, is_chunk, passed, placed, planes, ranges_for, rises, unplaned, unrisen

SEED, SLICE = 5, 128
#: Seeds or windows, and documents, of a chunk.
CHUNK, CHUNK_DOCS = 1 << 19, 1 << 15
AHEAD, BEHIND = 1, 2
_WORD = re.compile(WORD_PATTERN)
NULL_KEY = -(1 << 63)
SEEDS = "bucket long, chunk long, idx int, did long, at binary, kind binary, home long, tok binary, half binary, doc binary"
WINDOWS = "bucket long, chunk long, idx int, did long, at binary, n binary, tok binary, more binary, key binary, dids binary, doc binary"


def document_key(key: str = "doc_id", text: str = "text"):
    """A document is an id with a text: rows that repeat both are one document."""
    return F.xxhash64(F.col(key), F.col(text))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: splitting bytes cuts at the six ASCII white-space characters only."""
    return text.split() if text else []


class Words:
    """The hashes of all words of some texts, one after the other."""

    def __init__(self, texts: list[bytes | None], memo: Memo):
        with no_cycle_collection():
            each = list(map(words_of, texts))
            words = list(chain.from_iterable(each))
            got = list(map(memo.young.get, words))
            if None in got:
                for i, x in enumerate(got):
                    if x is None:
                        if (x := memo.get(words[i])) is None:
                            memo.put(words[i], x := xxhash.xxh3_128_digest(words[i]))
                        got[i] = x
        self.count = np.array(list(map(len, each)), np.int64)
        self.hashes = np.frombuffer(b"".join(got), "<u8").reshape(-1, 2)
        self.start = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(each)), self.count)
        self.at = np.arange(len(words)) - self.start[self.doc]
        self.left = self.count[self.doc] - self.at  # words from here to the end of the text


def _running(x: np.ndarray, steps: tuple[int, ...], best) -> np.ndarray:
    """``best`` of each number and of those behind it, over a window of 1 + sum of steps."""
    x = x.copy()
    for s in steps:
        x[:-s] = best(x[:-s], x[s:])
    return x


def _steps(span: int) -> tuple[int, ...]:
    """Shifts that widen a running minimum from 1 to ``span``."""
    out, n = [], 1
    while n < span:
        out.append(min(n, span - n))
        n += out[-1]
    return tuple(out)


def seeds_of(w: Words, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (in all words) of seeds, their hashes, and 16-bit hashes of the windows of
    twice the length that begin at and end with the seed (0: none)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    h, span = window_hashes(w.hashes[:, 0], seed), 3 * seed + 1  # seeds in a full window
    if len(h) < span:
        return none
    left, doc_at = w.left[: len(h)], w.at[: len(h)]
    steps = _steps(span)
    least = _running(h, steps, np.minimum)
    least[left < 4 * seed] = 0  # no full window begins here
    # a seed is the least of some full window that holds it
    top = _running(least[::-1], steps, np.maximum)[::-1]
    at = np.flatnonzero((top == h) & (left >= seed))
    ahead, behind = np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint16)
    with np.errstate(over="ignore"):
        ok = left[at] >= 2 * seed
        ahead[ok] = mixed(h[at[ok]] + np.uint64(3) * h[at[ok] + seed]) % np.uint64(65535) + np.uint64(1)
        ok = doc_at[at] >= seed
        behind[ok] = mixed(h[at[ok] - seed] + np.uint64(5) * h[at[ok]]) % np.uint64(65535) + np.uint64(1)
    return at, h[at], ahead, behind


def _repeats(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: does its key repeat, and is it the key's first row in this order (which sorts the key)?"""
    same = key[order][1:] == key[order][:-1]
    edge = np.concatenate([[False], same, [False]])
    twice, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], first[order] = edge[1:] | edge[:-1], ~edge[:-1]
    return twice, first


def _halves(tok: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each seed: which of its two windows repeat (bits), and whether it is the first of one that it has."""
    kind, first = np.zeros(len(tok), np.uint8), np.zeros(len(tok), bool)
    for half, bit in ((ahead, AHEAD), (behind, BEHIND)):
        order = np.lexsort((half, tok))
        new = np.ones(len(tok), bool)
        new[1:] = (tok[order][1:] != tok[order][:-1]) | (half[order][1:] != half[order][:-1])
        twice, one = _repeats(np.cumsum(new)[np.argsort(order, kind="stable")], order)
        kind[twice & (half > 0)] |= bit
        first |= one & (half > 0)
    return kind, first


def _seed_rows(chunk: int, dids: list[int], seeds: list[tuple], ranges: int) -> Iterator[pa.RecordBatch]:
    schema, n = arrow_schema(SEEDS), len(dids)
    doc, at, h, ahead, behind = (np.concatenate(x) for x in zip(*seeds, strict=True))
    t = placed(h, ranges)
    order = np.argsort(t, kind="stable")
    doc, at, t, ahead, behind = (x[order] for x in (doc, at, t, ahead, behind))
    kind, first = _halves(t, ahead, behind)
    own = np.flatnonzero(kind)
    own = own[np.argsort(doc[own], kind="stable")]
    bounds = np.searchsorted(doc[own], np.arange(n + 1))
    each = [own[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    yield batch_of(schema, n, bucket=[-1 - chunk] * n, chunk=[chunk] * n, idx=range(n), did=dids, at=[at[x].astype("<u4").tobytes() for x in each], kind=[kind[x].tobytes() for x in each])
    doc, at, t, ahead, behind = (x[first] for x in (doc, at, t, ahead, behind))
    bounds = cuts(t)
    parts = [(int(t[lo] >> np.uint64(32)), rises(t[lo:hi]), ahead[lo:hi].tobytes() + behind[lo:hi].tobytes(), planes(doc[lo:hi].astype("<u2")), planes(at[lo:hi].astype("<u4"))) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    if parts:
        bucket, tok, half, doc, at = zip(*parts, strict=True)
        yield batch_of(schema, len(parts), bucket=bucket, chunk=[chunk] * len(parts), tok=tok, half=half, doc=doc, at=at)


def _answered_seeds(group: pa.Table) -> pa.Table:
    """Rows of one range: the seeds one of whose half windows repeats.  Rows of documents pass."""
    schema = arrow_schema(SEEDS)
    if is_chunk(group):
        return passed(group, schema)
    toks = [unrisen(x.as_py()) for x in group.column("tok")]
    halves = [np.frombuffer(x.as_py(), "<u2").reshape(2, -1) for x in group.column("half")]
    half = np.concatenate(halves, 1)
    kind, _ = _halves(np.concatenate(toks), half[0], half[1])
    rows, lo = [], 0
    for x, chunk, doc, at in zip(toks, group.column("chunk").to_pylist(), group.column("doc"), group.column("at"), strict=True):
        own = kind[lo : lo + len(x)]
        keep, lo = own > 0, lo + len(x)
        if keep.any():
            rows.append((chunk, unplaned(doc.as_py(), "<u2")[keep].tobytes(), unplaned(at.as_py(), "<u4")[keep].tobytes(), own[keep].tobytes()))
    chunk, doc, at, kind = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.Table.from_batches([batch_of(schema, len(rows), bucket=[0] * len(rows), chunk=chunk, doc=doc, at=at, kind=kind)])


def _parts(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows of a chunk's documents, in order, and the answers to it."""
    of_doc = group.column("idx").is_valid()
    return group.filter(of_doc).sort_by("idx"), group.filter(pc.invert(of_doc))


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in column), kind)


def _seeds_by_document(group: pa.Table) -> pa.Table:
    """``did, at, kind`` of documents with seeds, from the rows of one chunk."""
    docs, answers = _parts(group)
    size = [len(x.as_py() or b"") for x in docs.column("kind")]
    doc = np.concatenate([np.repeat(np.arange(docs.num_rows), size), _joined(answers.column("doc"), "<u2").astype(np.int64)])
    at = np.concatenate([_joined(x.column("at"), "<u4") for x in (docs, answers)])
    kind = np.concatenate([_joined(x.column("kind"), np.uint8) for x in (docs, answers)])
    order = np.argsort(doc, kind="stable")
    found, lo = np.unique(doc[order], return_index=True)
    cols = [docs.column("did").take(found), *(pa.array([x.tobytes() for x in np.split(y[order], lo[1:])] if len(found) else [], pa.binary()) for y in (at, kind))]
    return pa.Table.from_arrays(cols, ["did", "at", "kind"])


def surviving_seeds(docs: DataFrame, ranges: int, seed: int = SEED) -> DataFrame:
    """``did, at, kind``: for each document the seeds whose window of twice the length, ahead
    or behind, repeats in the corpus.  ``docs`` has ``did`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk = Memo(100_000), TaskContext.get().partitionId() << 32
        dids, held, total = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                w = Words(b.column(1).cast(pa.binary()).to_pylist(), memo)
                at, h, ahead, behind = seeds_of(w, seed)
                held.append((w.doc[at] + len(dids), w.at[at], h, ahead, behind))
                dids += b.column(0).to_pylist()
                total += len(at)
                if total >= CHUNK or len(dids) + SLICE > CHUNK_DOCS:
                    yield from _seed_rows(chunk, dids, held, ranges)
                    chunk, dids, held, total = chunk + 1, [], [], 0
        if dids:
            yield from _seed_rows(chunk, dids, held, ranges)

    # a task that is run again must see its rows in the same order, or places would not fit
    rows = docs.select("did", "text").sortWithinPartitions("did")
    answered = rows.mapInArrow(run, SEEDS).groupBy("bucket").applyInArrow(_answered_seeds, SEEDS)
    by_doc = answered.groupBy("chunk").applyInArrow(_seeds_by_document, "did long, at binary, kind binary")
    return by_doc.groupBy("did").agg(F.first(F.struct("at", "kind")).alias("s")).select("did", F.col("s.at").alias("at"), F.col("s.kind").alias("kind"))


def _starts(w: Words, places: list, kinds: list, seed: int) -> np.ndarray:
    """Places (in all words) of full windows around the seeds of each text."""
    mark = np.zeros(len(w.doc) + 1, np.int64)
    size = [len(x or b"") for x in kinds]
    doc = np.repeat(np.arange(len(kinds)), size)
    at = np.frombuffer(b"".join(x or b"" for x in places), "<u4").astype(np.int64)
    kind = np.frombuffer(b"".join(x or b"" for x in kinds), np.uint8)
    for bit, shift in ((AHEAD, 0), (BEHIND, seed)):  # the half window begins at, or a seed before, the seed
        x, d = at[kind & bit > 0] - shift, doc[kind & bit > 0]
        np.add.at(mark, w.start[d] + np.maximum(x - 2 * seed, 0), 1)
        np.add.at(mark, w.start[d] + x + 1, -1)
    return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (w.left >= 4 * seed))


def _window_rows(chunk: int, dids: list[int], keys: list[int], windows: list[tuple], ranges: int, size: int) -> Iterator[pa.RecordBatch]:
    schema, n = arrow_schema(WINDOWS), len(dids)
    doc, at, h, more = (np.concatenate(x) for x in zip(*windows, strict=True))
    did, key, t = np.array(dids, np.int64), np.array(keys, np.int64), placed(h, ranges)
    order = np.lexsort((at, did[doc], key[doc], more, t))
    doc, at, t, more = (x[order] for x in (doc, at, t, more))
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (more[1:] != more[:-1])
    # windows that stand earlier in the chunk are settled; in each document they become ranges
    order = np.lexsort((at[~first], doc[~first]))
    d, s = doc[~first][order], at[~first][order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + size)
    left = np.flatnonzero(new)
    last = np.append(left[1:], len(d)) - 1 if len(d) else left
    bounds = np.searchsorted(d[left], np.arange(n + 1))
    cut = lambda x: [x[lo:hi].astype("<i4").tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    yield batch_of(schema, n, bucket=[-1 - chunk] * n, chunk=[chunk] * n, idx=range(n), did=dids, at=cut(s[left]), n=cut(s[last] - s[left] + size))
    doc, at, t, more = (x[first] for x in (doc, at, t, more))
    bounds = cuts(t)
    parts = [(int(t[lo] >> np.uint64(32)), rises(t[lo:hi]), more[lo:hi].tobytes(), planes(key[doc[lo:hi]]), planes(did[doc[lo:hi]]), planes(doc[lo:hi].astype("<u2")), planes(at[lo:hi].astype("<u4"))) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    if parts:
        bucket, tok, more, key, did, doc, at = zip(*parts, strict=True)
        yield batch_of(schema, len(parts), bucket=bucket, chunk=[chunk] * len(parts), tok=tok, more=more, key=key, dids=did, doc=doc, at=at)


def _answered_windows(group: pa.Table) -> pa.Table:
    """Rows of one range: the windows that start earlier elsewhere.  Rows of documents pass."""
    schema = arrow_schema(WINDOWS)
    if is_chunk(group):
        return passed(group, schema)
    toks = [unrisen(x.as_py()) for x in group.column("tok")]
    each = lambda name, kind: np.concatenate([unplaned(x.as_py(), kind) for x in group.column(name)])
    tok, more, key, did, doc, at = np.concatenate(toks), _joined(group.column("more"), "<u8"), each("key", "<i8"), each("dids", "<i8"), each("doc", "<u2"), each("at", "<u4")
    order = np.lexsort((at, did, key, more, tok))
    new = np.ones(len(tok), bool)
    new[1:] = (tok[order][1:] != tok[order][:-1]) | (more[order][1:] != more[order][:-1])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(tok)), 0))]
    later = np.zeros(len(tok), bool)
    later[order] = (did[lead] != did[order]) | (key[lead] != key[order]) | (at[lead] != at[order])  # else the same place of a repeated row
    rows, lo = [], 0
    for x, chunk in zip(toks, group.column("chunk").to_pylist(), strict=True):
        keep, lo = lo + np.flatnonzero(later[lo : lo + len(x)]), lo + len(x)
        if len(keep):
            rows.append((chunk, doc[keep].tobytes(), at[keep].tobytes()))
    chunk, doc, at = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.Table.from_batches([batch_of(schema, len(rows), bucket=[0] * len(rows), chunk=chunk, doc=doc, at=at)])


def _ranges_by_document(size: int):
    def merged(group: pa.Table) -> pa.Table:
        """``did, ranges`` (pairs of 32-bit place and length) of documents with words to remove, from the rows of one chunk."""
        docs, answers = _parts(group)
        count = [len(x.as_py() or b"") // 4 for x in docs.column("at")]
        more = _joined(answers.column("at"), "<u4").astype(np.int64)
        doc = np.concatenate([np.repeat(np.arange(docs.num_rows), count), _joined(answers.column("doc"), "<u2").astype(np.int64)])
        at = np.concatenate([_joined(docs.column("at"), "<i4").astype(np.int64), more])
        end = at + np.concatenate([_joined(docs.column("n"), "<i4").astype(np.int64), np.full(len(more), size)])
        order = np.lexsort((at, doc))
        doc, at, end = doc[order], at[order], end[order]
        # the furthest end so far within the document; documents are set apart by an offset
        gap = int(end.max(initial=0)) + 1
        far = np.maximum.accumulate(end + doc * gap) - doc * gap if len(doc) else end
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > far[:-1])
        left = np.flatnonzero(new)
        last = np.append(left[1:], len(doc)) - 1 if len(doc) else left
        pairs = np.stack([at[left], far[last] - at[left]], 1).astype("<i4")
        found, lo = np.unique(doc[left], return_index=True)
        return pa.Table.from_arrays([docs.column("did").take(found), pa.array([x.tobytes() for x in np.split(pairs, lo[1:])] if len(found) else [], pa.binary())], ["did", "ranges"])

    return merged


def repeated_ranges(docs: DataFrame, ranges: int, seed: int = SEED) -> DataFrame:
    """``did, ranges``: words to remove from each document, as pairs of 32-bit place and length.

    ``docs`` has ``did, doc_id, text``.
    """
    size = 4 * seed
    # texts are dealt by document at any size: a broadcast would do for small tables only
    survivors = staged(surviving_seeds(docs, ranges, seed), "survivors")
    near = docs.join(survivors.hint("merge"), "did").select("did", "doc_id", "text", "at", "kind").sortWithinPartitions("did")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk = Memo(100_000), TaskContext.get().partitionId() << 32
        dids, keys, held, total, before = [], [], [], 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                did = b.column(0).to_numpy()
                b = b.filter(pa.array(np.append(before is None or did[0] != before, did[1:] != did[:-1])))  # repeated rows stand together
                before = did[-1]
                w = Words(b.column(2).cast(pa.binary()).to_pylist(), memo)
                at = _starts(w, b.column(3).to_pylist(), b.column(4).to_pylist(), seed)
                h, more = (window_hashes(w.hashes[:, i], size) for i in (0, 1))
                held.append((w.doc[at] + len(dids), w.at[at], h[at], more[at]))
                dids += b.column(0).to_pylist()
                keys += [NULL_KEY if k is None else k for k in b.column(1).to_pylist()]
                total += len(at)
                if total >= CHUNK or len(dids) + SLICE > CHUNK_DOCS:
                    yield from _window_rows(chunk, dids, keys, held, ranges, size)
                    chunk, dids, keys, held, total = chunk + 1, [], [], [], 0
        if dids:
            yield from _window_rows(chunk, dids, keys, held, ranges, size)

    answered = near.mapInArrow(run, WINDOWS).groupBy("bucket").applyInArrow(_answered_windows, WINDOWS)
    return answered.groupBy("chunk").applyInArrow(_ranges_by_document(size), "did long, ranges binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, whole_rows: bool = False) -> DataFrame:
    """``key, n_words, n_removed, kept`` of every row: the kept words joined by a blank.
    With ``whole_rows`` the input row comes along as a struct ``row``.

    Of equal windows of ``4 * seed`` words the one that starts first stays: smaller
    ``key`` (null first), then the hash of id and text, then the earlier place.  Rows
    that repeat id and text get the same result.  Null text counts as empty; texts of any
    length are taken whole; other columns, whatever their names, are not looked at.  An
    empty table gives an empty result.
    """
    did, names = document_key(key, text).alias("did"), (F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        found = keep(staged(repeated_ranges(docs.select(did, *names), ranges_for(docs, text), seed), "ranges"))
    found = found.hint("merge")
    if whole_rows:  # a text travels once, in its row
        row = F.col("row")
        joined = docs.select(did, F.struct(*docs.columns).alias("row")).join(found, "did", "left").select(row[key].cast("long").alias("doc_id"), row[text].alias("text"), "ranges", "row")
    else:
        joined = docs.select(did, *names).join(found, "did", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b, out = batch.slice(lo, SLICE), []
                for raw, gone in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words, kept, end = words_of(raw), [], 0
                    if gone:
                        for at, n in np.frombuffer(gone, "<i4").reshape(-1, 2).tolist():
                            kept += words[end:at]
                            end = at + n
                    kept = kept + words[end:] if end else words
                    out.append((len(words), len(words) - len(kept), b" ".join(kept)))
                n, less, kept = zip(*out, strict=True)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *b.columns[3:]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept", *b.schema.names[3:]])

    kinds = "".join(f", row {t}" for c, t in joined.dtypes if c == "row")
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string{kinds}").withColumnRenamed("doc_id", key)


def brute_force(rows: list[tuple], size: int = 4 * SEED) -> dict:
    """The same for a few rows (id, text) with distinct ids, by comparing all windows; for tests."""
    seen, out = set(), {}
    for k, text in sorted(rows):
        words = _WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        kept = [x for i, x in enumerate(words) if i not in gone]
        out[k] = len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out
