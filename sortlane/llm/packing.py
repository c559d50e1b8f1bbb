"""Best-fit packing by swap-based local search.

Documents become pieces of at most ``size`` tokens.  A piece that fills a sequence
is one; the others are dealt by hash into groups of bounded size, each packed by
best fit and then improved: pieces are exchanged one for one, two for one or one for two,
or moved, between underfull bins wherever that increases the sum of squared fill,
until bins are empty and no exchange helps.  A second round joins the bins
that stayed underfull from many groups and searches again.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, with_row_id
from .piece_codec import lists_of
from .tokens import encoder

GROUP = 4096
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    Only documents of more than ``size`` ids are cut; then all pieces but the first
    have ``size``.  Null text counts as empty and gives a piece with the end id.
    Null and repeated keys are kept; each row has pieces of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                b, rows, ids = batch.slice(lo, 64), [], []
                for k, found in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                    raw = found.tobytes() + tail
                    n = len(raw) // 4
                    ends = range((n - 1) % size + 1, n + 1, size)
                    for i, end in enumerate(ends):
                        start = 0 if i == 0 else end - size
                        x = raw[4 * start : 4 * end]
                        rows.append((k, i, start, end - start, zlib.crc32(x)))
                        if with_ids:
                            ids.append(x)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays(cols + [lists_of(ids)] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECE_COLUMNS + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins (lists of piece numbers): longest piece first, into the fullest bin with room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # sorted (room, bin)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(int(i))
        else:
            room, b = size, len(bins)
            bins.append([int(i)])
        if room > n:
            bisect.insort(rooms, (room - n, b))
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while squared fill increases.

    Every underfull bin, the emptiest first, gives pieces to bins that are at least as full (a
    move, one for one, two for one, one for two) until a pass over all of them changes
    nothing.  With as few bins as the total length needs there is nothing to gain.
    """
    least = -(-int(lengths.sum()) // size)
    bin_of = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        bin_of[b] = k
    fill = np.bincount(bin_of, lengths, len(bins)).astype(np.int64)
    changed, pairs = True, _Pairs(len(bins))
    while changed:
        changed = False
        open_bins = np.flatnonzero((fill > 0) & (fill < size))
        for low in open_bins[np.argsort(fill[open_bins], kind="stable")]:
            while (fill > 0).sum() > least and 0 < fill[low] < size and _exchanged(int(low), bin_of, fill, lengths, size, pairs):
                changed = True
    out: dict[int, list[int]] = {}
    for i, k in enumerate(bin_of.tolist()):
        out.setdefault(k, []).append(i)
    return list(out.values())


def _exchanged(low: int, bin_of: np.ndarray, fill: np.ndarray, lengths: np.ndarray, size: int, pairs: _Pairs) -> bool:
    """Make the exchange that fills another bin most; False if there is none.

    The other bin is at least as full and gains between 1 and its room, so the sum
    of squared fill grows.  One for two is only looked for if nothing else helps.
    """
    mine = np.flatnonzero(bin_of == low)
    room = np.where((fill >= fill[low]) & (fill < size), size - fill, 0)
    room[low] = 0
    bins, theirs = np.flatnonzero(room), np.flatnonzero(room[bin_of])
    if not len(bins):
        return False
    # the piece, or two pieces, of each total length; then the longest total up to a length
    single = np.full(size + 1, -1)
    single[lengths[mine]] = mine
    ones = np.maximum.accumulate(np.where(single >= 0, np.arange(size + 1), 0))
    have = np.flatnonzero(single >= 0)
    twice = have[np.bincount(lengths[mine], minlength=size + 1)[have] > 1]
    p, q = np.triu_indices(len(have), 1)
    p, q = np.concatenate([have[p], twice]), np.concatenate([have[q], twice])
    fits = p + q <= size
    p, q = p[fits], q[fits]
    pair = np.full(size + 1, -1)
    pair[p + q] = p
    sums = np.maximum.accumulate(np.where((single >= 0) | (pair >= 0), np.arange(size + 1), 0))
    y = lengths[theirs]
    move, swap = ones[room[bins]], sums[np.minimum(y + room[bin_of[theirs]], size)] - y
    back = []
    if move.max() >= swap.max(initial=0):
        best, high = int(move.max()), int(bins[move.argmax()])
        total = best
    else:
        at = int(swap.argmax())
        best, high, back = int(swap[at]), int(bin_of[theirs[at]]), [theirs[at]]
        total = best + int(y[at])
    if best < 1:
        pairs.refresh(bin_of, lengths)
        best, total, back = pairs.best(room, ones, size)
        if best < 1:
            return False
        high = int(bin_of[back[0]])
    if single[total] >= 0:
        out = [single[total]]
    else:
        a, b = int(pair[total]), total - int(pair[total])
        first = mine[lengths[mine] == a]
        out = [first[0], first[1] if a == b else single[b]]
    bin_of[out], bin_of[back] = high, low
    fill[low] -= best
    fill[high] += best
    pairs.changed |= {low, high}
    return True


class _Pairs:
    """Two pieces of one bin, one pair a pair of lengths, for all bins; only changed bins are listed anew."""

    def __init__(self, n_bins: int):
        self.changed = set(range(n_bins))
        self.one = self.two = self.bin = self.total = np.zeros(0, np.int64)

    def refresh(self, bin_of: np.ndarray, lengths: np.ndarray) -> None:
        if not self.changed:
            return
        new = np.zeros(int(bin_of.max()) + 1 + max(self.changed), bool)
        new[list(self.changed)] = True
        pieces = np.flatnonzero(new[bin_of])
        pieces = pieces[np.lexsort((lengths[pieces], bin_of[pieces]))]
        one, two = [self.one[~new[self.bin]]], [self.two[~new[self.bin]]]
        for x in np.split(pieces, np.flatnonzero(np.diff(bin_of[pieces])) + 1):
            if len(x) > 1:
                kinds, at, many = np.unique(lengths[x], return_index=True, return_counts=True)
                p, q = np.triu_indices(len(kinds))
                ok = (p != q) | (many[p] > 1)
                p, q = p[ok], q[ok]
                one.append(x[at[p]])
                two.append(x[at[q] + (p == q)])
        self.one, self.two = np.concatenate(one), np.concatenate(two)
        self.bin, self.total = bin_of[self.one], lengths[self.one] + lengths[self.two]
        self.changed.clear()

    def best(self, room: np.ndarray, ones: np.ndarray, size: int) -> tuple[int, int, list[int]]:
        """Gain, length given and the pair that comes back for one piece."""
        if not len(self.one):
            return 0, 0, []
        gain = np.where(room[self.bin] > 0, ones[np.minimum(self.total + room[self.bin], size)] - self.total, 0)
        k = int(gain.argmax())
        return int(gain[k]), int(gain[k] + self.total[k]), [int(self.one[k]), int(self.two[k])]


def _laid_out(pdf: pd.DataFrame, bins: list[list[int]], group: int) -> pd.DataFrame:
    seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    lengths, fill = pdf["length"].to_numpy(), np.zeros(len(pdf), np.int64)
    for k, b in enumerate(bins):
        n = lengths[b]
        seq[b], off[b], fill[b] = (group << 32) + k, np.cumsum(n) - n, n.sum()
    return pdf.assign(sequence_id=seq, offset=off, fill=fill)


def pack(pieces: DataFrame, size: int = 1024, group: int = GROUP) -> DataFrame:
    """``pieces`` (from ``pieces_of``, lengths 1 to ``size``) with ``sequence_id`` and ``offset``.

    A group holds about ``group`` pieces, so no task holds more than that at once.
    An empty table gives an empty result.
    """
    rows = staged(with_row_id(pieces), "pieces")
    full = rows.where(F.col("length") >= size)
    short = rows.where(F.col("length") < size)
    n_groups = max(1, -(-short.count() // group))
    columns = [f"{c.name} {c.dataType.simpleString()}" for c in rows.schema if c.name != "__row"]
    schema = ", ".join([*columns, "sequence_id long", "offset long", "fill long"])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row", ignore_index=True)
        n = pdf["length"].to_numpy()
        return _laid_out(pdf.drop(columns=["__row", "__group"]), local_search(best_fit(n, size), n, size), int(pdf["__group"].iloc[0]))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], ignore_index=True)
        n = pdf["length"].to_numpy()
        bins = [list(map(int, x)) for x in pdf.groupby("sequence_id").indices.values()]
        return _laid_out(pdf.drop(columns=["__group"]), local_search(bins, n, size), int(pdf["__group"].iloc[0]) + n_groups)

    dealt = short.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(n_groups)))
    one = staged(dealt.groupBy("__group").applyInPandas(first, schema), "packed")
    tight = 0.98 * size
    loose = one.where(F.col("fill") < tight)
    n_second = max(1, -(-loose.count() // group))
    mixed = loose.withColumn("__group", F.pmod(F.xxhash64("sequence_id"), F.lit(n_second)))
    two = mixed.groupBy("__group").applyInPandas(second, schema)
    alone = full.withColumns({"sequence_id": -1 - F.col("__row"), "offset": F.lit(0).cast("long")}).drop("__row")
    return one.where(F.col("fill") >= tight).drop("fill").unionByName(two.drop("fill")).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every row of ``docs`` in sequences of at most ``size`` tokens.

    Null and empty texts give a piece with the end id; a very long text is encoded whole and cut into pieces of
    ``size``.  Null and repeated keys are kept, in no set order, each row with pieces of its own; an empty table
    gives no rows; other columns of any name are not looked at.
    """
    return pack(pieces_of(docs, tokenizer_path, size, end_id, with_ids=with_ids), size)
