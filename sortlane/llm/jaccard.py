"""N-gram Jaccard self-join with rare-first prefix filtering.

Documents with equal shingle sets form one class.  Shingles are ordered by how many
documents hold them, counted over the whole corpus, rare ones first.  Two classes that
link share a shingle of their prefixes, so a class needs only those shingles of its
prefix that occur elsewhere; most have none.

Counting: a task deals the shingles of some documents (a chunk) into ranges of the hash
space; their number follows the size of the corpus.  A range gets, from each chunk, every
distinct shingle once, with the number of documents and their places in the chunk.  It sends
back only what occurs twice or more, with its count.  A shingle that many documents of a
chunk hold goes without places (its documents remember it), so a passage that a third of
all documents hold is one entry a chunk.

Joining: classes that meet at a prefix shingle are compared in blocks of bounded size with
a length filter, a positional filter and a sketch (whether a set has an odd number of hashes in
each of some bins; bins that differ are a lower bound of the difference of two sets), and pairs
that pass are verified once on the whole sets.  A group of
many near copies would have links in the square of its size.  As the result is components, a
first round verifies one tree of likely links a block; a second round verifies every pair
that passes the filters and whose two classes are not in one component yet, so no component
is missed.  At a shingle, the classes outside its largest component meet all others there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Memo, dropped, no_cycle_collection, scratch, staged, window_hashes
from .components import components
from .dealing import arrow_schema, batch_of, cuts, is_chunk, passed, placed, planes, ranges_for, rises, unplaned, unrisen

SHINGLE, THRESHOLD, BLOCK = 4, 85, 512
#: Shingles and documents of a chunk.
CHUNK, CHUNK_DOCS = 1 << 20, 1 << 15
#: A shingle in more documents of a chunk goes without their places.
HOT = 64
#: Owners of classes are broadcast up to this number (8 bytes each); beyond, joined by shuffle.
BROADCAST_IDS = 300_000
#: Least and most bins (powers of two) of a sketch, which has two bins a shingle at least up to the most.
FEW_BINS, MOST_BINS = 512, 1 << 15
DEALT = "bucket long, chunk long, tok binary, many binary, refs binary, idx int, doc_id long, n long, key binary, sig binary, hot binary, loose boolean"
SHARED = DEALT + ", df binary"


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A to Z lower-cased.  Lower-casing and splitting bytes touches
    ASCII letters and the six ASCII white-space characters only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_sets(texts: list[str | None], memo: Memo, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of the whole text if it has fewer words."""
    each = [words_of(x) for x in texts]
    hashed = byte_hashes(list(chain.from_iterable(each)), memo)
    every = window_hashes(hashed, size)
    out, at = [], 0
    for words in each:
        n = len(words)
        if n >= size:
            out.append(np.unique(every[at : at + n - size + 1]))
        elif n:
            out.append(window_hashes(hashed[at : at + n], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def byte_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    """64-bit hashes of words."""
    got = list(map(memo.young.get, words))
    if None in got:
        for i, x in enumerate(got):
            if x is None:
                if (x := memo.get(words[i])) is None:
                    memo.put(words[i], x := xxhash.xxh64_digest(words[i]))
                got[i] = x
    return np.frombuffer(b"".join(got), "<u8")


def in_slices(batches: Iterator[pa.RecordBatch], column: int, memo: Memo, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of bounded size with the shingle sets of their texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            b = batch.slice(lo, 128)
            with no_cycle_collection():
                sets = shingle_sets(b.column(column).to_pylist(), memo, size)
            yield b, sets


def set_key(h: np.ndarray) -> bytes:
    """A 128-bit key of a set."""
    return xxhash.xxh3_128_digest(h.tobytes())


def sketch(h: np.ndarray) -> bytes:
    """A bit a bin: is the number of hashes in it odd?  What two sets share cancels out."""
    bins = min(max(FEW_BINS, 1 << (2 * len(h) - 1).bit_length()), MOST_BINS)
    return np.packbits((np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The sketch of the same set in ``size`` bytes."""
    x = np.frombuffer(raw, "<u8")
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_differences(sig: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of sketches: so many hashes at least are in one of the two sets only."""
    size = np.fromiter(map(len, sig), np.int64, len(sig))
    size, out = np.minimum(size[a], size[b]), np.zeros(len(a), np.int64)
    for k in np.unique(size).tolist():
        at = np.flatnonzero(size == k)
        own, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        bits = np.stack([folded(sig[x], k) for x in own.tolist()])
        x, y, step = place[: len(at)], place[len(at) :], max(1, (8 << 20) // k)
        for lo in range(0, len(at), step):
            out[at[lo : lo + step]] = np.bitwise_count(bits[x[lo : lo + step]] ^ bits[y[lo : lo + step]]).sum(1, dtype=np.int64)
    return out


def prefix_length(n, percent: int = THRESHOLD):
    return n - (percent * n + 99) // 100 + 1


def _chunk_rows(chunk: int, ids: list, sets: list[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each range that gets shingles of the chunk."""
    keys = [set_key(h) if len(h) else None for h in sets]
    first = {k: i for i, k in reversed(list(enumerate(keys))) if k is not None and ids[i] is not None}
    own = sorted(first.values())
    h = np.concatenate([sets[i] for i in own]) if own else np.zeros(0, np.uint64)
    doc = np.repeat(np.array(own, np.int64), [len(sets[i]) for i in own])
    t = placed(h, ranges)
    order = np.argsort(t, kind="stable")
    t, doc = t[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(t)))
    loose = np.zeros(len(ids), bool)  # two shingles of the document look alike
    loose[doc[1:][(t[1:] == t[:-1]) & (doc[1:] == doc[:-1])]] = True
    hot = np.repeat(many > HOT, many)
    d, x = doc[hot], t[hot]
    order = np.argsort(d, kind="stable")
    bounds = np.searchsorted(d[order], np.arange(len(ids) + 1))
    remembered = [x[order[lo:hi]].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    sig: list[bytes | None] = [None] * len(ids)
    for i in own:
        sig[i] = sketch(sets[i])
    schema, n = arrow_schema(DEALT), len(ids)
    yield batch_of(schema, n, bucket=[-1 - chunk] * n, chunk=[chunk] * n, idx=range(n), doc_id=ids, n=[len(x) for x in sets], key=keys, sig=sig, hot=remembered, loose=loose)
    u, refs, low = t[at], doc[~hot].astype("<u2"), many.astype("<u2")
    ends, bounds = np.append(0, np.cumsum(np.where(many > HOT, 0, many))), cuts(u)
    parts = [(int(u[lo] >> np.uint64(32)), rises(u[lo:hi]), planes(low[lo:hi]), planes(refs[ends[lo] : ends[hi]])) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    if parts:
        bucket, tok, many, refs = zip(*parts, strict=True)
        yield batch_of(schema, len(parts), bucket=bucket, chunk=[chunk] * len(parts), tok=tok, many=many, refs=refs)


def _dealt(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk = Memo(150_000), TaskContext.get().partitionId() << 32
        ids, held, total = [], [], 0
        for b, sets in in_slices(batches, 1, memo, size):
            for k, h in zip(b.column(0).to_pylist(), sets, strict=True):
                ids.append(k)
                held.append(h)
                total += len(h)
                if total >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield from _chunk_rows(chunk, ids, held, ranges)
                    chunk, ids, held, total = chunk + 1, [], [], 0
        if ids:
            yield from _chunk_rows(chunk, ids, held, ranges)

    # a task that is run again must see its rows in the same order, or places would not fit
    ordered = docs.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, DEALT)


def _answered(group: pa.Table) -> pa.Table:
    """Rows of one range: what occurs twice or more in the corpus.  Rows of documents pass."""
    schema = arrow_schema(SHARED)
    if is_chunk(group):
        return passed(group, schema)
    toks = [unrisen(x.as_py()) for x in group.column("tok")]
    many = [unplaned(x.as_py(), "<u2") for x in group.column("many")]
    tok, count = np.concatenate(toks), np.concatenate(many).astype(np.int64)
    _, number = np.unique(tok, return_inverse=True)
    df = np.minimum(np.bincount(number, count), 2**32 - 1).astype("<u4")[number]
    rows, lo = [], 0
    for x, m, chunk, refs in zip(toks, many, group.column("chunk").to_pylist(), group.column("refs"), strict=True):
        own = df[lo : lo + len(x)]
        keep, lo = own >= 2, lo + len(x)
        if keep.any():
            at = np.where(m > HOT, 0, m)
            rows.append((chunk, x[keep].tobytes(), m[keep].tobytes(), unplaned(refs.as_py(), "<u2")[np.repeat(keep, at)].tobytes(), own[keep].tobytes()))
    chunk, tok, many, refs, df = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.Table.from_batches([batch_of(schema, len(rows), bucket=[group.column("bucket")[0].as_py()] * len(rows), chunk=chunk, tok=tok, many=many, refs=refs, df=df)])


def _prefixes_of(percent: int):
    def prefixes(group: pa.Table) -> pa.Table:
        """Rows of one chunk: the shared shingles in the prefix of each class."""
        kind = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sig", pa.binary())])
        is_doc = group.column("idx").is_valid()
        docs, answers = group.filter(is_doc).sort_by("idx"), group.filter(pc.invert(is_doc))
        n = docs.column("n").to_numpy()
        cat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in answers.column(name)] or [np.zeros(0, kind)])
        size = [len(x.as_py()) // 4 for x in answers.column("tok")]
        t = np.repeat(answers.column("bucket").to_numpy().astype(np.uint64), size) << np.uint64(32) | cat("tok", "<u4").astype(np.uint64)
        df, many, refs = cat("df", "<u4").astype(np.int64), cat("many", "<u2").astype(np.int64), cat("refs", "<u2").astype(np.int64)
        hot = many > HOT
        order = np.argsort(t[hot])
        hot_t, hot_df = t[hot][order], df[hot][order]
        each = [np.frombuffer(x.as_py() or b"", np.uint64) for x in docs.column("hot")]
        own = np.concatenate(each) if each else np.zeros(0, np.uint64)
        doc = np.concatenate([refs, np.repeat(np.arange(len(n)), [len(x) for x in each])])
        df = np.concatenate([np.repeat(df[~hot], many[~hot]), hot_df[np.searchsorted(hot_t, own)] if len(own) else np.zeros(0, np.int64)])
        t = np.concatenate([np.repeat(t[~hot], many[~hot]), own])
        order = np.lexsort((t, df, doc))
        t, doc = t[order], doc[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
        t, doc = t[new], doc[new]
        shared = np.bincount(doc, minlength=len(n))
        start = np.cumsum(shared) - shared
        loose = docs.column("loose").to_numpy(zero_copy_only=False).astype(bool)
        take = np.where(loose, shared, np.clip(prefix_length(n, percent) - (n - shared), 0, shared))
        t = t[np.arange(len(t)) - start[doc] < take[doc]]
        at = np.flatnonzero(take)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take[at])), pa.int32()), pa.array(t.view(np.int64)))
        first = np.where(loose, -1, n - shared)[at]
        return pa.Table.from_arrays([docs.column("key").take(at), pa.array(n[at]), pa.array(first), lists, docs.column("sig").take(at)], schema=kind)

    return prefixes


def _needed(na, nb, percent):
    """The least overlap of linked sets of these sizes."""
    return -((-percent * (na + nb)) // (100 + percent))


def _grouped(rows: DataFrame, signs: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """``a, b`` (a < b) of pairs that pass all filters, from rows ``tok, i, j, blk, comp, cid,
    n, pos``; within a group (tok, i, j), of different blocks if i and j differ.

    With ``all_pairs`` each pair of different components comes out, else one tree of the
    likeliest links of each group.
    """
    columns = ["tok", "i", "j", "blk", "comp", "cid", "n", "pos"]
    rows = rows.select(columns).join(signs, "cid").select(*columns, "sig")
    rows = rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "n", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            group = _group_numbers(t)
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
            if cut:
                yield from _pairs(t.slice(0, cut), group[:cut], percent, all_pairs)
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from _pairs(rest, _group_numbers(rest), percent, all_pairs)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _group_numbers(t: pa.Table) -> np.ndarray:
    tok, i, j = (t.column(c).to_numpy() for c in ("tok", "i", "j"))
    new = np.zeros(len(tok), np.int64)
    new[1:] = (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.cumsum(new)


def _pairs(t: pa.Table, group: np.ndarray, percent: int, all_pairs: bool) -> Iterator[pa.RecordBatch]:
    i, j, blk, comp, key, n, pos = (t.column(c).to_numpy() for c in ("i", "j", "blk", "comp", "cid", "n", "pos"))
    sig = t.column("sig").to_pylist()
    stop = np.searchsorted(group, group, side="right")
    following = stop - np.arange(len(group)) - 1
    ends = np.cumsum(following)
    lo = 0
    while lo < len(group):  # about half a million pairs at once
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000, side="right")))
        m = following[lo:hi]
        a = np.repeat(np.arange(lo, hi), m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        ok = (comp[a] != comp[b]) & ((i[a] == j[a]) | (blk[a] != blk[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        need = _needed(n[a], n[b], percent)
        ok = np.minimum(pos[a], pos[b]) + 1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= need
        a, b, need = a[ok], b[ok], need[ok]
        most = (n[a] + n[b] - least_differences(sig, a, b)) // 2
        ok = most >= need
        a, b, most = a[ok], b[ok], most[ok]
        if not all_pairs:
            a, b = _trees(a, b, most / (n[a] + n[b] - most))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[a], key[b])), pa.array(np.maximum(key[a], key[b]))], ["a", "b"])
        lo = hi


def _trees(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, likeliest links first."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    keep = []
    for k in np.argsort(-weight, kind="stable").tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            keep.append(k)
    return a[keep], b[keep]


def _likely(hits: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """First round: trees within blocks; a shingle's classes are dealt into blocks by hash."""
    blk = F.pmod(F.xxhash64("cid", "tok"), F.ceil(F.col("c") / BLOCK)).cast("int")
    return _grouped(hits.withColumns({"i": blk, "j": blk, "blk": blk, "comp": F.col("cid")}), signs, percent, False)


def _open(hits: DataFrame, comps: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Second round: all pairs of different components.  At each shingle, blocks of the
    classes outside the largest component meet one another and the blocks of that one."""
    tagged = staged(hits.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component"), "tagged")
    by_comp = tagged.groupBy("tok", "comp").agg(F.count("*").alias("k"))
    mixed = by_comp.groupBy("tok").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("tok", F.col("top.comp").alias("main"), F.col("top.k").alias("k"))
    # written first, so that the join's sides are plain shuffles and a hot shingle can be split
    rows = tagged.join(staged(mixed, "mixed"), "tok").withColumns({"minor": F.col("comp") != F.col("main"), "few": F.ceil((F.col("c") - F.col("k")) / BLOCK).cast("int"), "rest": F.ceil(F.col("k") / BLOCK).cast("int")})
    h = F.xxhash64("cid", "tok")
    rows = rows.withColumn("blk", F.when(F.col("minor"), F.pmod(h, F.col("few"))).otherwise(F.col("few") + F.pmod(h, F.col("rest"))).cast("int"))
    upto = lambda lo, hi, f: F.transform(F.sequence(lo, hi - 1), f)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    own: Column = F.col("blk")
    meets = F.when(F.col("minor"), F.concat(upto(F.lit(0), F.col("few"), lambda x: pair(F.least(own, x), F.greatest(own, x))), upto(F.col("few"), F.col("few") + F.col("rest"), lambda x: pair(own, x)))).otherwise(upto(F.lit(0), F.col("few"), lambda x: pair(x, own)))
    dealt = rows.withColumn("g", F.explode(meets)).withColumns({"i": F.col("g.i"), "j": F.col("g.j")})
    return _grouped(dealt, signs, percent, True)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link.  One set travels a pair; the sets are compared row by row."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _whole_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``cid, hashes`` of the classes in ``pairs``, from one document (``owner``) of each class.

    A repeated id can give a class twice; that only repeats a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(150_000)
        for _, sets in in_slices(batches, 1, memo, size):
            rows = {set_key(h): h.view(np.int64) for h in sets if len(h)}
            ends = np.append(0, np.cumsum([len(h) for h in rows.values()]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows.values(), np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), lists], ["key", "hashes"])

    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = staged(nodes.join(cids, "cid", "left_semi").select("key", "cid", "owner"), "wanted")
    ids = wanted.select(F.col("owner").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "key binary, hashes array<long>")
    return found.join(wanted, "key").select("cid", "hashes")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """``key, n_shingles, component_id`` of every row; other columns are not looked at.

    ``component_id`` is the smallest ``key`` that links reach.  Rows without words (or
    text) link with nothing.  Rows with a null key take no part: their component is
    null.  Repeated rows fall into one component; rows that share a key but not the text
    are judged each by its own text.  Texts of any length are taken whole: a set is held by
    one row at a time.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        shared = staged(_dealt(rows, size, ranges_for(rows)).groupBy("bucket").applyInArrow(_answered, SHARED), "shared")
        base = staged(shared.where("idx is not null").select("doc_id", "n", "key"), "base")
        prefixes = shared.groupBy("chunk").applyInArrow(_prefixes_of(percent), "key binary, n long, first long, prefix array<long>, sig binary")
        found = staged(prefixes.groupBy("key").agg(F.first(F.struct("n", "first", "prefix", "sig")).alias("x")).select("key", "x.*"), "prefixes")
        dropped(spark, shared)
        classes = base.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("owner"))
        # a number for each class that shares a shingle of its prefix; fixed once it is written
        nodes = staged(found.join(classes, "key").withColumn("cid", F.monotonically_increasing_id()), "nodes")
        dropped(spark, found)
        at = F.when(F.col("first") < 0, 0).otherwise(F.col("first") + F.col("i"))  # look-alikes of its own: no positional filter
        tokens = nodes.select("cid", "n", "first", F.posexplode("prefix").alias("i", "tok")).select("tok", "cid", "n", at.cast("long").alias("pos"))
        met = tokens.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
        hits = staged(tokens.join(met, "tok"), "hits")
        signs = staged(nodes.select("cid", "sig").join(hits.select("cid").distinct(), "cid", "left_semi"), "signs")
        whole, names = rows.where("doc_id is not null"), nodes.select("key", "cid", "owner")
        likely = staged(_likely(hits, signs, percent), "likely")
        links = staged(_verified(likely, staged(_whole_sets(whole, names, likely, size), "whole"), percent), "links")
        comps = components(links)
        open_pairs = staged(_open(hits, comps, signs, percent), "open")
        if open_pairs.limit(1).count():
            more = staged(_verified(open_pairs, staged(_whole_sets(whole, names, open_pairs, size), "whole"), percent), "links")
            if more.limit(1).count():
                comps = components(links.unionByName(more))
        linked = staged(names.join(comps.select(F.col("node").alias("cid"), "component"), "cid"), "linked")
        least = linked.groupBy("component").agg(F.min("owner").alias("component_id"))
        by_class = staged(linked.join(least, "component").select("key", "component_id"), "by_class")
        of_class = staged(classes.join(by_class, "key", "left").select("key", F.coalesce("component_id", "owner").alias("component_id")), "of_class")
        keep(base), keep(of_class)
    final = base.join(of_class, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return final.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
