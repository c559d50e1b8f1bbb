"""Embedding near-dedup by NN-descent.

Equal vectors form one class.  The first neighbour graph comes from blocks of
vectors that are close in a few random projections.  Each round joins every
vector's neighbours (forward and backward) around it and offers them to each other;
the best ``k`` stay.  Where a list is saturated (every neighbour is over the
threshold) it is enlarged to all vectors that threshold edges reach, compared in blocks of
bounded size.  Links are counted there, so a large group costs no row a link.  A saturated
list can hide links with other components, so its vector searches again, only outside its
component, until that joins nothing more.  Recall is audited against brute force on every
hundredth id (256 vectors at least); below the goal the search goes on with new projections,
and after the last one all vectors are compared in blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, scratch, staged
from .components import components

THRESHOLD, NEIGHBOURS, BACKWARD, TREES, LEAF, BLOCK = 0.9, 6, 6, 4, 128, 512
#: Rounds end when this share of a graph's edges or less is new, or after so many.
UPDATES, MOST_ROUNDS = 0.05, 8
AUDIT, AUDIT_BLOCK, GOAL, MOST_SEARCHES, FRUITLESS = 256, 4096, 0.97, 4, 2
log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from a column of equal-length float lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of vectors that are not null, hold only finite numbers and are not zero."""
    v = F.col(vector)
    fine = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v") if "float" in dict(vectors.dtypes)[vector] else v.cast("array<double>").alias("v"))


def bits_for(n: int) -> int:
    """Signs of a code: about as many codes as blocks of LEAF vectors."""
    return min(40, max(4, (max(n, 1) // LEAF).bit_length()))


def _leaves(classes: DataFrame, dims: int, seed: int, k: int, bits: int) -> DataFrame:
    """``u, v, sim``: the best ``k`` neighbours (of other components) in blocks of vectors that random
    projections bring together.  All TREES projections are dealt in one shuffle."""
    planes = np.random.default_rng(seed).normal(size=(TREES, dims, bits + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else ()
            for t in range(TREES if b.num_rows else 0):
                p = x @ planes[t]
                code = ((p[:, :bits] > 0) << np.arange(bits, dtype=np.int64)).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t] * b.num_rows, pa.int32()), pa.array(code.astype(np.int64)), pa.array(p[:, bits])], ["id", "v", "component", "tree", "code", "p"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree = b.column(3).to_numpy()
            ends = [*np.flatnonzero(np.diff(tree)) + 1, len(tree)]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                for lo in range(start, end, LEAF):
                    part = b.slice(lo, min(LEAF, end - lo))
                    if part.num_rows > 1:
                        yield _best_of(part.column(0).to_numpy(), _matrix(part.column(1)), part.column(2).to_numpy(), k)

    kind = dict(classes.dtypes)["v"]
    placed = classes.select("id", "v", "component").mapInArrow(place, f"id long, v {kind}, component long, tree int, code long, p double")
    order = ["tree", "code", "p"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(best, "u long, v long, sim double")


def _best_of(ids: np.ndarray, x: np.ndarray, component: np.ndarray, k: int, least: np.ndarray | None = None) -> pa.RecordBatch:
    """The best ``k`` of other components for each row, over ``least`` if given."""
    s = x @ x.T
    s[component[:, None] == component[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["u", "v", "sim"])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, v, sim = np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()
    ok = sim > (-2 if least is None else np.repeat(least, k))
    u, v, sim = u[ok], v[ok], sim[ok]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim)], ["u", "v", "sim"])


def _kept(offers: DataFrame, k: int) -> DataFrame:
    """The best ``k`` offers of each vector; ``old`` tells which were in the graph before."""
    if "old" not in offers.columns:
        offers = offers.withColumn("old", F.lit(False))
    one = offers.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= k).drop("r")


def _round(graph: DataFrame, classes: DataFrame, k: int, inner: DataFrame | None = None) -> DataFrame:
    """One neighbours-of-neighbours join, also over the edges of ``inner``."""
    lists = graph
    if inner is not None:
        graph = graph.unionByName(inner)
    back = graph.select(F.col("v").alias("p"), F.col("u").alias("m"), "sim").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("sim"), "m"))).where(F.col("r") <= BACKWARD).select("p", "m")
    own = classes.select(F.col("id").alias("p"), F.col("id").alias("m"))
    members = graph.select(F.col("u").alias("p"), F.col("v").alias("m")).unionByName(back).unionByName(own).distinct()
    least = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("least"))
    known = classes.select("id", "v", "component").join(least, F.col("id") == F.col("u"), "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"), "component")
    rows = members.join(known, F.col("m") == F.col("id")).select("p", "m", "v", "least", "component").repartition("p").sortWithinPartitions("p")

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            p = t.column(0).to_numpy()
            cut = int(np.searchsorted(p, p[-1])) if len(p) else 0
            yield from groups(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None:
            yield from groups(rest)

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        p, m, least, component = (t.column(i).to_numpy() for i in (0, 1, 3, 4))
        x = _matrix(t.column(2).chunk(0))
        bounds = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                out.append(_best_of(m[lo:hi], x[lo:hi], component[lo:hi], k, least[lo:hi]))
            if len(out) >= 2000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(len(o) for o in out) else out[0]
                out = []
        if sum(len(o) for o in out):
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return rows.mapInArrow(offer, "u long, v long, sim double")


def _compared(classes: DataFrame, comps: DataFrame, threshold: float, trees: bool = False) -> DataFrame:
    """``id, others, root``: weight of the other classes of its component that link with a class, by pair of blocks.

    A component is dealt into blocks by hash; each pair of blocks is compared at once.  With
    ``trees``, ``root`` is the smallest id that the links of the pair of blocks reach; else it is the id.
    """
    rows = classes.drop("component").join(comps, F.col("id") == F.col("node")).select("component", "id", "v", "weight")
    sizes = staged(comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "sizes")
    placed = rows.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = placed.withColumn("o", other).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).select("component", "i", "j", "b", "id", "v", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            c, i, j = (t.column(x).to_numpy() for x in (0, 1, 2))
            new = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            yield from groups(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from groups(rest)

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        c, i, j, b, ids, w = (t.column(x).to_numpy() for x in (0, 1, 2, 3, 4, 6))
        v = t.column(5).chunk(0)
        bounds = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(c)]])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            x = _matrix(v.slice(lo, hi - lo))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if i[lo] != j[lo]:
                linked &= b[lo:hi, None] != b[None, lo:hi]
            root = _roots(linked, ids[lo:hi]) if trees else ids[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(linked @ w[lo:hi].astype(np.int64)), pa.array(root)], ["id", "others", "root"])

    return dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(count, "id long, others long, root long")


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that links reach from each row."""
    root, a, b = ids.copy(), *np.nonzero(linked)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        if (new == root).all():
            return root
        root = new


def _counted(classes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """``id, others``: weight of the other classes of its component that link with a class."""
    return _compared(classes, comps, threshold).groupBy("id").agg(F.sum("others").alias("others"))


def exact(classes: DataFrame, of: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``node, component`` and ``id, others`` by comparing all classes with equal ``of``, in blocks."""
    comps = classes.select(F.col("id").alias("node"), of.cast("long").alias("component"))
    pairs = staged(_compared(classes, comps, threshold, trees=True), "pairs")
    return staged(components(pairs.select(F.col("root").alias("a"), F.col("id").alias("b"))), "components"), pairs.groupBy("id").agg(F.sum("others").alias("others"))


def audit(classes: DataFrame, others: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of the true links that were found, of the classes whose id is a multiple of 100 and of ``queries`` classes chosen by hash of the id."""
    picked = classes.orderBy(F.xxhash64("id")).limit(queries).select("id").unionByName(classes.where(F.col("id") % 100 == 0).select("id")).distinct()
    chosen = staged(classes.join(picked, "id", "left_semi").select("id", "v", "weight"), "audited")
    parts, true = -(-chosen.count() // AUDIT_BLOCK), 0
    for part in range(parts):  # about AUDIT_BLOCK vectors at once
        q = chosen.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        true += _true_links(classes, q.select("id", "v").toPandas(), threshold)
    own = chosen.join(others, "id", "left").agg(F.sum("weight").alias("own"), F.sum(F.coalesce("others", F.lit(0))).alias("found")).first()
    true, found = true - (own.own or 0), own.found or 0
    return found / true if true else 1.0


def _true_links(classes: DataFrame, chosen: pd.DataFrame, threshold: float) -> int:
    """Weight of the classes that link with each of ``chosen``, itself included, in all."""
    if not len(chosen):
        return 0
    q = np.array(chosen["v"].tolist(), np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids = chosen["id"].to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                own = part.column(0).to_numpy()
                linked = (q @ _matrix(part.column(1)).T >= threshold) | (ids[:, None] == own[None, :])
                total += int((linked @ part.column(2).to_numpy()).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return classes.select("id", "v", "weight").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def _graph(of: DataFrame, dims: int, bits: int, seed: int, k: int, offers: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """``u, v, sim``: the best ``k`` of other components, from new projections and ``offers``, refined
    until hardly any edge is new."""
    new = _leaves(of, dims, seed, k, bits)
    offers = new if offers is None else offers.unionByName(new)
    graph = staged(_kept(offers, k).drop("old"), "graph")
    for _ in range(MOST_ROUNDS):
        offers = graph.withColumn("old", F.lit(True)).unionByName(_round(graph, of, k, inner).withColumn("old", F.lit(False)))
        before, now = graph, staged(_kept(offers, k), "graph")
        fresh = now.agg(F.avg(F.when(F.col("old"), 0.0).otherwise(1.0))).first()[0] or 0.0
        graph = now.drop("old")
        dropped(of.sparkSession, before)
        if fresh <= UPDATES:
            break
    return graph


def _links(graph: DataFrame, threshold: float) -> DataFrame:
    return staged(graph.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")


def _joined(of: DataFrame, graph: DataFrame, dims: int, bits: int, seed: int, k: int, threshold: float) -> DataFrame:
    """``node, component`` by the links of ``graph`` and those that its saturated lists have no place for.

    Vectors with ``k`` links search outside their component until FRUITLESS searches in a row join nothing.
    """
    edges = _links(graph, threshold)
    comps = staged(components(edges), "components")
    full = staged(graph.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("least") >= threshold)).select(F.col("u").alias("id")), "full")
    if not full.limit(1).count():
        return comps
    inner = graph.join(full, F.col("u") == F.col("id"), "left_semi").join(full.select(F.col("id").alias("w")), F.col("v") == F.col("w"), "left_semi")
    seed, fruitless = seed + 1, 0
    while fruitless < FRUITLESS:
        outside = staged(of.drop("component").join(full, "id", "left_semi").join(comps, F.col("id") == F.col("node")).drop("node"), "outside")
        if outside.select("component").distinct().limit(2).count() < 2:
            break
        beyond = _graph(outside, dims, bits, seed, k, inner=inner)
        more = _links(beyond, threshold)
        seed += 1
        if more.limit(1).count():
            edges, fruitless = edges.unionByName(more), 0
            comps = staged(components(edges), "components")
        else:
            fruitless += 1
    return comps


def _searched(classes: DataFrame, dims: int, n: int, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """``node, component`` and ``id, others`` of the ``n`` vectors of one length."""
    of, graph, bits = classes.withColumn("component", F.col("id")), None, bits_for(n)
    for search in range(MOST_SEARCHES):
        graph = _graph(of, dims, bits, 1000 * search, k, graph)
        comps = _joined(of, graph, dims, bits, 1000 * search, k, threshold)
        others = staged(_counted(of, comps, threshold), "others")
        recall = audit(of, others, threshold)
        log.info("search %d: audited recall %.4f", search, recall)
        if recall >= GOAL:
            return comps, others
    log.warning("recall still below the goal after %d searches: comparing all vectors", MOST_SEARCHES)
    return exact(classes, F.lit(0), threshold)


def vector_key(v: str) -> Column:
    """160 bits that stand for a vector."""
    return F.struct(F.xxhash64(v), F.xxhash64(F.reverse(v)), F.hash(v))


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Null and zero vectors, such with null or non-finite numbers and rows with a null
    key link with nothing.  Only vectors of equal length link; each length has a search of
    its own, but lengths of at most BLOCK different vectors, save the most frequent one, are
    compared whole.  Equal vectors link.  Ties in similarity go to the smaller id and change no
    result; of repeated keys one row's vector counts for all; an empty table gives no rows; other columns are not looked at.
    """
    with scratch(vectors.sparkSession) as keep:
        every = usable(vectors, key, vector)
        hashed = every.withColumn("h", vector_key("v"))
        classes = staged(hashed.groupBy("h").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("weight")), "classes")
        size = F.size("v")
        lengths = staged(classes.groupBy(size.alias("d")).count(), "lengths")
        first = {r.d: r["count"] for r in lengths.orderBy(F.desc("count"), "d").limit(1).collect()}
        large = first | {r.d: r["count"] for r in lengths.where((F.col("count") > BLOCK) & ~F.col("d").isin(*first)).collect()}
        found = [_searched(classes.where(size == d), d, n, threshold, k) for d, n in large.items()]
        if not large or lengths.where((F.col("count") > 1) & ~F.col("d").isin(*large)).limit(1).count():
            found.append(exact(classes.where(~size.isin(*large)), size, threshold))
        comps, others = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
        named = classes.join(comps, F.col("id") == F.col("node"), "left").join(others, "id", "left")
        table = keep(staged(named.select("h", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named"))
    base = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    fine = usable(base, "key", "v").select("id", vector_key("v").alias("h"))
    linked = staged(fine, "hashed").join(table, "h").select("id", "n_links", "component_id").dropDuplicates(["id"])
    rows = base.select("key").join(linked, F.col("key") == F.col("id"), "left")
    out = rows.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("key").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
