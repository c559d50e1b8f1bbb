"""Hard-negative mining by coordinate pruning within buckets of vectors of similar length.

Vectors are scaled to integers, ordered by length and dealt into buckets.  A bucket holds a sorted list
of each coordinate of its unit vectors.  An anchor that needs a score of at least t asks a bucket only if its
longest vector can reach t (Cauchy-Schwarz).  Then t gives an angle, and the angle a range of values that
is feasible on each of the anchor's largest coordinates; the parts of the sorted lists within the ranges
intersect to the candidates, whose integer inner products alone decide.

Positives come first: the longest vectors give each anchor a threshold, all others follow in
parallel.  Negatives are wanted between a share of a positive's score and that score, so the share is
their threshold.  Anchors are taken in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged
from .ranked import NONE, best

#: Bytes of anchors in a block; rows and numbers of a bucket; vectors that give the first thresholds.
BLOCK_BYTES, BUCKET, ENTRIES, FIRST = 16 << 20, 1024, 1 << 20, 4096
#: Coordinates of an anchor that thin out a bucket, and what rounding may add to a bound.
FOCUS, SLACK = 5, 1e-9
COLUMNS = "row long, id long, label long, v array<long>, dims int, length double"
LOW = -(1 << 62)


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """``row, id, label, v, dims, length`` of rows that take part, ordered by length within equal dims; ``v`` is floor(scale * x)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(label).isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.withColumns({"dims": F.size("v"), "length": F.sqrt(square)})
    order = ["dims", F.desc("length")]
    return rows.repartitionByRange(*order, F.xxhash64("row")).sortWithinPartitions(*order)


class Anchors:
    """A block of anchors by their number of dimensions."""

    def __init__(self, table: pa.Table):
        self.n, self.ids = table.num_rows, table.column("id").to_pylist()
        self.row, self.label, dims = (table.column(c).to_numpy() for c in ("row", "label", "dims"))
        self.vector, self.length, self.focus, self.of = [], np.zeros(self.n), [], {}
        for i, (v, d) in enumerate(zip(table.column("v").to_pylist(), dims.tolist(), strict=True)):
            x = np.array(v, np.int64)
            self.vector.append(x)
            self.length[i] = np.linalg.norm(x.astype(np.float64))
            unit = x / max(self.length[i], 1e-300)
            self.focus.append([(int(f), float(unit[f])) for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]])
            self.of.setdefault(d, []).append(i)
        self.of = {d: np.array(x) for d, x in self.of.items()}


class Bucket:
    """Rows of similar length: integers, and sorted lists of each coordinate of the unit vectors."""

    def __init__(self, part: pa.RecordBatch):
        self.row, self.label, self.length = (part.column(i).to_numpy() for i in (0, 2, 5))
        self.null, self.id = np.array(part.column(1).is_null()), part.column(1).fill_null(0).to_numpy()
        self.n, self.dims, self.longest = part.num_rows, part.column(4)[0].as_py(), float(self.length.max())
        self.v = part.column(3).flatten().to_numpy().reshape(self.n, self.dims)
        self.largest = int(np.abs(self.v).max()) if self.v.size else 0
        self.real, self.lists, self.order = self.v.astype(np.float64), None, None

    def sort(self) -> None:
        if self.lists is None:
            unit = self.real / np.maximum(self.length, 1e-300)[:, None]
            self.order = np.argsort(unit, axis=0)
            self.lists = np.take_along_axis(unit, self.order, 0)

    def feasible(self, focus: list[tuple[int, float]], angle: float) -> np.ndarray | None:
        """Rows within the feasible ranges of all focus coordinates; None: all rows."""
        if angle <= 0:
            return None
        self.sort()
        angle, hits, lists = min(1.0, angle), None, 0
        for f, q in focus:
            spread = math.sqrt(max(0.0, 1 - q * q) * (1 - angle * angle))
            low = -1.0 if q <= -angle else q * angle - spread
            high = 1.0 if q >= angle else q * angle + spread
            first, last = np.searchsorted(self.lists[:, f], low - SLACK, "left"), np.searchsorted(self.lists[:, f], high + SLACK, "right")
            if last - first == self.n:
                continue
            if last <= first:
                return np.zeros(0, np.int64)
            hits = np.zeros(self.n, np.int8) if hits is None else hits
            hits[self.order[first:last, f]] += 1
            lists += 1
        return None if hits is None else np.flatnonzero(hits == lists)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        most = self.largest * (int(np.abs(anchor).max()) if len(anchor) else 0) * self.dims
        if most < 1 << 53:  # sums of doubles are exact then
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return self.v[rows] @ anchor
        raise OverflowError("inner products of these vectors do not fit in 64 bits")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for b in batches:
        dims, at = b.column(4).to_numpy(), 0
        while at < b.num_rows:
            same = int(np.argmax(np.append(dims[at:] != dims[at], True)))
            rows = max(1, min(same, BUCKET, ENTRIES // max(1, int(dims[at]))))
            yield Bucket(b.slice(at, rows))
            at += rows


def _merged(found, score, null, key, k):
    s, x, y = (np.concatenate(z) for z in zip(found, (score, null, key), strict=True))
    first = best(s, x, y, k)
    return s[first], x[first], y[first]


def _asked(bucket: Bucket, anchors: Anchors, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Anchors whose threshold ``least`` the bucket may reach, each with the rows that may."""
    of = anchors.of.get(bucket.dims)
    if of is None:
        return
    for i in of[(anchors.length[of] * bucket.longest * (1 + SLACK) >= least[of])].tolist():
        both = anchors.length[i] * bucket.longest
        rows = bucket.feasible(anchors.focus[i], least[i] / both - SLACK if both and least[i] > 0 else 0.0)
        rows = np.arange(bucket.n) if rows is None else rows
        if len(rows):
            yield i, rows


def positives(rows: DataFrame, block, k: int, least=None) -> DataFrame:
    """``anchor, id, score``: each task's ``k`` best other rows of an anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        theta = least.value.copy() if least is not None else np.full(anchors.n, LOW, np.int64)
        found = [NONE] * anchors.n
        for bucket in _buckets(batches):
            for i, at in _asked(bucket, anchors, theta):
                at = at[(bucket.label[at] == anchors.label[i]) & (bucket.row[at] != anchors.row[i])]
                score = bucket.scores(anchors.vector[i], at)
                good = score >= theta[i]
                if good.any():
                    at = at[good]
                    found[i] = _merged(found[i], score[good], bucket.null[at], bucket.id[at], k)
                    if len(found[i][0]) == k:
                        theta[i] = max(theta[i], found[i][0][-1])
        for i, (s, x, y) in enumerate(found):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array(y, mask=x), pa.array(s)], ["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor long, id long, score long")


def negatives(rows: DataFrame, block, wanted, k: int, percent: int) -> DataFrame:
    """``anchor, score_of_positive, id, score``: each task's ``k`` best rows of other labels for each score of a positive,
    from ``percent`` of it to all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, tops = block.value, wanted.value
        # 100 * score >= percent * top, in whole numbers
        least = {i: {t: -(-percent * t // 100) for t in x if t >= 0} for i, x in tops.items()}
        theta = np.full(anchors.n, 1 << 62, np.int64)
        for i, x in least.items():
            theta[i] = min(x.values(), default=1 << 62)
        found = {(i, t): NONE for i, x in least.items() for t in x}
        for bucket in _buckets(batches):
            for i, at in _asked(bucket, anchors, theta):
                if not least.get(i):
                    continue
                at = at[bucket.label[at] != anchors.label[i]]
                score = bucket.scores(anchors.vector[i], at)
                for top, low in least[i].items():
                    good = (score >= low) & (score <= top)
                    if good.any():
                        of = at[good]
                        found[i, top] = _merged(found[i, top], score[good], bucket.null[of], bucket.id[of], k)
                        if len(found[i, top][0]) == k:
                            least[i][top] = max(low, int(found[i, top][0][-1]))
                theta[i] = min(least[i].values())
        for (i, top), (s, x, y) in found.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array([top] * len(s), pa.int64()), pa.array(y, mask=x), pa.array(s)], ["anchor", "score_of_positive", "id", "score"])

    return rows.mapInArrow(run, "anchor long, score_of_positive long, id long, score long")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose key is a multiple of ``every``; a score is the inner product of integers.  An anchor's
    positives are the ``n_positives`` best other rows of its label; each has the ``n_negatives`` best rows of other labels
    with ``percent`` * positive_score <= 100 * negative_score <= 100 * positive_score.  Equal scores go by smaller
    key, null last.  Rows with a null label or vector, or a null or non-finite number, take no part; null keys are no
    anchors.  Only vectors of equal length are compared.  Repeated rows count one by one, also as anchors; other columns are
    not looked at.  Scores beyond 64 bits raise an error.
    """
    spark, out = vectors.sparkSession, None
    rows = staged(integers(vectors, key, vector, label, scale), "length-buckets")
    chosen = rows.where(F.col("id") % every == 0)
    blocks = -(-8 * (chosen.agg(F.sum(F.col("dims") + 8)).first()[0] or 0) // BLOCK_BYTES)
    shortest = rows.select("length").orderBy(F.desc("length")).limit(FIRST).agg(F.min("length")).first()[0] or 0.0
    send = spark.sparkContext.broadcast
    for number in range(blocks):
        anchors = Anchors(chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).toArrow())
        block = send(anchors)
        first = staged(_ranked(positives(rows.where(F.col("length") >= shortest), block, n_positives), n_positives, "anchor").drop("rank"), "first")
        kth = first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == n_positives).toPandas()
        least = np.full(anchors.n, LOW, np.int64)
        least[kth["anchor"].to_numpy(np.int64)] = kth["least"].to_numpy(np.int64)
        rest = positives(rows.where(F.col("length") < shortest), block, n_positives, send(least))
        best_of = staged(_ranked(first.unionByName(rest), n_positives, "anchor").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        tops = {r.anchor: r.tops for r in best_of.groupBy("anchor").agg(F.collect_set("positive_score").alias("tops")).toLocalIterator()}
        hard = _ranked(negatives(rows, block, send(tops), n_negatives, percent), n_negatives, "anchor", "score_of_positive")
        names = spark.createDataFrame([*enumerate(anchors.ids)], "anchor long, anchor_id long")
        joined = best_of.join(hard.withColumnRenamed("anchor", "of"), (F.col("anchor") == F.col("of")) & (F.col("positive_score") == F.col("score_of_positive"))).join(names, "anchor")
        found = staged(joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        dropped(spark, first, best_of)
        out = found if out is None else out.unionByName(found)
    dropped(spark, rows)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out
