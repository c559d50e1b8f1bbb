"""Ranked lexical search over buckets of impact vectors by length.

A document's vector holds the integer impact of each query term that it has; a term's weight is
shared between both sides (its root on each), so a score is the inner product of the query's and the
document's vector.  Documents are ordered by the length of their vectors and dealt into buckets.
Cauchy-Schwarz tells whether a bucket can hold a document that beats a query's k-th score; if so,
the ranges of values that are feasible on the query's largest coordinates (the longest of a bucket, and
an angle that the product needs) thin out the bucket's sorted lists.  What is left is scored again in
integers, which alone decide.

The longest vectors go first and give every query a threshold; all others follow in parallel and
raise it within their task.  Queries are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

#: Bytes of query text in a block; rows and list entries of a bucket; vectors that give the first thresholds.
BLOCK_BYTES, BUCKET, ENTRIES, FIRST = 4 << 20, 1024, 1 << 20, 4096
#: Coordinates of a query that thin out a bucket, and what rounding may add to a bound.
FOCUS, SLACK = 4, 1e-9
#: Fixed values of the score: b in percent, 1000 and 8 in the saturation, the scale of an impact.
SLOPE, SATURATION, PERCENT_STEP, SCALE = 75, 1000, 8, 1_000_000_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: UTF-8 bytes: what parts terms becomes a blank, A-Z are lower-cased, all else stays.
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def counted(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """``key, n, terms, tfs`` of documents with a term: ``n`` counts all terms, the lists only those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for b in batches:
            keys, n, terms, tfs, ends, rows = b.column(0), [], [], [], [0], []
            for row, raw in enumerate(b.column(1)):
                words = terms_of(raw.as_buffer().to_pybytes()) if raw.is_valid else ()
                if not words:
                    continue
                found, count = np.unique(np.array([x for w in words if (x := get(w)) is not None], np.int32), return_counts=True)
                rows.append(row)
                n.append(len(words))
                terms.append(found)
                tfs.append(count)
                ends.append(ends[-1] + len(found))
            if rows:
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(n, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, n long, terms array<int>, tfs array<long>")


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where the lists begin in ``flatten()``, and the end."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0] if len(ends) else ends


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    df, out = vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas(), np.zeros(size, np.int64)
    out[df["term"].to_numpy(np.int64)] = df["df"].to_numpy(np.int64)
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(vectors: DataFrame, weight, documents: int, terms: int) -> DataFrame:
    """``key, length, terms, impacts`` of documents with a term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for b in batches:
            lists = b.column(2)
            ends, flat, tf = _ends(lists), lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()
            m = np.array([100 - SLOPE + SLOPE * x * documents // terms for x in b.column(1).to_pylist()], np.int64)
            impact = SCALE * tf // (SATURATION * tf + PERCENT_STEP * np.repeat(m, np.diff(ends)))
            length = np.sqrt(np.add.reduceat(w[flat] * impact.astype(np.float64) ** 2, ends[:-1])) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length), lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(impact.astype(np.int32)))], ["key", "length", "terms", "impacts"])

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "key long, length double, terms array<int>, impacts array<int>")


class Query:
    """A query's vector: ids, integer weights (repeats counted) and root-shared coordinates."""

    def __init__(self, ids: np.ndarray, repeats: np.ndarray, w: np.ndarray):
        of = w[ids]
        some = of > 0
        self.ids, self.weight = ids[some], (of * repeats)[some]
        x = repeats[some] * np.sqrt(of[some].astype(np.float64))
        self.length = float(np.linalg.norm(x))
        self.most = int(self.weight.sum()) * SCALE // SATURATION
        focus = np.argsort(-x, kind="stable")[:FOCUS]
        self.focus = [(int(self.ids[i]), float(x[i] / self.length)) for i in focus]


class Bucket:
    """Vectors of similar length as lists by term: rows, impacts, and coordinates of unit vectors in falling order."""

    def __init__(self, length: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, w: np.ndarray):
        self.n, self.longest = len(length), float(length.max())
        rows = np.repeat(np.arange(self.n), np.diff(ends))
        unit = impact * np.sqrt(w[terms].astype(np.float64)) / np.maximum(length, 1e-300)[rows]
        order = np.lexsort((-unit, terms))
        self.rows, self.impact, self.unit = rows[order], impact[order].astype(np.int64), unit[order]
        held, start = np.unique(terms[order], return_index=True)
        self.at = dict(zip(held.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True), strict=True))

    def feasible(self, query: Query, angle: float) -> np.ndarray | None:
        """Rows whose coordinates may reach ``angle`` with the query; None: all."""
        if angle <= 0:
            return None
        fits = None
        for term, q in query.focus:
            spread = math.sqrt(max(0.0, 1 - q * q) * max(0.0, 1 - min(1.0, angle) ** 2))
            low, high = q * angle - spread - SLACK, (1.0 if q >= angle else q * angle + spread) + SLACK
            if low <= 0 and high >= 1:
                continue
            start, end = self.at.get(term, (0, 0))
            falling = -self.unit[start:end]
            first, last = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            if low > 0:  # only rows of the list, within the range
                own = np.zeros(self.n, bool)
                own[self.rows[start + first : start + last]] = True
            else:  # all but those of the list beyond the range
                own = np.ones(self.n, bool)
                own[self.rows[start : start + first]] = False
            fits = own if fits is None else fits & own
            if not fits.any():
                break
        return fits

    def scores(self, query: Query) -> np.ndarray:
        spans = [(self.at[t], x) for t, x in zip(query.ids.tolist(), query.weight.tolist(), strict=True) if t in self.at]
        if not spans:
            return np.zeros(self.n, np.int64)
        rows = np.concatenate([self.rows[a:z] for (a, z), _ in spans])
        parts = np.concatenate([self.impact[a:z] * x for (a, z), x in spans])
        if query.most < 1 << 52:  # sums of doubles are exact then
            return np.bincount(rows, weights=parts, minlength=self.n).astype(np.int64)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, rows, parts)
        return out


def best(score: np.ndarray, null: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first: higher scores, then smaller keys, null last."""
    return np.lexsort((key, null, -score))[:k]


#: No scores, null marks and keys.
NONE = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def searched(vectors: DataFrame, queries, weight, k: int, least=None) -> DataFrame:
    """``item, key, score``: each task's ``k`` best documents of each query that may be among the best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = queries.value, weight.value
        known = least.value if least is not None else np.zeros(len(asked), np.int64)
        theta, lengths, found = known.copy(), np.array([q.length for q in asked]), [NONE] * len(asked)
        for b in batches:
            at = 0
            while at < b.num_rows:
                ends = _ends(b.column(2).slice(at, BUCKET))
                rows = max(1, min(len(ends) - 1, int(np.searchsorted(ends, ENTRIES, "right")) - 1))
                part = b.slice(at, rows)
                at += rows
                lists, length = part.column(2), part.column(1).to_numpy()
                # Cauchy-Schwarz: queries for which the bucket's longest vector may reach the threshold
                active = np.flatnonzero((lengths * length.max() * (1 + SLACK) >= theta) & (lengths > 0))
                if not len(active):
                    continue
                bucket = Bucket(length, _ends(lists), lists.flatten().to_numpy(), part.column(3).flatten().to_numpy(), w)
                null = np.array(part.column(0).is_null())
                keys = part.column(0).fill_null(0).to_numpy()
                for i in active.tolist():
                    q = asked[i]
                    fits = bucket.feasible(q, theta[i] / (q.length * bucket.longest) - SLACK if bucket.longest else 0.0)
                    if fits is not None and not fits.any():
                        continue
                    score = bucket.scores(q)
                    good = score >= max(1, theta[i])
                    rows_of = np.flatnonzero(good if fits is None else good & fits)
                    if len(rows_of):
                        s, x, y = (np.concatenate(z) for z in zip((score[rows_of], null[rows_of], keys[rows_of]), found[i], strict=True))
                        first = best(s, x, y, k)
                        found[i] = s[first], x[first], y[first]
                        if len(first) == k:
                            theta[i] = max(theta[i], int(found[i][0][-1]))
        for i, x in enumerate(found):
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x[0]), pa.int64()), pa.array(x[2], mask=x[1]), pa.array(x[0])], ["item", "key", "score"])

    return vectors.mapInArrow(run, "item long, key long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: the ``k`` best documents of every item, with a score above 0.

    Keys of documents and items are integers.  Equal scores go by smaller key, null last; repeated rows
    are documents, and items, of their own.  Null and empty texts have no terms: such documents are not
    counted, such items have no rows.  Whole texts count, however long; other columns are not looked at.
    """
    spark, out, temporary = docs.sparkSession, None, []
    asked = staged(items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("binary").alias("text")), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for block in range(blocks):
        of = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        bags = [Counter(terms_of(t or b"")) for t in of.column("text").to_pylist()]
        names = sorted(set().union(*bags))
        ids = {x: i for i, x in enumerate(names)}
        send = spark.sparkContext.broadcast
        vectors = staged(counted(docs, key, text, send(ids)), "terms")
        total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total.n or not names:
            dropped(spark, vectors)
            continue
        w = weights(document_counts(vectors, len(names)), total.n)
        queries = send([Query(np.array([ids[t] for t in bag], np.int64), np.array([*bag.values()], np.int64), w) for bag in bags])
        weight = send(w)
        made = impacts(vectors, weight, total.n, total.terms).withColumn("h", F.xxhash64("key"))
        buckets = staged(made.repartitionByRange(F.desc("length"), "h").sortWithinPartitions(F.desc("length")).drop("h"), "buckets")
        dropped(spark, vectors)
        shortest = buckets.select("length").orderBy(F.desc("length")).limit(FIRST).agg(F.min("length")).first()[0] or 0.0
        long = staged(_first(searched(buckets.where(F.col("length") >= shortest), queries, weight, k), k).drop("rank"), "first")
        kth = long.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toPandas()
        least = np.zeros(len(bags), np.int64)
        least[kth["item"].to_numpy(np.int64)] = kth["least"].to_numpy(np.int64)
        rest = searched(buckets.where(F.col("length") < shortest), queries, weight, k, send(least))
        names_of = spark.createDataFrame([*enumerate(of.column("item").to_pylist())], "item long, name long")
        ranked = _first(long.unionByName(rest), k).join(F.broadcast(names_of), "item")
        found = staged(ranked.select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score"), "ranked")
        dropped(spark, buckets, long)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"{item} long, rank int, {key} long, score long") if out is None else out
