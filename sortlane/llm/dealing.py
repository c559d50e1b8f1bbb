"""Hashes dealt into ranges: which of them occur more than once in a corpus?

Tasks gather the hashes of some rows (a chunk) and send each range of the hash space one
row with all of the chunk's hashes in it.  A range gets the rows of all chunks
(``groupBy("bucket").applyInArrow``) and answers each chunk; rows that stand for the chunk
itself have a negative bucket and pass.  The number of ranges follows the size of the
corpus, so a range stays small.  In a row, hashes are sorted and numbers are written by
byte planes, which compress well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for each range of the hash space.
RANGE_BYTES = 4 << 20
LOW = np.uint64(32)


def ranges_for(docs: DataFrame, text: str = "text") -> int:
    """Number of ranges for a corpus: one for RANGE_BYTES of text, but one a shuffle partition at least."""
    return max(parts_for(docs, RANGE_BYTES, text), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parts_for(docs: DataFrame, size: int, text: str = "text") -> int:
    """Number of parts of about ``size`` bytes of text each."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-n_bytes // size))


def placed(h: np.ndarray, ranges: int) -> np.ndarray:
    """Hashes as range (above) and the low 32 bits of the hash."""
    return ((h >> LOW) * np.uint64(ranges) >> LOW) << LOW | h & np.uint64(0xFFFFFFFF)


def cuts(t: np.ndarray) -> np.ndarray:
    """Where the ranges of sorted ``placed`` hashes begin, and the end."""
    r = t >> LOW
    return np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(t)]]) if len(t) else np.zeros(1, np.int64)


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first all low ones; high ones that are equal compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(int(kind[-1]), -1).T.copy().view(kind).ravel() if raw else np.zeros(0, kind)


def rises(t: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as planes of their differences."""
    x = t.astype("<u4")
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unrisen(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, "<u4"), dtype=np.uint32)


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in columns.split(", ")])


def batch_of(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch with these columns; the others are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def passed(group: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows as they are, with nulls in the columns that they lack."""
    return pa.Table.from_arrays([group.column(f.name) if f.name in group.column_names else pa.nulls(group.num_rows, f.type) for f in schema], schema=schema)


def is_chunk(group: pa.Table) -> bool:
    return not group.num_rows or group.column("bucket")[0].as_py() < 0
