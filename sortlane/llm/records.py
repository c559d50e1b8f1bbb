"""Token ids in files of length-delimited binary records.

A record is: length (8 bytes), masked checksum of the length bytes (4), the
serialized ids, masked checksum of those (4); all little-endian.  The checksum is
CRC-32, rotated right by 15 bits and moved by a constant, so that the checksum of
data that holds checksums stays useful.  Ids take 2 bytes where the vocabulary
fits, else 4.  Beside each data file stands an index file with one fixed-size
entry a record, so that a reader can seek to records in any order.

Each task writes files with names of its own; only the files that the manifest
names count, and Spark commits the manifest.  A lost or repeated task therefore
leaves at most files that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import filesystem, shared_path, staged
from .piece_codec import lists_of
from .tokens import encoder

#: Fixed values of the file format.
MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("first", "<u8"), ("count", "<u8")])
#: So many bytes of records are read at once.
READ_BYTES = 1 << 20
MANIFEST = "part int, path string, width int, n_records long, n_ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """The record at a place and the place behind it; raises on a wrong checksum."""
    head = raw[at : at + 8]
    (n,), (crc,) = struct.unpack("<Q", head), struct.unpack("<I", raw[at + 8 : at + 12])
    if crc != masked(head):
        raise ValueError(f"broken length at byte {at}")
    data = raw[at + 12 : at + 12 + n]
    if len(data) != n or struct.unpack("<I", raw[at + 12 + n : at + 16 + n])[0] != masked(data):
        raise ValueError(f"broken record at byte {at}")
    return data, at + 16 + n


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every row and write the records in ascending order of ``key``.

    Returns the manifest, one row a file; files in order of ``part`` hold the rows
    in order of ``key`` (null first, equal keys by a hash of the text, then by the text).
    Null text counts as empty, repeated rows get a record each, other columns are not
    looked at.  One record is held at a time, however long its text.  An empty table
    gives an empty manifest.
    """
    folder = shared_path(docs.sparkSession, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, at, n_ids, n_records, out = encoder(tokenizer_path), None, 0, 0, 0, None
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        tail = np.array([] if end_id is None else [end_id], "<u4")
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = filesystem(folder)
                fs.create_dir(path, recursive=True)
                out, index = (fs.open_output_stream(f"{path}/{name}.{x}") for x in ("records", "index"))
            entries = []
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate([ids, tail])
                raw = frame(ids.astype(kind).tobytes())
                out.write(raw)
                entries.append((k or 0, k is not None, at, len(raw), n_ids, len(ids)))
                at += len(raw)
                n_ids += len(ids)
            if entries:
                index.write(np.array(entries, INDEX).tobytes())
                n_records += len(entries)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "width": int(kind[2]), "n_records": n_records, "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key"), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(run, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the number of ids in the files before.

    A manifest has one row a file, so the driver holds as many numbers as there
    are partitions.
    """
    rows, base = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((r.path, r.width, base))
        base += r.n_ids
    spark = manifest.sparkSession
    return spark.createDataFrame(rows, "path string, width int, base long").repartition(max(1, len(rows)))


def _parts(index: np.ndarray) -> Iterator[np.ndarray]:
    """Index entries in runs of about READ_BYTES; a longer record is a run of its own."""
    run = (np.cumsum(index["length"]) - index["length"]) // np.uint64(READ_BYTES)
    yield from np.split(index, np.flatnonzero(np.diff(run)) + 1) if len(index) else ()


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids``, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = filesystem(r["path"])
                with fs.open_input_stream(f"{path}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with fs.open_input_stream(f"{path}.records") as f:
                    for part in _parts(index):
                        raw, at, rows = f.read(int(part["length"].sum())), 0, []
                        for _ in part:
                            data, at = unframe(raw, at)
                            rows.append(np.frombuffer(data, f"<u{r['width']}").astype("<i4").tobytes())
                        yield _rows(part, rows, r["base"])

    return with_starts(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """The same rows in an order that follows from ``seed``: the index entries are
    shuffled, and each task seeks to the records that it was dealt."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = filesystem(r["path"])
                with fs.open_input_stream(f"{path}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                for lo in range(0, len(index), 10_000):
                    part = index[lo : lo + 10_000]
                    cols = [pa.array([r["path"]] * len(part)), pa.array([r["width"]] * len(part), pa.int32()), pa.array([r["base"]] * len(part), pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "width", "base", "entry"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows, part, files = [], [], {}
                for r in batch.slice(lo, 64).to_pylist():
                    if r["path"] not in files:
                        fs, path = filesystem(r["path"])
                        files[r["path"]] = fs.open_input_file(f"{path}.records")
                    e = np.frombuffer(r["entry"], INDEX)[0]
                    data, _ = unframe(files[r["path"]].read_at(int(e["length"]), int(e["offset"])))
                    rows.append(np.frombuffer(data, f"<u{r['width']}").astype("<i4").tobytes())
                    e = e.copy()
                    e["first"] += r["base"]
                    part.append(e)
                yield _rows(np.array(part, INDEX), rows, 0)

    index = with_starts(manifest).mapInArrow(entries, "path string, width int, base long, entry binary")
    order = F.xxhash64("entry", "path", F.lit(seed))
    return index.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids array<int>")


def _rows(index: np.ndarray, ids: list[bytes], base: int) -> pa.RecordBatch:
    cols = [pa.array(index["doc_id"], mask=index["has_id"] == 0), pa.array(index["first"].astype("i8") + base), pa.array(index["count"].astype("i8")), lists_of(ids)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])
