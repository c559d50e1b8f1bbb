"""Shared helpers of the training-data operators.

``shared_path`` names a folder that every executor and the driver can reach: it
comes from ``spark.checkpoint.dir``.  Only where that is unset (tests on one
machine) a folder of this process is used.  ``staged`` writes a table there and
reads it back, which cuts the lineage and survives the loss of executors.  ``scratch``
deletes what was staged inside it, save the tables that a lazy result still reads.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: blank and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
_SCRATCH: ContextVar[set[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="sortlane-"))
    elif "://" not in base:  # a folder of the cluster's own file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///") if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if (made := _SCRATCH.get()) is not None:
        made.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, after an error too.

    ``keep`` hands a staged table to the scratch around this one, or to the caller where there is none.
    """
    outer, kept, made = _SCRATCH.get(), set(), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df) & {_plain(x) for x in made})
        return df

    token = _SCRATCH.set(made)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in made:
            if _plain(path) not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.add(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``__row``; stable only once the result has been written (see ``staged``)."""
    return df.withColumn("__row", F.monotonically_increasing_id())


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def no_cycle_collection():
    """Without passes of the cycle collector over large memos; for blocks that make no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memo:
    """A dictionary of bounded size in two generations: when the young one is
    full it becomes the old one, and what is still in use moves up again."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        if (x := self.young.get(key)) is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, value):
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of ``staged`` tables that nothing reads any more."""
    for folder in set().union(*map(_folders, tables)):
        _delete(spark, folder)


def _folders(df: DataFrame) -> set[str]:
    return {_plain(x.rpartition("/")[0]) for x in df.inputFiles()}


def _plain(path: str) -> str:
    """``file:/x`` and ``file:///x`` name one folder."""
    scheme, found, rest = path.partition(":")
    return f"{scheme}://{rest}" if found and rest.startswith("/") and not rest.startswith("//") else path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def window_hashes(words, size: int):
    """64-bit hashes of all windows of ``size`` consecutive word hashes."""
    import numpy as np

    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mixed(out ^ words[i : i + n]) + np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def mixed(x):
    """The finaliser of the SplitMix64 generator (public constants)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
