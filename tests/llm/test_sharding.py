"""Virtual slots against brute force and the law of near equal bytes."""

import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sortlane.llm import sharding
from sortlane.llm.common import shared_path
from sortlane.llm.queries import QUERIES


def held(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def check(rows, shards, slack):
    """Gapless places, and shards of near equal bytes."""
    by = held(rows)
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    sums = [sum(r["size"] for r in by.get(i, [])) for i in range(shards)]
    assert set(by) <= set(range(shards)) and max(sums) - min(sums) <= slack, sums


def test_query(spark):
    sf = f"{DATA}/sf0.01"
    rows, docs = QUERIES["op11_virtual_slots"](spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs.pop(r.doc_id) or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check(rows, 16, 2000)


@pytest.fixture(scope="module")
def odd(spark):
    """A third of all rows share a key, others have none; a very long text; columns named like the operator's own."""
    rows = [(7, "same " * (i % 90), i, i) for i in range(600)] + [(None, None, 0, 0), (None, "", 1, 1)] * 100 + [(i, "x" * (i % 400), i, i) for i in range(1000)] + [(5000, "long " * 200_000, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard long, row long").repartition(5).cache()


def test_hot_keys_are_split(spark, odd):
    rows = sharding.shard(odd.where("doc_id is null or doc_id < 5000"), shards=4, slots=64).collect()
    assert len(rows) == 1800
    check(rows, 4, 310_000 / 64)
    assert {r["shard"] for r in rows if r["doc_id"] == 7} == {0, 1, 2, 3}
    whole = sharding.shard(odd, shards=4, slots=64).collect()
    assert len(whole) == odd.count() and max(r["size"] for r in whole) == 1_000_001
    by = held(whole)
    assert sorted(len(x) for x in by.values())[0] == 1  # the long text has a shard of its own
    assert sharding.shard(odd.limit(0), shards=4).count() == 0


def test_versions(spark, odd):
    """A new version edits the last one: few records move, and a new shard fills from the others."""
    folder, docs = shared_path(spark, "slots"), odd.where("doc_id between 8 and 4000")
    sharding.store_map(sharding.fresh_map(spark, 4, 256), folder, 0)
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 4, slots=256, folder=folder).collect()}
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 4, slots=256, folder=folder).collect()}
    assert sharding.last_version(spark, folder) == 2
    assert sum(first[k] != again[k] for k in first) <= 0.02 * len(first)
    rows = sharding.shard(docs, 5, slots=256, folder=folder).collect()
    check(rows, 5, 800)
    grown = {r["doc_id"]: r["shard"] for r in rows}
    moved = [k for k in grown if grown[k] != again[k]]
    assert sum(grown[k] == 4 for k in moved) >= 0.8 * len(moved) and len(moved) < 0.6 * len(grown)
    check(sharding.shard(docs, 2, slots=256, folder=folder).collect(), 2, 800)
    maps = [sharding.read_map(spark, folder, v).agg(F.count("*").alias("n"), F.max("shard").alias("last")).first() for v in range(5)]
    assert [m["last"] for m in maps] == [3, 3, 3, 4, 1] and maps[0]["n"] == 256
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sharding.store_map(sharding.fresh_map(spark, 4, 256), folder, 4)
