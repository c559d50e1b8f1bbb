"""The commit log under failure, repetition and several writers; selection and pages against plain sorting."""

import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

from sortlane.operators import pages, selection, store
from sortlane.sources import files
from sortlane.sources.versioned import VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "k long, x string").schema)


def rows(spark, *keys, x="x"):
    return spark.createDataFrame([(k, x) for k in keys], "k long, x string")


def kept(table):
    return sorted(r.k for r in table.rows().collect())


def test_batches_happen_once(spark, table):
    assert kept(table) == [] and table.snapshot().version == 0
    first = store.append(rows(spark, 1, 2, 2), table, "a", "k")
    assert [r.reason for r in first.collect()] == ["duplicate in batch"] and kept(table) == [1, 2]
    for _ in range(2):
        again = store.append(rows(spark, 2, 3), table, "b", "k")
        assert [(r.k, r.reason) for r in again.collect()] == [(2, "duplicate")]
        assert kept(table) == [1, 2, 3] and table.snapshot().version == 2
    assert sorted(r.k for r in table.rows(1).collect()) == [1, 2]


def test_an_interrupted_append_leaves_nothing(spark, table, monkeypatch):
    store.append(rows(spark, 1), table, "a", "k")

    def stopped(self, *_):
        raise RuntimeError("the driver is lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_committed", stopped)
        with pytest.raises(RuntimeError):
            store.append(rows(spark, 2, 3), table, "b", "k")
    assert kept(table) == [1]
    store.append(rows(spark, 2, 3), table, "b", "k")
    assert kept(table) == [1, 2, 3]
    assert len(table.vacuum()) == 1 and table.vacuum() == [] and kept(table) == [1, 2, 3]


def test_two_writers_never_store_a_key_twice(spark, table, monkeypatch):
    """Both judge their rows against the same snapshot; the second to commit judges again."""
    both, judged = threading.Barrier(2), VersionedTable._written
    waited = threading.local()

    def written(self, judged_rows):
        name = judged(self, judged_rows)
        if not getattr(waited, "done", False):
            waited.done = True
            both.wait(60)
        return name

    monkeypatch.setattr(VersionedTable, "_written", written)
    rejected, names = {}, {"a": (1, 2, 3), "b": (3, 4, 1)}

    def work(batch):
        rejected[batch] = sorted(r.k for r in store.append(rows(spark, *names[batch], x=batch), table, batch, "k").collect())

    threads = [threading.Thread(target=work, args=(b,)) for b in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert kept(table) == [1, 2, 3, 4] and table.snapshot().version == 2
    assert sorted(rejected.values()) == [[], [1, 3]]


def test_only_one_writer_creates_a_version(table):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(table._create(1, f'{{"parts": [], "batches": {{"{i}": 1}}}}'))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sum(won) == 1 and table.snapshot().version == 1


def test_replace_begins_anew_after_another_commit(spark, table):
    store.append(rows(spark, 1), table, "a", "k")
    calls = []

    def change(old):
        if not calls:
            store.append(rows(spark, 2), table, "b", "k")  # another writer is first
        calls.append(1)
        return old.withColumn("x", F.lit("new"))

    table.replace(change, "c")
    assert kept(table) == [1, 2] and {r.x for r in table.rows().collect()} == {"new"} and len(calls) == 2
    table.replace(change, "c")
    assert len(calls) == 2


@pytest.mark.parametrize("most, parts", [(10**6, 256), (40, 8), (5, 4)])
def test_latency_report(spark, monkeypatch, most, parts):
    monkeypatch.setattr(selection, "ROWS", most)
    monkeypatch.setattr(selection, "PARTS", parts)
    rng = random.Random(2)
    values = {"hot": [rng.choice([rng.random() * 500, 7.0, 7.0]) for _ in range(3000)], "same": [3.5] * 200, "one": [9.0], None: [1.0, 2.0], "two": [4.0, -1.0], "far": [10.0 ** rng.randint(-12, 12) for _ in range(300)]}
    df = spark.createDataFrame([(g, v) for g, x in values.items() for v in x] + [("hot", None), ("none", None)], "g string, ms double").repartition(5)
    got = {r.g: r for r in store.latency_report(df, "g", "ms").collect()}
    assert got.keys() == values.keys()
    for g, x in values.items():
        r, x = got[g], sorted(x)
        assert (r.n, r.p95, r["min"], r["max"]) == (len(x), x[int(len(x) * 0.95)], x[0], x[-1])
        assert r.median == pytest.approx(statistics.median(x), abs=1e-6) and r.mean == pytest.approx(sum(x) / len(x), rel=1e-9, abs=1e-6)


def test_pages(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, rng.randint(0, 300), f"n{i}") for i in range(5000)]
    df, path, order = spark.createDataFrame(data, "id long, at long, name string").repartition(6), f"file://{tmp_path}/p", ("-at", "id")
    pages.store(df, path, order, parts=40)
    want = sorted(data, key=lambda r: (-r[1], r[0]))
    for number in (0, 1, 77, 199, 200, 500):
        got = pages.page(spark, path, df.schema, order, 25, number)
        assert [tuple(r) for r in got.collect()] == want[25 * number : 25 * number + 25]
        assert len({f.split("/part=")[1].split("/")[0] for f in got.inputFiles()}) <= 2
    seen, row = [], None
    for _ in range(4):
        batch = pages.after(df, order, row, 30).collect()
        seen += [tuple(r) for r in batch]
        row = batch[-1].asDict()
    assert seen == want[:120]
    plan = pages.after(spark.read.parquet(f"{path}/rows"), order, {"at": 100, "id": 3}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(at,100)" in plan and "TakeOrderedAndProject" in plan


def test_orders_go_by_file_name(spark, tmp_path):
    for name, address in (("b", "second"), ("a", "first"), ("c", "third")):
        (tmp_path / f"{name}.json").write_text(f'{{"x.jpg": {{"tracking_id": "FE1", "address": "{address}"}}, "y.jpg": {{"tracking_id": "FE{name}"}}}}')
    got = {r.tracking_id: r.address for r in files.read_orders(spark, str(tmp_path)).collect()}
    assert got["FE1"] == "third" and len(got) == 4
