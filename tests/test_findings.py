"""Queries on tables whose shape the small test tables do not have, against their SQL."""

import os

import duckdb
import pytest
from conftest import DATA
from oracle import TABLES, compare, connect

from sortlane.plans import QUERIES, SQL

SMALL = f"{DATA}/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """The smallest tables; those that are given stand in for their namesakes."""

    def make(**new):
        for t in TABLES:
            target = tmp_path / f"{t}.parquet"
            if t in new:
                duckdb.sql(new[t].format(old=f"'{SMALL}/{t}.parquet'")).write_parquet(str(target))
            else:
                os.symlink(f"{SMALL}/{t}.parquet", target)
        return str(tmp_path)

    return make


def check(spark, name, folder):
    compare(spark, connect(folder), QUERIES[name], SQL[name], folder)


def test_best_focus_with_large_event_ids(spark, tables):
    check(spark, "agg_best_focus", tables(events="SELECT * REPLACE (event_id * 997 + k * 1000003 AS event_id, user_id % 20 AS user_id) FROM {old}, range(3) r(k)"))


def test_daily_statistics_of_a_large_day(spark, tables):
    check(spark, "st_daily_stats", tables(customer="SELECT * REPLACE (c_custkey + k * 1000 AS c_custkey) FROM {old}, range(40) r(k)", orders="SELECT * REPLACE (o_orderkey + k * 10000 AS o_orderkey, o_custkey + k * 1000 AS o_custkey, TIMESTAMP '1996-01-02 00:00:00' AS o_orderdate) FROM {old}, range(40) r(k)"))


def test_addresses_without_a_postal_code_are_cleaned(spark):
    found = {r.address for r in QUERIES["str_clean_address"](spark, SMALL).where("scan_id % 3 = 2").distinct().collect()}
    assert found == {"Lot 5 Block 2"}


def test_a_replayed_batch_is_as_many_files_as_its_rows_need(spark, tmp_path, monkeypatch):
    from sortlane.streaming import jobs

    monkeypatch.setattr(jobs, "work_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(jobs, "ROWS_PER_FILE", 100)
    rows = spark.range(1200).selectExpr("id as event_id", "timestamp_seconds(id * id) as ts")  # the first batch has half of all rows, the last an eighth
    jobs.replayed(rows, lateness=10)
    files = [len(spark.read.parquet(f"{tmp_path}/in/n={i}").inputFiles()) for i in range(4)]
    assert files == [3, 3, 3, 3] and spark.read.parquet(f"{tmp_path}/in").count() == 1201


def test_lines_are_dealt_by_label_in_tasks_of_bounded_size(spark, monkeypatch):
    from sortlane.operators import extract, match

    monkeypatch.setattr(match, "ROWS_PER_TASK", 10)
    texts = spark.range(100).selectExpr("id as k", "concat('a', chr(10), 'b') as t")
    lines = extract.label_lines(texts, "k", "t")
    assert lines.rdd.getNumPartitions() == 10 and lines.count() == 200
