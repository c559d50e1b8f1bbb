"""Queries of the operators against DuckDB, and held-out accuracy."""

import pytest
from conftest import DATA
from oracle import compare, connect
from pyspark.sql import functions as F

from sortlane.llm.queries import QUERIES, SQL

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, connect(SF), QUERIES[name], SQL[name], SF)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op5_language_id"](spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
