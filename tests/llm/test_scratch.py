"""Intermediate tables leave the shared folder; only what a lazy result reads stays."""

import uuid
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sortlane.llm import common, embeddings, jaccard, substrings  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_path", lambda spark, label: f"file://{tmp_path}/{label}-{uuid.uuid4().hex}")
    return tmp_path


def left(folder: Path) -> list[str]:
    return sorted(x.name.rpartition("-")[0] for x in folder.iterdir())


def test_kept_tables_go_to_the_scratch_around(spark, folder):
    with common.scratch(spark) as keep:
        with common.scratch(spark) as inner:
            a = inner(common.staged(spark.range(3), "a"))
            common.staged(spark.range(3), "b")
        assert left(folder) == ["a"]
        c = keep(common.staged(a, "c"))
    assert left(folder) == ["c"] and c.count() == 3
    with pytest.raises(ValueError), common.scratch(spark):
        common.staged(spark.range(3), "d")
        raise ValueError
    assert left(folder) == ["c"]


def test_operators_leave_what_their_result_reads(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    similar = jaccard.similar(docs)
    assert left(folder) == ["base", "of_class"]
    assert similar.count() == docs.count()
    deduped = substrings.dedup(docs)
    assert left(folder) == ["base", "of_class", "ranges"]
    assert deduped.count() == docs.count()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert embeddings.near(vectors).count() == vectors.count()
    assert left(folder) == ["base", "hashed", "named", "of_class", "ranges"]


def test_pipeline_leaves_its_result(spark, folder):
    out = corpus_pipeline.run(spark, SF)
    assert left(folder) == ["best-fit-packing"] and out.count()
