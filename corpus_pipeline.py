"""A training-data pipeline over ``documents``: language ID, n-gram Jaccard join,
substring dedup, secret scans, best-fit packing.

Each stage gets what its predecessor kept.  All but the last return the columns of
documents; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortlane.llm.common import dropped, scratch, staged, table
from sortlane.llm.jaccard import BROADCAST_IDS, similar
from sortlane.llm.language import predict
from sortlane.llm.packing import pack_documents
from sortlane.llm.queries import language_model, tokenizer_path
from sortlane.llm.secret_scan import masked
from sortlane.llm.substrings import dedup

#: Documents whose best language has a smaller posterior go.
LEAST_SCORE = 0.5
#: Near copies share at least so many percent of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model knows, go.

    So do null and empty texts.  Repeated rows share their fate; each row is judged by its whole text.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_model(docs.where(~held))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    known = predict(rows, model, key="row").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that of the smallest id (null
    last), of equal ids an earlier row.

    Rows that share an id, or have none, are told apart by a number of their own, so each is
    judged by its own text.  Rows without words all stay.
    """
    key, numbered = "doc_id", docs
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        key = unused(docs, "row_number")
        numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    with scratch(spark) as keep:
        linked = staged(similar(numbered.select(key, "text"), key=key, size=SHINGLE, percent=PERCENT).select(F.col(key).alias("k"), "component_id"), "similar")
        if key == "doc_id":
            gone = linked.where("component_id <> k").select("k")
        else:
            named = linked.join(numbered.select(F.col(key).alias("k"), "doc_id"), "k")
            first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first"))
            gone = linked.join(first, "component_id").where("k <> first.k").select("k")
        gone = keep(staged(gone, "gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return numbered.join(gone, numbered[key] == gone["k"], "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a document of which nothing is left goes.

    Null and empty texts stay as they are.
    """
    rows = dedup(docs, whole_rows=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return rows.select(*({"text": text, "n_chars": _like(docs, length)}.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null texts stay null."""
    rows = masked(docs)
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", _like(docs, F.coalesce(F.length("text"), F.col("n_chars")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row a piece; every row has a piece at least (null text: the end id)."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table lacks."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _like(docs: DataFrame, length: Column | None) -> Column | None:
    return None if length is None else length.cast(docs.schema["n_chars"].dataType)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("secret scans", secret_masks), ("best-fit packing", packing)]
#: SQL cannot express language ID and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; of the tables on the way only the last stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        dropped(spark, *before)
        before = [docs]
    return docs
