"""Queries of the training-data operators: thin digests of the operators' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import decode, encode

    path = tokenizer_path("piece_bpe_32k.model")
    ids = encode(table(spark, sf_dir, "documents"), path)
    digest = ids.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")).alias("row"), "ids")
    text = decode(digest, path, key="row")
    return text.select("row.*", F.sha2("text", 256).alias("decoded_sha256"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import read_records, write_records

    rows = read_records(write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))
    return with_crc(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def with_crc(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` of an ``ids`` column: over little-endian unsigned 32-bit integers."""
    import zlib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    keep = [c for c in rows.columns if c != "ids"]
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "ids") + ", ids_crc32 long")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict

    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_model(docs.where(~held))
    rows = predict(docs, model)
    return rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def language_model(docs: DataFrame):
    from .language import train

    return train(docs, tokenizer_path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_piece_codec, op2_token_records, op4_quality_rules, op5_language_id, op9_packing)}
SQL: dict[str, str] = {}


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, as_text, of_kind, scan

    s = F.col("spans")
    count = lambda k: F.size(of_kind(s, [k])).cast("long").alias(f"n_{k}")
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *map(count, BASE), F.sha2(as_text(of_kind(s, BASE)), 256).alias("base_sha256"), as_text(s).alias("spans"))


def _secret_sql() -> str:
    from .secret_scan import sql

    return sql()


QUERIES["op3_secret_scan"] = op3_secret_scan
SQL["op3_secret_scan"] = _secret_sql()
SQL["op4_quality_rules"] = r"""
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM pos WHERE i + 4 <= len(w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
figures AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures),
failed AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 30 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed FROM judged),
hosts AS (SELECT source, count(*) AS n, count_if(failed) AS f FROM failed GROUP BY source),
rates AS (SELECT sum(f) / sum(n) AS mean, var_samp(f / n) AS v, avg(1 / n) AS inverse FROM hosts),
prior AS (SELECT mean, v - mean * (1 - mean) * inverse AS spread FROM rates),
strength AS (SELECT mean, CASE WHEN spread > 1e-12 THEN greatest(mean * (1 - mean) / spread - 1, 0) ELSE 1e9 END AS s FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (f + mean * s) / (n + s) < 0.6 AS kept
FROM failed JOIN hosts ON failed.source IS NOT DISTINCT FROM hosts.source, strength
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup

    rows = dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op7_substring_dedup"] = op7_substring_dedup
SQL["op7_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM pos WHERE i + 19 <= len(w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


QUERIES["op8_ngram_jaccard"] = op8_ngram_jaccard
SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i, w FROM words WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM pos),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
shared AS (SELECT doc_id, g FROM sh SEMI JOIN few USING (g)),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) m USING (doc_id)
"""


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near

    return near(table(spark, sf_dir, "embeddings"))


QUERIES["op6_masked_lm"] = op6_masked_lm
QUERIES["op10_nn_descent"] = op10_nn_descent
SQL["op10_nn_descent"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a)
SELECT m.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(m.vec_id, coalesce(c, m.vec_id)) AS BIGINT) AS component_id, m.vec_id = least(m.vec_id, coalesce(c, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = m.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = m.vec_id
"""


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    rows = shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


QUERIES["op11_virtual_slots"] = op11_virtual_slots


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op12_norm_buckets"] = op12_norm_buckets
SQL["op12_norm_buckets"] = r"""
WITH lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM lists WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
repeats AS (SELECT item_id, term, count(*) AS r FROM asked GROUP BY ALL),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) SEMI JOIN repeats USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact FROM held, total),
scores AS (SELECT item_id, doc_id, CAST(sum(r * w * impact) AS BIGINT) AS score FROM repeats JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label))


QUERIES["op13_hard_negatives"] = op13_hard_negatives
SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
