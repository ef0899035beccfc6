"""The operators' queries over the documents table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.alignment import aligned
from pagewright.llm.exact_dedup import exact_dedup
from pagewright.llm.fingerprints import edited_fingerprints
from pagewright.llm.language_id import language_id
from pagewright.llm.lm_scoring import lm_scores
from pagewright.llm.mixing import mix, taken_words
from pagewright.llm.near_join import near_join
from pagewright.llm.packing import pack
from pagewright.llm.resampling import drawn, importance
from pagewright.llm.secrets import found_secrets, listed
from pagewright.llm.sharding import shard_by_bytes
from pagewright.llm.shared import documents
from pagewright.llm.tokenfiles import read_token_files, token_folder, write_token_files
from pagewright.llm.toxicity import toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes, and its source's size and target."""
    return taken_words(*mix(documents(spark, sf_dir)))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of every document's ids, read back from the files."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_token_files(documents(spark, sf_dir), vocabulary, token_folder(spark), end_id=0)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id(documents(spark, sf_dir))


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document by Jaccard similarity of runs of five words from 0.8 on."""
    return near_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under the network and under word counts."""
    return lm_scores(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, 0 to 1, and the decision at 0.3."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document which row of its equal texts stays."""
    return exact_dedup(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike it is to that and to the next text."""
    return edited_fingerprints(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near equal bytes."""
    return shard_by_bytes(documents(spark, sf_dir), shards=40).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets of every document."""
    found = found_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x.kind != "literal")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; the target is the benchmark."""
    return drawn(importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the byte-level ids and the pieces of every document line up."""
    by_document, _ = aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return by_document


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_near_join": op5_near_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_sharding": op10_sharding,
    "op11_secret_scans": op11_secret_scans,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    # a checksum by its table of 256 steps, once for each distinct feature
    "op12_importance_resampling": r"""
        WITH steps AS (
            SELECT list(c ORDER BY i) AS step
            FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
                  FROM range(256) r(i))),
        words AS (
            SELECT kind, place, doc_id, unnest(word) AS w, generate_subscripts(word, 1) AS k
            FROM (SELECT kind, place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS word
                  FROM (SELECT 'd' AS kind, row_number() OVER () AS place, doc_id, text FROM documents
                        UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark))),
        features AS (
            SELECT kind, place, w AS f FROM words
            UNION ALL
            SELECT kind, place, w || ' ' || following
            FROM (SELECT kind, place, w, lead(w) OVER (PARTITION BY kind, place ORDER BY k) AS following FROM words) WHERE following IS NOT NULL),
        buckets AS (
            SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(f)),
                       lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT)),
                       lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM features), steps),
        counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM counts),
        weights AS (
            SELECT place, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
            FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY place),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM (SELECT row_number() OVER () AS place, doc_id FROM documents) LEFT JOIN weights USING (place)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS rank, count(*) FILTER (n_features >= 39) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND rank <= 25 * n // 100 THEN rank END AS rank FROM ranked""",
}
