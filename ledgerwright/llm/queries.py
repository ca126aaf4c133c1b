"""The registered queries over the driver's tables: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, conversation_repair, embedding_dedup, language_id, line_dedup, minhash, packing, phrases, pii, quality, sharding, tokens
from .oracle import PHRASE_SQL, REPAIR_SQL

#: Largest sum of text bytes in a shard.
SHARD_BYTES = 4 << 20
#: Token limit that op10 reports against.
TOKEN_LIMIT = 2048
#: Pseudonyms are only as secret as this key; a deployment passes its own.
PSEUDONYM_KEY = "registered-query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digests(chat.format_prefix_targets(rows.unionByName(own)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.bpe_encode_decode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_windows")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows)


def op12_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (
        op1_prefix_targets, op2_quality, op3_extendible_shards, op4_prefix_bpe, op5_sum_of_squares, op6_pseudonyms, op7_line_windows, op8_rotation_codes,
        op9_circulant_minhash, op10_token_counts, op11_conversation_repair, op12_language_codes,
        op13_phrases)
    return {f.__name__: f for f in known}


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    4 + 2 + 8 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\:'))
      + length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')) AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM sized)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS n_examples
FROM summed GROUP BY conv_id
"""

OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS seen
  FROM windows WHERE win IS NOT NULL AND regexp_matches(win, '[^\\s]')),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM numbered, (VALUES (0), (1), (2)) AS v(k) WHERE seen > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n, count(c.pos) AS gone, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(k.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.gone, 0) AS INTEGER) AS n_removed_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.root AS component_id, e.vec_id = l.root AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.root AS component_id, s.doc_id = l.root AS kept
FROM sets s JOIN least l ON l.node = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op1_prefix_targets": OP1_SQL, "op7_line_windows": OP7_SQL, "op8_rotation_codes": OP8_SQL, "op9_circulant_minhash": OP9_SQL,
        "op11_conversation_repair": REPAIR_SQL, "op13_phrases": PHRASE_SQL}
