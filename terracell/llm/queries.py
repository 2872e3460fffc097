"""The operators' queries over the test tables, and SQL where it can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracell.llm import chat_format, embedding_dedup, license_scan, mixing, packing, quality_model, quality_rules, sharding, simhash, toxicity
from terracell.llm.base import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    return chat_format.digests(chat_format.format_turns(given.unionByName(planted)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_embedding_dedup, op3_toxicity, op4_quality_model, op5_quality_rules, op6_chat_format, op7_license_scan, op8_sharding, op9_mixing, op10_packing)
}

_PATTERN = "|".join(re.escape(c).replace("'", "''") for c in sorted(chat_format.CONTROL, key=len, reverse=True))
_FRAME = len(chat_format.TURN + chat_format.TEXT + chat_format.END)

#: The rest learn models or need fingerprints, token ids or 64-bit hashes that DuckDB has not; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op2_embedding_dedup": """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS MATERIALIZED (SELECT u, label, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM ok a JOIN ok b ON a.label = b.label AND a.u <> b.u AND len(a.v) = len(b.v) WHERE a.v = b.v OR CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98),
t(u, root) AS (SELECT u, u FROM e UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.u),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT t.u AS u, min(e.vec_id) AS component_id FROM t JOIN e ON e.u = t.root GROUP BY t.u)
SELECT e.vec_id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id AS component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM e JOIN c USING (u) LEFT JOIN n ON n.a = e.u""",
    "op6_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, len(regexp_extract_all(t, '{_PATTERN}')) AS found, length(t) - length(replace(t, '\', '')) AS slashes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn), '')) AS loss_sha256,
CAST(sum({_FRAME} + length(r) + length(t) + CASE WHEN found > 0 THEN {len(chat_format.LEVELS[1])} + 2 * found + slashes ELSE 0 END) AS BIGINT) AS formatted_chars FROM k GROUP BY conv_id""",
}
