"""The numbered queries over the test tables and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, neardup, packing, periodic, quality_crf, quality_rules, repair, secrets, sharding, substring, token_counts, url_rules
from .native import let, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def with_periods(docs: DataFrame) -> DataFrame:
    """documents with texts that are made periodic from some word on where the contract says so (a tenth of all)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic_text(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = let(words(F.coalesce("text", F.lit(""))), lambda w: F.when(F.size(w) > 0, periodic_text(w)).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(with_periods(_table(spark, sf_dir, "documents"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations as the contract damages them; times: how often a row stands."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    v = F.crc32(F.concat_ws(":", conv, turn)) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(v == 4, "user").otherwise(role).alias("role"),
        F.when(v == 1, "").when(v == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(v == 0, 0).when(v == 3, 2).otherwise(1).alias("times"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repaired(damaged(_table(spark, sf_dir, "conversations")), "times"))


_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST_PATH = f"""
    SELECT page_id,
           CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), {_CAPITALS}) ELSE '' END AS host,
           CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages"""

OP3_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in url_rules.CONTRACT_RULES)}),
p AS ({_HOST_PATH}),
fit AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, rule_host || rule_path) AS n
    FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fit WHERE n = 1"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
found AS (
    SELECT doc_id, i, x.n, item_id
    FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items))) x
    JOIN wanted ON x.n = wanted.n AND x.win = wanted.win
),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
wins AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least
         FROM (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 13)) AS pos FROM wins WHERE least < doc_id)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS words
         FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


_ALL = (
    op1_secret_scan,
    op2_near_duplicates,
    op3_url_filter,
    op4_token_counts,
    op5_byte_bpe,
    op6_quality_rules,
    op7_decontamination,
    op8_substring_dedup,
    op9_sharding,
    op10_quality_classifier,
    op11_periodic_runs,
    op12_packing,
    op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op7_decontamination": OP7_SQL, "op8_substring_dedup": OP8_SQL}
