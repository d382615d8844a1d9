"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stages
before it have kept.  All but the last return the columns of documents.
Labels and the benchmark are read from sf_dir.

Defined results: a null or empty text has fewer than 20 words, so the quality rules
reject it; the later stages would keep it, as the empty text without tokens.  A
null doc_id is never a near duplicate and otherwise ordinary; rows with the same
doc_id stay or go together in near-dedup and are judged each on its own elsewhere; nulls in other columns
are carried; an empty table gives an empty table; further columns of docs, whatever
their names, are carried by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm import bpe, decontam, neardup, quality_rules, secrets
from fieldstone.llm.tables import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned rules reject go."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.clean(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids of each text and decoded_sha256, the digest of the bytes that the ids decode to."""
    carried = ("doc_id", "lang", "source")
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carried)
    return encoded.select(*carried, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", redaction),
    ("bpe_encoding", encoding),
]

#: SQL can express neither the learned rules nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; what one stage returns is written to the shared folder, read by the next and then removed."""
    tables = Tables(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(name, stage(spark, docs, sf_dir))
        tables.drop_others(name)
    return STAGES[-1][1](spark, docs, sf_dir)
