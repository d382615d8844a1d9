"""The corpus pipeline against plain versions of its stages."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from fieldstone.llm import bpe, quality_rules, secrets
from test_operators import DOC, odd_rows

RULES = [(r.kind, r.pattern, r.group, r.min_chars) for r in secrets.RULES]


def after_quality(rows, items):
    """What the last four stages make of (doc_id, text, lang, source): (doc_id, lang, source, ids)."""
    keep = [k for _, _, _, k in brute.near_duplicates([r[:2] for r in rows])]
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    hit = [w[5] for w in brute.decontaminate([r[:2] for r in rows], items)]
    rows = [r for r, h in zip(rows, hit, strict=True) if not h]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    text = lambda t: brute.redacted(t, brute.spans(t, RULES)) or ""
    return [(i, lang, source, tuple(library.encode_ordinary(text(t)))) for i, t, lang, source in rows]


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_run(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    good = quality_rules.judge(docs, labels).filter("kept").select("doc_id")
    want = after_quality(plain(docs.join(good, "doc_id", "left_semi")), items)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in got) == Counter(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and 0 < len(got) < docs.count()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, lang if i != 8 else None, source if i != 9 else None, n) for i, t, lang, source, n in odd_rows()], DOC)
    clash = {"text_key": F.lit(1), "key": F.lit("k"), "hid": F.lit("x"), "kept": F.lit(True), "whole": F.lit(2), "spans": F.lit(3), "ids": F.lit(4), "items": F.lit(5), "dropped_id": F.lit(6)}
    return df.withColumns(clash)


def test_stages_on_odd_rows(spark, sf_dir, odd):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns, name
    got = [(r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()]
    assert Counter(got) == Counter(after_quality(plain(odd), items))
    assert corpus_pipeline.STAGES[0][1](spark, odd, sf_dir).columns == odd.columns


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_encoding_decodes_its_ids(spark, sf_dir, odd):
    """The last stage is the whole method: the ids are decoded again, to the bytes of the text."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = {rank: piece for piece, rank in bpe.read_ranks(f.read()).items()}
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in plain(odd))
    rows = corpus_pipeline.encoding(spark, odd, sf_dir).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == want
    assert all(r["decoded_sha256"] == hashlib.sha256(b"".join(pieces[i] for i in r["ids"])).hexdigest() for r in rows)
