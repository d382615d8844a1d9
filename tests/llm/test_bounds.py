"""Repeated rows and doc_ids on very many rows: what is gathered for one stays bounded, and results stay right."""

import random

import numpy as np
from pyspark.sql import functions as F

import brute
from fieldstone.llm import decontam, quality_crf, quality_rules, substring
from fieldstone.llm.tables import Tables


def prose(rng, n):
    return " ".join(rng.choice(("ka", "lo", "mi", "nu")) + rng.choice(("ba", "da", "fo")) + str(rng.randrange(300)) for _ in range(n))


def test_substring_dedup_of_a_hot_id(spark):
    """One doc_id holds most rows: different texts, repeated ones, copies of an earlier document, and passages of it."""
    rng = random.Random(21)
    first, passage = prose(rng, 60), prose(rng, 20)
    mine = [f"{prose(rng, 15)} {passage} {prose(rng, 5)}" for _ in range(200)]
    plain = [(1, first), (2, f"x y {passage} z"), *[(7, t) for t in mine + mine[:50] + [first] * 40 + [prose(rng, 30)] * 30], (9, mine[3]), (9, mine[3]), (10, mine[120])]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substring.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(brute.substring_dedup(plain))
    assert sum(r[2] for r in got) > 0


def labelled(spark):
    base = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality")


def test_repeated_rows_are_learned_from_once(spark):
    docs, labels = labelled(spark)
    again, twice = docs.union(docs).union(docs.filter("doc_id % 3 = 0")), labels.union(labels)
    assert quality_rules.learn(again, twice) == quality_rules.learn(docs, labels)
    one, many = quality_crf.learn(docs, labels), quality_crf.learn(again, twice)
    for name in ("emission", "transition", "curve"):
        assert np.array_equal(getattr(one, name), getattr(many, name))


def test_samples_of_a_hot_id_are_bounded(spark, monkeypatch):
    """A labelled doc_id with thousands of texts gives no more rows than the sample holds."""
    docs, labels = labelled(spark)
    hot = docs.limit(1).select("doc_id").first()[0]
    many = docs.union(spark.range(4000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("some words and number "), F.col("id").cast("string")).alias("text")))
    seen = []
    cover, fit = quality_rules.cover, quality_crf.fit
    monkeypatch.setattr(quality_rules, "cover", lambda cells, cuts: seen.append(sum(c[-1] + c[-2] for c in cells)) or cover(cells, cuts))
    monkeypatch.setattr(quality_crf, "fit", lambda lines, quality: seen.append(len(quality)) or fit(lines, quality))
    quality_rules.learn(many, labels, sample=600)
    quality_crf.learn(many, labels, sample=300)
    assert len(seen) == 2 and 0 < seen[0] <= 750 and 0 < seen[1] <= 750


def test_repeated_benchmark_items(spark):
    docs, _ = labelled(spark)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda b: sorted(tuple(r) for r in decontam.report(docs, b).collect())
    assert rows(bench.union(bench)) == rows(bench)


def test_tables_go_when_the_application_ends(spark):
    tables = Tables(spark, "bounds")
    assert tables.write("t", spark.range(5)).count() == 5
    path, fs = tables._path("")
    assert fs.exists(path) and fs.cancelDeleteOnExit(path)
    fs.deleteOnExit(path)
    tables.drop("t")
    assert not fs.exists(tables._path("t")[0])
