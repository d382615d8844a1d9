"""Repair of conversations against a plain search over all edits."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from fieldstone.llm import queries, repair
from test_operators import rows, same

CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def query(df):
    return repair.digest(repair.repaired(queries.damaged(df), "times"))


def wanted(plain):
    return [brute.repair(conv, held) for conv, held in brute.damage(plain).items()]


def check(spark, plain, partitions=3):
    df = spark.createDataFrame(plain, CONV).repartition(partitions)
    got = query(df.withColumns({"times": F.lit(5), "digest": F.lit("x"), "part": F.lit(1), "head": F.lit(2)}))
    assert tuple(got.columns) == COLUMNS
    same(rows(got, *COLUMNS), wanted(plain))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", " ", ""]), st.sampled_from([repair.OK, repair.CUT, repair.GONE])), max_size=12), st.integers(0, 12))
def test_search(found, cut):
    """Cost and audit of one search, and of two that are joined."""
    kinds = [("", "truncated", "blank")[f] for _, f in found]
    want = brute.cheapest([(None, r, "") for r, _ in found], kinds)
    whole = {(0, x): p for x, p in repair.search(found, 0).items()}
    assert repair.finished(whole) == want
    parts = [{(e, x): p for e in range(4) for x, p in repair.search(f, e).items()} for f in (found[:cut], found[cut:])]
    assert repair.finished(repair.joined(*parts)) == want


def odd_conversations():
    rng = random.Random(8)
    plain = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]), rng.choice(["Yes.", "No!", "", None, " \t\x0b", "cut", "Why? ", "Yes.", "é🙂.", "z" * 40 + rng.choice("ab.")])) for c in range(80) for t in range(rng.randrange(9))]
    plain += [(None, t, "user", "Null id.") for t in range(4)] + [(200, None, r, x) for r in ("user", "assistant") for x in ("a.", "b.", "a.")]
    plain += [(201, None, None, None), (202, 5, "user", "Far."), (202, 90, "assistant", "Away."), (202, -3, "system", "Low.")]
    plain += [(203, 1, "user", "Same row.")] * 7 + [(204, 0, "user", "x" * 100_000)]
    return plain


def test_odd(spark):
    check(spark, odd_conversations())
    assert query(spark.createDataFrame([], CONV)).count() == 0


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = query(df)
    same(rows(got, *COLUMNS), wanted(plain))
    assert dict(got.dtypes)["audit"] == "string" and {t for c, t in got.dtypes if c in COLUMNS[:7]} == {"bigint"}


def test_long_conversation(spark, monkeypatch):
    """One conversation has most rows: it lies in several tasks, and each task searches it in segments."""
    rng = random.Random(4)
    plain = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "No!", "", "cut", f"T{t}.", f"T{t}."])) for t in range(3000)]
    plain += [(c, t, "user", "Hm.") for c in (6, 8) for t in range(3)]
    df = queries.damaged(spark.createDataFrame(plain, CONV))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.parts(repair._rows(df, "times"))
        assert found.filter("conv_id = 7").count() > 3
        check(spark, plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows(spark):
    plain = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hm"), (1, 3, "user", ""), (2, 1, "user", "Alone.")]
    got = [tuple(r) for r in repair.repaired(spark.createDataFrame(plain, CONV)).coalesce(1).filter("place IS NOT NULL").select("conv_id", "place", "turn", "role", "text", "edit").orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 0, 0, "system", "Be kind.", "K"), (1, 1, None, "user", "", "I"), (1, 2, 1, "assistant", "Hello.", "K"),
        (2, 0, 1, "user", "Alone.", "K"), (2, 1, None, "assistant", "", "I"),
    ]


@pytest.mark.parametrize("n", [2000])
def test_no_more_nodes_than_rows(n):
    """A long segment is searched node by node."""
    assert repair.finished({(0, x): p for x, p in repair.search([("u", 0), ("a", 0)] * (n // 2), 0).items()}) == (0, "K" * n)
