"""Periodic runs against a plain search of all periods."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from fieldstone.llm import periodic, queries
from test_operators import DOC, odd, odd_rows, rows, same, table  # noqa: F401

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def runs_of(words):
    ids, distinct = periodic.numbered(" ".join(words))
    return [tuple(r) for r in periodic.runs_of(ids, len(distinct)).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=9))
def test_runs(pieces):
    """Words of one letter: repeated and nested repetitions."""
    words = list("".join(p * k for p, k in pieces))
    assert runs_of(words) == brute.runs(words)


def test_runs_of_long_texts():
    rng = random.Random(3)
    fib = "a", "ab"
    while len(fib[1]) < 3000:
        fib = fib[1], fib[1] + fib[0]
    for words in ["a"] * 3000, list("ab" * 1500), list(fib[1]), [rng.choice("ab") for _ in range(3000)], [str(i % 700) for i in range(3000)], list("aaaaab" * 300 + "aaaaac" * 200):
        assert runs_of(words) == brute.runs(words)
    assert runs_of(["x"] * 200_000) == [(0, 200_000, 1)]


@pytest.fixture(params=["odd", "table"])
def docs(request, odd, table):  # noqa: F811
    return odd if request.param == "odd" else table


def test_query(docs):
    df, plain = docs
    got = periodic.digest(periodic.detect(queries.with_periods(df)))
    assert tuple(got.columns) == COLUMNS
    same(rows(got, *COLUMNS), [brute.periodic(i, t) for i, t in plain])
    assert any(r[1] for r in rows(got, *COLUMNS))


def test_outputs(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y z"), (2, None), (None, "q " * 9)], "doc_id long, text string").selectExpr("*", "7 AS runs", "'k' AS n_words")
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(df).collect()}
    assert got == {1: (18, [(1, 15, 3)], "x a b c y z"), 2: (0, [], ""), None: (9, [(0, 9, 1)], "q")}
    assert periodic.digest(periodic.detect(spark.createDataFrame([], DOC))).count() == 0
