"""Table functions with error rows, names by automata, manifests as variants, rejects of files, counters of a write."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldstone.operators import extract, lookup, quality
from fieldstone.sources import files, html


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page int, html string")


def test_a_row_that_fails_costs_no_other(spark):
    wide = "<table><tr><td>a<tr>" + "<td>x" * 9 + "<tr><td><a href='/wiki/B'>b</a><table><tr><td data-sort-value='1'>in</table></table>"
    got = [tuple(r) for r in html.lateral_rows(pages(spark, wide, None, "", "<p>no table"), "page", max_cells=5).collect()]
    assert [(p, t, i, None if c is None else [x["text"] for x in c], e) for p, t, i, c, e in got] == [
        (0, 1, 0, ["a"], None), (0, 1, 1, None, "ValueError: a row of 9 cells"), (0, 1, 2, ["bin", "in"], None), (0, 1, 3, ["in"], None), (0, 2, 0, ["in"], None),
    ]
    assert got[2][3][0]["links"][0]["href"] == "/wiki/B" and got[4][3][0]["sort_values"] == ["1"]


def test_lateral_rows_are_those_of_the_array_form(spark):
    text = "<table><tr><th>h<tr><td>1<td>2<tr><td>3</table><table><tr><td>x<tr><td>y</table>"
    df = pages(spark, text, text, "<table><tr><td>only").withColumn("wanted", F.col("page") + 1)
    rows = lambda d: sorted((r["page"], r["table_no"], r["row_index"], str(r["cells"])) for r in d.collect())
    assert rows(html.lateral_rows(df, "page")) == rows(html.table_rows(df, "page"))
    assert rows(html.lateral_rows(df, "page", table_no=F.col("wanted"), max_rows=1)) == rows(html.table_rows(df, "page", max_rows=1).join(df.select("page", F.col("wanted").alias("table_no")), ["page", "table_no"]))
    only = rows(html.table_rows(df, "page", only=F.col("wanted")))
    assert only == rows(html.table_rows(df, "page").join(df.select("page", F.col("wanted").alias("table_no")), ["page", "table_no"])) and only
    units = spark.createDataFrame([(0, 1), (1, None), (1, 2), (2, 9), (3, 1)], "page int, table_no int")
    assert rows(extract.unit_rows(df, units, "page")) == [r for r in rows(html.table_rows(df, "page")) if r[:2] in {(0, 1), (1, 1), (1, 2)}]


def test_page_links(spark):
    got = html.page_links(pages(spark, "<p><a href='/b'>B</a><a name=x>no</a><!-- <a href='/c'> --><table><tr><td><a href='/d?x=1&amp;y'>D <b>d</b></a>", None), "page")
    assert [tuple(r) for r in got.collect()] == [(0, 0, "/b", "B"), (0, 1, "/d?x=1&y", "Dd")]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_names_in_texts(spark, monkeypatch, block):
    monkeypatch.setattr(lookup, "NAMES_BLOCK", block)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(1, n)))
    names = [(rng.choice("xy"), word(4).title()) for _ in range(40)] + [("x", ""), ("x", None), (None, "A"), ("y", "AB"), ("y", "Ab")]
    texts = {(rng.choice("xyz"), word(9)) for _ in range(300)} | {("x", ""), ("x", None), (None, "a")}
    got = lookup.first_name_in(spark.createDataFrame(sorted(texts, key=str), "s string, t string"), spark.createDataFrame(names, "s string, name string"), "s", "t", "found")
    want = {(s, t, min(hits)) for s, t in texts if t is not None for hits in [[n for c, n in names if n and c == s and n.lower() in t]] if hits}
    assert {r for r in map(tuple, got.collect()) if r[0] is not None} == {w for w in want if w[0] is not None}


def test_many_names(spark):
    """100,000 names over 20,000 texts, without a join of the two."""
    names = spark.range(100_000).select(F.lit("x").alias("s"), F.concat(F.lit("Name "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(";")).alias("name"))
    texts = spark.range(20_000).select(F.lit("x").alias("s"), F.concat(F.lit("the name "), F.lpad((F.col("id") * 6).cast("string"), 6, "0"), F.lit("; and name 000000;")).alias("t"))
    got = lookup.first_name_in(texts, names, "s", "t", "found")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("*"), F.count_distinct("found")).first()[0] == 20_000 and {r[0] for r in got.select("found").distinct().collect()} == {"Name 000000;"}


def test_manifest_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.html").write_text("<p>")
    good = {"name": "n", "test_type": "bio", "html_file": "a/ok.html", "source_url": None, "config_json": {}, "expected_json": [], "enabled": 1}
    entries = [good, 5, {**good, "html_file": " "}, {**good, "html_file": 7}, {**good, "html_file": "/a/ok.html"}, {**good, "html_file": "a/no.html"}, {**good, "config_json": "{}", "expected_json": None}, {"name": "x"}, None, [], {**good, "html_file": " a/ok.html "}]
    texts = spark.createDataFrame([(1, json.dumps(entries)), (2, "{"), (3, "{}"), (4, "[]"), (5, None)], "id int, text string")
    found = files.manifest_errors(files.manifest_entries(texts, "text", "id"), "entry", files.listed_files(spark, str(tmp_path), "*.html"), "path")
    got = {(r["id"], r["index"]): r["errors"] for r in found.select("id", "index", "errors").collect()}
    nobody = ["manifest entry must be a JSON object"]
    assert [got[1, i] for i in range(len(entries))] == [
        [], nobody, ["html_file must be a non-empty string"], ["html_file must be a non-empty string"], ["html_file must be a relative path"], ["html_file does not exist"],
        ["config_json must be a JSON object or array, got string", "expected_json must be a JSON object or array, got void"],
        ["missing required keys: test_type, html_file, source_url, config_json, expected_json, enabled", "html_file must be a non-empty string", "config_json must be a JSON object or array, got void", "expected_json must be a JSON object or array, got void"],
        nobody, nobody, [],
    ]
    assert {k: v for k, v in got.items() if k[0] > 1} == {(2, 0): nobody, (3, 0): nobody, (5, 0): nobody}


def test_rejects(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Country,Party name,Party link\nUS,"A, b",/a\nUS,short\nUS,long,/l,x\nUS,"open,/l\nUS, ,/l\n,n,/l\nUS,n,\nUS,"say ""x""",/q\n')
    got = [(r["Party name"], r["reason"]) for r in files.rejects(files.read_lines(spark, str(path), files.PARTY_HEADERS), *files.PARTY_HEADERS).collect()]
    assert [r for _, r in got] == [None, "malformed line", "malformed line", "malformed line", "no Party name", "no Country", "no Party link", None]
    assert got[0][0] == "A, b"


def test_counters_of_a_write(spark):
    """What is observed while rows are written is what an aggregation counts, with one job's pass over them."""
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("office_id"), F.when(F.col("id") % 3 == 0, "unchanged").otherwise("new").alias("change_type"),
        F.when(F.col("id") % 5 == 0, "No link").otherwise(F.col("id").cast("string")).alias("wiki_url"), F.get(F.array(F.lit("ok"), F.lit("failed"), F.lit("skipped")), (F.col("id") % 4).cast("int")).alias("biography"),
    )
    rows, run = quality.observed(df)
    rows.write.format("noop").mode("overwrite").save()
    want = quality.run_counters(df).first().asDict()
    assert run.get == {k: v for k, v in want.items() if k not in ("offices", "links")} | {"linked": 800}
    assert (want["bio_ok"], want["bio_failed"], want["bio_skipped"], want["offices"], want["terms"]) == (250, 250, 250, 7, 1000)
