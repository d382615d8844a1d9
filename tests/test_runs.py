"""Runs over landed pages, and sinks that are read back."""

import pytest
from pyspark.sql import functions as F

from fieldstone.operators import extract
from fieldstone.sources import files, html
from fieldstone.streaming import landing

TERMS = "page_id long, wiki_link string, term_start string"


def page(*people):
    return "<table><tr><th>a" + "".join(f"<tr><td><a href='/wiki/{p}'>{p}</a><td>May {d}, 1990<td>present" for p, d in people) + "</table>"


def terms_of(pages):
    return extract.extract(html.table_rows(pages, "page_id"), extract.Config(table_rows=3), "page_id").select("page_id", "wiki_link", "term_start")


def plain(batches):
    """What three runs one after the other leave: a page's terms are those of its last snapshot that gave any."""
    held = {}
    for batch in batches:
        for i, people in batch:
            if people:
                held[i] = {(i, f"https://en.wikipedia.org/wiki/{p}", f"1990-05-{d:02}") for p, d in people}
    return set().union(*held.values())


BATCHES = [
    [(1, (("Ann", 1), ("Bob", 2))), (2, (("Cy", 3),)), (3, ())],
    [(1, (("Ann", 1), ("Bob", 2))), (2, (("Cy", 4), ("Di", 5)))],
    [(2, ()), (3, (("Ed", 6),)), (1, (("Ann", 7),))],
]


@pytest.fixture
def landed(spark):
    def frame(batch, hour):
        return spark.createDataFrame([(i, "/u", page(*people)) for i, people in batch], "page_id long, url string, html string").withColumn("fetched_at", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp"))

    return [frame(b, h) for h, b in enumerate(BATCHES)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, landed):
    run = landing.PageRun(spark, str(tmp_path / "run"), terms_of, TERMS)
    assert run.terms().count() == 0
    for n, df in enumerate(landed):
        run.process(df, n)
        state = lambda: {tuple(r) for r in run.terms().collect()}
        assert state() == plain(BATCHES[: n + 1])
        for again in range(n + 1):
            if again == n:
                run.process(landed[again], again)
        assert state() == plain(BATCHES[: n + 1])
    assert sorted((r["page_id"], r["batch"]) for r in run.pages().collect()) == [(1, 2), (2, 1), (3, 2)]
    # a batch that failed before its pages were written has left terms that do not count
    spark.createDataFrame([(1, "half", "x")], TERMS).write.parquet(str(tmp_path / "run/terms/batch=3"))
    assert {tuple(r) for r in run.terms().collect()} == plain(BATCHES)


def test_stream(spark, tmp_path, landed):
    run = landing.PageRun(spark, str(tmp_path / "run"), terms_of, TERMS)
    for n, df in enumerate(landed):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = landing.landed_pages(spark, str(tmp_path / "in"), files_per_batch=1)
        landing.run_incrementally(stream, str(tmp_path / "checkpoint"), run.process).awaitTermination()
        assert {tuple(r) for r in run.terms().collect()} == plain(BATCHES[: n + 1])


def test_reports_and_snapshots_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "/wiki/A_B", "<p>é\nx"), (2, "/wiki/C", ""), (3, "/wiki/A_B", "later"), (4, " ", "blank"), (5, "/wiki/D", None)], "page_id long, url string, html string")
    index = files.write_snapshot(pages, str(tmp_path / "snap"))
    texts = {r["page_id"]: r["text"] for r in files.read_texts(spark, str(tmp_path / "snap/html"), "page_id").collect()}
    assert {k: v for k, v in texts.items() if v} == {1: "<p>é\nx"} and set(texts) <= {1, 2, 5}
    assert sorted((r["page_id"], r["file"], r["n_chars"]) for r in index.collect()) == [(1, "A_B", 6), (2, "C", 0), (5, "D", 0)]
    rows = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (2, 1, 0, "c")], "page_id long, row_index int, col_index int, text string")
    reports = files.with_source(files.debug_report(rows, {"table_no": 2}, "page_id"), pages, "page_id")
    files.write_texts(reports, str(tmp_path / "reports"), "page_id", "report")
    got = {r["page_id"]: r["text"] for r in files.read_texts(spark, str(tmp_path / "reports"), "page_id").collect()}
    assert got == {1: "table_no=2\nrows=1\n1: a | b\nhtml=\n<p>é\nx", 2: "table_no=2\nrows=1\n1: c\nhtml=\n"}
