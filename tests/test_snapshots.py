"""Landed snapshots read in batch and as a stream, against the rows of a plain read."""

import os

import pytest
from pyspark.sql import functions as F

from fieldstone.sources import html
from fieldstone.sources.snapshots import PageSnapshots, land


def page(*names):
    return "<table><tr><td>stub</table><table><tr><th>a" + "".join(f"<tr><td>{n}<td>x" for n in names) + "</table>"


@pytest.fixture
def landed(spark, tmp_path):
    spark.dataSource.register(PageSnapshots)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = "page_id long, html string, etag string, fetched_at timestamp_ntz"
    frames = []
    for n, rows in enumerate([[(i, page(f"p{i}", "old"), "e0") for i in range(40)], [(i, page(f"p{i}", "new", "more"), "e1") for i in range(0, 40, 3)] + [(99, None, "e1")]]):
        df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("fetched_at", F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp"))
        land(df, str(tmp_path / "landed"), n, buckets=4)
        frames.append(df)
    return str(tmp_path / "landed"), frames


def plain(df):
    last = df.groupBy("page_id").agg(F.max_by(F.struct("html", "etag"), "fetched_at").alias("s")).select("page_id", "s.*")
    rows = html.table_rows(last, "page_id", "etag")
    return sorted(tuple(r) for r in rows.select("page_id", "etag", "table_no", "row_index", F.transform("cells", lambda c: c["text"])).collect())


def test_batch_read(spark, landed):
    folder, frames = landed
    got = spark.read.format("page_snapshots").load(folder)
    assert got.rdd.getNumPartitions() == 4
    want = plain(frames[0].union(frames[1]))
    assert sorted(tuple(r) for r in got.collect()) == want
    second = got.filter("table_no = 2 AND row_index > 0")
    assert sorted(tuple(r) for r in second.collect()) == [r for r in want if r[2] == 2 and r[3] > 0]


@pytest.mark.parametrize("enabled", ["false", "true"])
def test_reads_whether_or_not_filters_are_pushed(spark, landed, enabled):
    folder, frames = landed
    want = [r for r in plain(frames[0].union(frames[1])) if r[2] == 2]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", enabled)
    read = lambda **options: spark.read.format("page_snapshots").options(**options).load(folder)
    assert sorted(tuple(r) for r in read().filter("table_no = 2").collect()) == want
    assert sorted(tuple(r) for r in read(table_no=2).collect()) == want
    if enabled == "true":
        assert sorted(tuple(r) for r in read(pushdown=True).filter("table_no = 2").collect()) == want
        assert read(pushdown=True, table_no=2).filter("table_no = 1").count() == 0


def test_no_folder(spark, landed):
    assert spark.read.format("page_snapshots").load(landed[0] + "/none").count() == 0


def test_a_batch_that_is_being_written_is_not_read(spark, landed):
    folder, frames = landed
    later = frames[1].limit(3).withColumn("fetched_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    land(later, folder, 2, buckets=4)
    os.remove(f"{folder}/batch=2/_SUCCESS")
    assert sorted(tuple(r) for r in spark.read.format("page_snapshots").load(folder).collect()) == plain(frames[0].union(frames[1]))


def test_stream_read(spark, landed, tmp_path):
    folder, frames = landed
    query = spark.readStream.format("page_snapshots").load(folder).writeStream.format("memory").queryName("snaps").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("snaps").collect()) == plain(frames[0].union(frames[1]))
        later = frames[1].limit(3).withColumn("fetched_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
        land(later, folder, 2, buckets=4)
        query.processAllAvailable()
        assert spark.table("snaps").count() == len(plain(frames[0].union(frames[1]))) + len(plain(later))
    finally:
        query.stop()
