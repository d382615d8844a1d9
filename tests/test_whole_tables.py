"""Queries that once read a part of their tables."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from fieldstone.plans import QUERIES


def test_cooldown_batch_reads_orders_of_every_kind(spark, tmp_path):
    """A recent order of any status and priority keeps a customer out; an old one, or none, does not."""
    spark.createDataFrame([(7,), (37,), (67,), (97,), (8,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = [(7, "F", "5-LOW", 2001), (7, "P", "1-URGENT", 1995), (37, "O", "2-HIGH", 1996), (37, "F", "1-URGENT", 1997), (97, "P", "1-URGENT", 1999), (97, "O", "5-LOW", 2000)]
    orders = [(i, c, s, p, dt.datetime(year, 5, 20)) for i, (c, s, p, year) in enumerate(rows)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    query = QUERIES["cooldown_batch"]
    got = {tuple(r) for r in query.run(spark, str(tmp_path)).collect()}
    assert got == {(37, dt.datetime(1997, 5, 20)), (67, None)}
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.sql(query.sql).fetchall()) == got


def test_raw_table_preview_parses_in_as_many_tasks_as_there_are(spark, tmp_path):
    """A small file of one row group was read, rendered and parsed by a single task."""
    spark.range(200_000).selectExpr("id AS c_custkey", "concat('Customer#', sha2(string(id), 256)) AS c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    shown = QUERIES["raw_table_preview"].run(spark, str(tmp_path))
    sizes = [r[1] for r in shown.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("shown")).collect()]
    assert len(sizes) > 1 and sum(sizes) == 200_000


def test_html_pages_are_parsed_in_as_many_tasks_as_there_are(spark, tmp_path):
    """Orders are small in bytes, so that adaptive execution left their pages to a few tasks, at worst one more than there are cores."""
    orders = [(i, i % 900, dt.datetime(1995, 1, 1) + dt.timedelta(i % 700)) for i in range(3000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    terms = QUERIES["html_sort_values"].run(spark, str(tmp_path)).withColumn("at", F.spark_partition_id())
    sizes = [r[1] for r in terms.groupBy("at").agg(F.count("*")).collect()]
    assert len(sizes) == 8 and sum(sizes) == 3000
