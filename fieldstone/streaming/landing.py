"""Incremental runs over a folder in which page snapshots land, as Structured Streaming (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def landed_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of snapshots written as Parquet."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_incrementally(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None]):
    """Each batch of new snapshots, the last one of each page, goes through `process` once; ends when all that has landed is done."""

    def batch(df: DataFrame, number: int) -> None:
        columns = [c for c in df.columns if c != "page_id"]
        last = df.groupBy("page_id").agg(F.max_by(F.struct(*columns), F.struct("fetched_at", "html")).alias("s")).select("page_id", "s.*")
        process(last, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PageRun:
    """Terms of landed pages, batch by batch, in a folder: `pages` (page_id, sha256) and `terms`, each in parts by batch.

    A batch writes only pages whose content has changed; what holds now is each page's last part.  A page that gives no
    row keeps what it gave before.  A batch reads only parts of batches before it and replaces its own, so a batch that runs again, be it
    after a failure half-way or in full, changes nothing: terms are written first and count only once their page's row is there.
    """

    def __init__(self, spark: SparkSession, folder: str, terms_of: Callable[[DataFrame], DataFrame], terms_schema: str):
        """terms_of: pages -> rows of terms, with page_id; terms_schema: their columns."""
        self.spark, self.folder, self.terms_of = spark, folder, terms_of
        self.schemas = {"pages": "page_id long, sha256 string, batch long", "terms": f"{terms_schema}, batch long"}

    def _parts(self, name: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], self.schemas[name])

    def _write(self, name: str, df: DataFrame, number: int) -> DataFrame:
        part = f"{self.folder}/{name}/batch={number}"
        df.write.mode("overwrite").parquet(part)
        return self.spark.read.schema(df.schema).parquet(part)

    def pages(self, before: int | None = None) -> DataFrame:
        """The last part of each page: page_id, sha256, batch."""
        parts = self._parts("pages")
        parts = parts if before is None else parts.filter(F.col("batch") < before)
        return parts.groupBy("page_id").agg(F.max_by("sha256", "batch").alias("sha256"), F.max("batch").alias("batch"))

    def terms(self, before: int | None = None) -> DataFrame:
        """The terms that hold now."""
        return self._parts("terms").join(self.pages(before).select("page_id", "batch"), ["page_id", "batch"], "left_semi").drop("batch")

    def process(self, batch: DataFrame, number: int) -> None:
        known = self.pages(number).select("page_id", F.col("sha256").alias("known"))
        changed = batch.withColumn("sha256", F.sha2("html", 256)).join(known, "page_id", "left").filter(~F.col("sha256").eqNullSafe(F.col("known")))
        given = self._write("terms", self.terms_of(changed.drop("sha256", "known")), number)
        some = given.select("page_id").distinct()
        self._write("pages", changed.join(some, "page_id", "left_semi").select("page_id", "sha256"), number)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by type and time window, with a watermark for late ones."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
