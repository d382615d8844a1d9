"""Landed page snapshots as a Python data source: table rows of each page's newest snapshot, in batch and as a stream.

Snapshots lie as Parquet files under `<folder>/batch=<n>/bucket=<k>`, a page always in the same bucket.  A bucket is a partition of
the reader: its keys are read first, and then only the newest snapshot of each page is parsed.  The option table_no has the
rows of one table built only; where Spark pushes filters into Python sources, the option pushdown does the same by a filter on
table_no.  Nothing is fetched.  Folders are opened by Arrow, so they are on a file system that all machines share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from .html import parse

ROWS = "page_id long, etag string, table_no int, row_index int, cells array<string>"


def land(pages: DataFrame, folder: str, batch: int, buckets: int = 16) -> None:
    """Write snapshots (page_id, html, etag, fetched_at) as one batch; the same batch again replaces itself."""
    rows = pages.select("page_id", "html", "etag", "fetched_at", F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int").alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")


@dataclass
class _Bucket(InputPartition):
    paths: list[str]


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), folder.removeprefix("file:").replace("//", "/")) if folder.startswith(("file:", "/")) else pafs.FileSystem.from_uri(folder)


def _folders(fs: pafs.FileSystem, path: str, name: str) -> dict[int, str]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return {int(i.base_name.split("=")[1]): i.path for i in found if i.base_name.startswith(f"{name}=")}


def _batches(folder: str) -> dict[int, str]:
    """Batches that have been written in full: one that is still being written has no mark yet, and is read later."""
    fs, path = _opened(folder)
    found = _folders(fs, path, "batch")
    marks = fs.get_file_info([f"{b}/_SUCCESS" for b in found.values()])
    return {n: b for (n, b), mark in zip(found.items(), marks, strict=True) if mark.type == pafs.FileType.File}


def _buckets(folder: str, after: int | None = None, upto: int | None = None) -> list[_Bucket]:
    fs, _ = _opened(folder)
    paths: dict[int, list[str]] = {}
    for n, batch in _batches(folder).items():
        if (after is None or n > after) and (upto is None or n <= upto):
            for k, bucket in _folders(fs, batch, "bucket").items():
                paths.setdefault(k, []).append(bucket)
    return [_Bucket(sorted(paths[k])) for k in sorted(paths)]


def _newest(folder: str, bucket: _Bucket, table_no: int | None) -> Iterator[tuple]:
    """Rows of the newest snapshot of each page; among equal times the greatest validator, then one of them."""
    fs, _ = _opened(folder)
    files = [i.path for p in bucket.paths for i in fs.get_file_info(pafs.FileSelector(p)) if i.base_name.endswith(".parquet")]
    data = ds.dataset(files, filesystem=fs, format="parquet")
    newest: dict[int, tuple] = {}
    place = 0
    for batch in data.scanner(columns=["page_id", "fetched_at", "etag"], use_threads=False).to_batches():
        for page, at, etag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rank = (at is not None, at, etag or "", place)
            if page not in newest or rank > newest[page]:
                newest[page] = rank
            place += 1
    wanted, place = {rank[-1] for rank in newest.values()}, 0
    for batch in data.scanner(columns=["page_id", "etag", "html"], batch_size=256, use_threads=False).to_batches():
        for page, etag, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if place in wanted and html is not None:
                for k, table in enumerate(parse(html).all("table"), 1):
                    if table_no is None or k == table_no:
                        for i, tr in enumerate(table.all("tr")):
                            yield page, etag, k, i, [c.text() for c in tr.all("td", "th")]
            place += 1


class _Reader(DataSourceReader):
    def __init__(self, folder: str, table_no: int | None = None):
        self.folder, self.table_no = folder, table_no

    def partitions(self) -> list[_Bucket]:
        return _buckets(self.folder) or [_Bucket([])]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        return _newest(self.folder, partition, self.table_no) if partition.paths else iter(())


class _PushingReader(_Reader):
    """Spark refuses a reader with pushFilters unless spark.sql.python.filterPushdown.enabled is set, so it is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("table_no",) and self.table_no is None:
                self.table_no = f.value
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """Batches by their numbers, which rise; each round gives the newest snapshots among the batches that have landed since."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(self.folder), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Bucket]:
        return _buckets(self.folder, start["batch"], end["batch"])

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        return _newest(self.folder, partition, None)


class PageSnapshots(DataSource):
    """Format `page_snapshots`; `path` names the folder, `table_no` the only table wanted (batch reads), `pushdown` whether filters are pushed."""

    @classmethod
    def name(cls) -> str:
        return "page_snapshots"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:
        kind = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        only = self.options.get("table_no")
        return kind(self.options["path"], None if only is None else int(only))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])
