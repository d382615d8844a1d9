"""Balanced shards by longest-processing-time scheduling.

Rows with equal texts form a group and stay together.  Groups of the same size
are interchangeable, so the driver holds classes (size, number of groups), not
groups: their sizes are different whole numbers that add up to at most all
bytes, so there are fewer than sqrt(2 * bytes) of them.  The heap deals the classes, largest
size first, each group to the least-loaded shard (law `bytes`); what it
returns is how many groups of a class each shard gets, and a group is placed by
its number within its class.  The loads are those of dealing all groups one by one.

Classes of many groups, and shards, are numbered in parts by a hash, with the
counts of the parts summed up on the driver, so no task sorts a whole class or shard,
and a hot group is split over the parts of its shard.

Defined results: a null text is the empty text (size 1, CRC 0); a null doc_id
is an ordinary value; repeated rows get slots of their own; an empty table
gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

#: Groups, and rows, that a task numbers at a time.
PART = 1_000_000


def _dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets when each goes to the least-loaded one."""
    shards = range(len(loads))
    if count <= 8 * len(loads):
        got, heap = [0] * len(loads), [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        return got
    # the items taken while a shard's load is below a level, for the highest level that needs no more items than there are
    below = lambda level: [max(0, -(-(level - loads[s]) // size)) for s in shards]
    low, high = min(loads), min(loads) + (count + 1) * size
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    got, left = below(low), count - sum(below(low))
    for s in sorted(shards, key=lambda s: (loads[s] + got[s] * size, s))[:left]:
        got[s] += 1
    return got


def longest_first(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, groups of each shard) for classes (size, number of groups): largest first, to the least-loaded shard."""
    loads, plan = [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        got = _dealt(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, got, strict=True)]
        plan.append((size, got))
    return plan


def _numbered(rows: DataFrame, within: str, spread: Column, order: list[str], counts: dict) -> DataFrame:
    """rows with `number`: 0, 1, ... within each value of a column; counts has the rows of each value."""
    spark = rows.sparkSession
    # fewer than rows / PART values have several parts
    large = spark.createDataFrame([(k, -(-n // PART)) for k, n in counts.items() if n > PART] or [], f"{within} {rows.schema[within].dataType.simpleString()}, parts long")
    rows = rows.join(F.broadcast(large), within, "left").withColumn("part", F.coalesce(F.pmod(spread, F.col("parts")), F.lit(0).cast("long")))
    before = {}
    for r in rows.filter("parts IS NOT NULL").groupBy(within, "part").count().orderBy(within, "part").toLocalIterator() if large.count() else ():
        before.setdefault(r[within], []).append((r["part"], r["count"]))
    starts = [(k, p, at) for k, parts in before.items() for (p, _), at in zip(parts, accumulate([0, *(n for _, n in parts)]), strict=False)]
    table = spark.createDataFrame(starts, f"{within} {rows.schema[within].dataType.simpleString()}, part long, before long")
    rank = F.row_number().over(Window.partitionBy(within, "part").orderBy(*order)) - 1
    numbered = rows.withColumn("rank", rank).join(F.broadcast(table), [within, "part"], "left")
    return numbered.withColumn("number", F.coalesce("before", F.lit(0).cast("long")) + F.col("rank")).drop("parts", "part", "rank", "before")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    tables = Tables(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    groups = tables.write("groups", rows.groupBy("text_key").agg(F.sum("size").alias("bytes")))
    classes = {r["bytes"]: r["count"] for r in groups.groupBy("bytes").count().toLocalIterator()}
    # the last group number of each shard in a class, exclusive
    ends = [(size, list(accumulate(got))) for size, got in longest_first(list(classes.items()), shards)]
    dealt = spark.createDataFrame(ends, "bytes long, ends array<long>")
    placed = _numbered(groups, "bytes", F.xxhash64("text_key", F.lit(1)), ["text_key"], classes).join(dealt, "bytes")
    placed = placed.select("text_key", F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard"))
    sent = tables.write("rows", rows.join(placed, "text_key").select("doc_id", "size", "text_crc32", "shard"))
    tables.drop("groups")
    counts = {r["shard"]: r["count"] for r in sent.groupBy("shard").count().collect()}
    slotted = _numbered(sent, "shard", F.xxhash64("doc_id", "size", "text_crc32"), ["doc_id", "text_crc32", "size"], counts)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
