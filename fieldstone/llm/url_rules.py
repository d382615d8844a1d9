"""URL filter as a sort-merge range join.

A host's labels in reversed order are its key: the hosts under a rule's host
are then an interval of keys that begins with the rule's own.  URLs are
partitioned by ranges of the key and sorted; a sweep over a partition advances
through the sorted rules and keeps a stack of those whose interval is open.
The path is part of the sort key of URLs, so one host can span many partitions.

Rules are held in blocks of at most `MAX_RULES`; longer lists take several
passes over the same sorted URLs, and the longest rule of all passes wins.

Defined results: a null url or one without `://` has an empty host and path; it
meets no rule and gets the default verdict.  Of rules that fit, the longest host
plus path wins, then the first in text order.  A null page_id is an ordinary
value; repeated rows are judged each on its own; an empty table gives an empty
table; only page_id and url are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules held by a task at a time (host, path, verdict: about 100 bytes each).
MAX_RULES = 100_000

#: Fixed by the contract of the query.
CONTRACT_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_SCHEMA = "page_id long, host string, path string, labels array<string>, rule string, verdict string"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as written, without decoding."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _sweep(rules: list[tuple[str, str, str]]):
    """A function over batches of URLs in the order of their labels."""
    nodes: dict[tuple[str, ...], dict[str, tuple[str, str]]] = {}
    for host, path, verdict in sorted(rules, reverse=True):
        nodes.setdefault(tuple(reversed(host.split("."))), {})[path] = (host + path, verdict)
    ordered = sorted((labels, sorted({len(p) for p in paths}, reverse=True), paths) for labels, paths in nodes.items())

    def best(stack, path: str):
        found = None
        for _, lengths, paths in stack:
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    rule = paths[path[:n]]
                    if found is None or (-len(rule[0]), rule[0]) < (-len(found[0]), found[0]):
                        found = rule
                    break
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = []
        at = 0
        for batch in batches:
            verdicts, names = [], []
            cols = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
            for path, labels, rule, verdict in zip(*cols, strict=True):
                key = tuple(labels)
                while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                while at < len(ordered) and ordered[at][0] <= key:
                    if key[: len(ordered[at][0])] == ordered[at][0]:
                        stack.append(ordered[at])
                    at += 1
                new = best(stack, path)
                if new is not None and (rule is None or (-len(new[0]), new[0]) < (-len(rule), rule)):
                    rule, verdict = new
                names.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names
            )

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = CONTRACT_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for rules of (host, path prefix, verdict)."""
    host, path = parts(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).select(
        "page_id",
        "host",
        "path",
        F.reverse(F.split("host", r"\.", -1)).alias("labels"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"),
    )
    shuffles = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["labels", "path", "page_id"]
    swept = keyed.repartitionByRange(shuffles, *order).sortWithinPartitions(*order)
    listed = sorted(set(rules))
    for i in range(0, len(listed), MAX_RULES):
        swept = swept.mapInArrow(_sweep(listed[i : i + MAX_RULES]), _SCHEMA)
    return swept.select("page_id", "host", "path", "rule", "verdict")
