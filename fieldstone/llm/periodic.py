"""Periodic runs of words, by bit-parallel lags.

A run is a stretch of words with smallest period q that repeats it four times and
more, has six words or more and that no neighbouring word extends.  The words
of a text are numbered and their numbers held as bit planes, one big integer for each
bit.  For a lag q each plane is compared with itself shifted by q (XOR) and the
mismatches of all planes are joined (OR); ANDs with shifts that double isolate the
zero stretches of the mismatches that are long enough.

Only lags that can have a run are compared: a stretch of 3 q equal words
at lag q, with s <= q < 2 s for a power of two s, holds two whole blocks of s words that
start at multiples of s, so both blocks' hashes occur again q words later.  The
hashes only choose lags; a collision costs time and changes no result.  A lag is
also left out where all its blocks lie in a run whose period divides it.

Defined results: a null or empty text has no words and no runs; a null doc_id is an
ordinary value; repeated rows are judged each on its own; an empty table gives an
empty table; other columns are carried only if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix

#: A run repeats its period so many times at least ...
TIMES = 4
#: ... and has so many words at least.
LEAST_WORDS = 6
#: Words of a text that are joined at a time.
_CHUNK = 100_000
#: Bytes of text after which a batch of results is handed on.
_BATCH_BYTES = 4 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(text: str) -> tuple[np.ndarray, list[str]]:
    """The words of a text as numbers, and the word of each number."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(m.group(), len(seen)) for m in _WORD.finditer(text)), dtype=np.int64)
    return ids, list(seen)


def planes(ids: np.ndarray, distinct: int) -> list[int]:
    """Bit i of plane b is bit b of the number of word i."""
    return [
        int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little")
        for b in range(max(distinct - 1, 0).bit_length())
    ]


def stretches(planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of `least` words and more that equal the words `lag` later."""
    mismatch = 0
    for plane in planes:
        mismatch |= plane ^ plane >> lag
    equal = ~mismatch & (1 << n - lag) - 1
    have = 1
    while have < least and equal:
        step = min(have, least - have)
        equal &= equal >> step
        have += step
    if not equal:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.frombuffer(equal.to_bytes((n - lag + 7) // 8, "little"), dtype=np.uint8)
    edges = np.diff(np.unpackbits(bits, bitorder="little", count=n - lag).astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts + least - 1


def lags(ids: np.ndarray, distinct: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Lags that may have a run, ascending: the lag, starts of twice `block` words that are repeated there, and `block`."""
    n, block = len(ids), 1
    if not distinct:
        return
    windows = mix(ids.astype(np.uint64) + np.uint64(1))
    while TIMES * block <= n:
        at = np.arange(block, len(windows))
        before = (at // block - 1) * block
        same = windows[at] == windows[before]
        twice = np.flatnonzero(same[:-block] & same[block:])
        lag = at[twice] - before[twice]
        order = np.argsort(lag, kind="stable")
        lag, starts = lag[order], before[twice][order]
        found, first = np.unique(lag, return_index=True)
        for q, part in zip(found.tolist(), np.split(starts, first[1:]), strict=False):
            if TIMES * q <= n:
                yield q, part, block
        windows = mix(windows[: len(windows) - block] * np.uint64(0xD6E8FEB86659FD93) + windows[block:])
        block *= 2


def runs_of(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    bits, n = planes(ids, distinct), len(ids)
    found = np.zeros((0, 3), dtype=np.int64)
    for q, starts, block in lags(ids, distinct):
        inner = found[q % found[:, 2] == 0]
        if len(inner):
            inner = inner[np.argsort(inner[:, 0], kind="stable")]
            reach = np.maximum.accumulate(inner[:, 0] + inner[:, 1])
            k = np.searchsorted(inner[:, 0], starts, side="right") - 1
            if np.all((k >= 0) & (reach[k] >= starts + 2 * block + q)):
                continue
        at, length = stretches(bits, n, q, max(LEAST_WORDS, TIMES * q) - q)
        length = length + q
        if len(at) and len(inner):  # the same stretch with a smaller period
            held = set(zip(inner[:, 0].tolist(), inner[:, 1].tolist(), strict=True))
            own = np.array([pair not in held for pair in zip(at.tolist(), length.tolist(), strict=True)], dtype=bool)
            at, length = at[own], length[own]
        if len(at):
            found = np.concatenate([found, np.stack([at, length, np.full(len(at), q)], axis=1)])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _collapsed(ids: np.ndarray, words: list[str]) -> str:
    return " ".join(" ".join([words[i] for i in ids[k : k + _CHUNK].tolist()]) for k in range(0, len(ids), _CHUNK))


def detect(docs: DataFrame, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, runs (start, length, period; by start, then period) and collapsed, the text without what repeats."""
    rows = docs.select(*carried, F.coalesce("text", F.lit("")).alias("text"))
    own = [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(_RUN)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*rows.schema.fields[:-1], *own])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                n_words, runs, collapsed, held, begun = [], [], [], 0, at
                while at < batch.num_rows and held < _BATCH_BYTES:
                    text = texts[at].as_py()
                    ids, words = numbered(text)
                    found = runs_of(ids, len(words))
                    n_words.append(len(ids))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                    collapsed.append(_collapsed(ids[kept_words(len(ids), found)], words))
                    held += len(text)
                    at += 1
                kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                made = [pa.array(n_words, pa.int64()), pa.array(runs, kinds), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(begun, at - begun) for c in batch.columns[:-1]), *made], names=schema.names)

    return rows.mapInArrow(work, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, the first of several; null without runs."""
    none = F.lit(None).cast(_RUN.removeprefix("array<").removesuffix(">"))
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(best, r), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """What the numbered query returns, from the rows of detect()."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
