"""Substring dedup by seed and extend over winnowed anchors.

A window is 13 consecutive words.  Its anchor is the smallest hash among its
9 runs of 5 words, so equal windows have equal anchors (winnowing: any repeat
of 13 words shares one).  Documents are joined on anchors: rows (anchor, doc) are
sorted over range partitions and only anchors of two documents or more go on
as seeds.  Each seed is extended both ways to the windows whose anchor it is;
these are sorted the same way by 128 bits of hash, and a window that also starts in a document
with a smaller doc_id is a repeat.  Touching repeats of a document are joined
to maximal spans when its words are removed.

Range partitions over (hash, doc_id) split what a common passage brings over
as many tasks as needed; a task reads its rows as a stream.  Runs that cross
the border of two partitions are settled by the least doc_id of each such
hash, of which there are two a partition at most.  Exact copies of a text
are settled first: all windows of a later copy repeat; a group of copies that
holds many of all rows is dealt over several tasks.

Defined results: null and empty texts have no words; a text under 13 words has no
windows and keeps all words; a document with a null doc_id neither removes nor loses
words; rows with the same doc_id never repeat each other (only a smaller doc_id does);
an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables
from .words import BLANK_WORDS, Block, blocks, grams, mix

WINDOW, SEED = 13, 5

#: A window is known by two hashes that share no number: seeds of 64 bits each.
_PAIRS = ["hash", "check", "doc_id"]
_CHECK = 0x2545F4914F6CDD1D
_SEEDS = ["hash", "doc_id"]


def _windows(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its first word and the hash of its anchor."""
    at = np.flatnonzero(block.room(length))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    seeds = grams(block.hashes(), SEED)
    n = len(block.starts) - length + 1
    least = seeds[:n].copy()
    for i in range(1, length - SEED + 1):
        np.minimum(least, seeds[i : i + n], out=least)
    return at, least[at]


def _whole(block: Block, length: int, at: np.ndarray) -> np.ndarray:
    """Two hashes of the windows that start at some words, side by side."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    return np.stack([grams(block.hashes(seed), length)[at] for seed in (0, _CHECK)], axis=1).view(np.int64)


def _one(hashes: np.ndarray) -> np.ndarray:
    """One number for two hashes, to find them among those of the same document."""
    return mix(hashes[:, 0].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ hashes[:, 1].view(np.uint64))


def _rows(hashes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(hashes[:, k])) for k in (0, 1)), pa.array(ids)], names=_PAIRS)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True for the first row and rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _distinct(hashes: np.ndarray, texts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Each pair of hashes of a text once."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0], texts))
    h, t = hashes[order], texts[order]
    new = _changes(h[:, 0], h[:, 1], t)
    return _rows(h[new], ids[t[new]])


def _seeds(anchors: np.ndarray, texts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Each anchor of a text once; a seed needs no second hash."""
    order = np.lexsort((anchors, texts))
    h, t = anchors[order], texts[order]
    new = _changes(h, t)
    return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[t[new]])], names=_SEEDS)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, e, data, offsets in blocks(batch, "text"):
                block = Block(data, offsets, BLANK_WORDS)
                at, anchors = _windows(block, length)
                new = _changes(anchors)
                yield _seeds(anchors[new], block.texts()[at[new]], ids[a:e])

    return run


def _seeded(length: int):
    """The windows whose anchor is among the seeds of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            seeds = batch.column(2)
            for a, e, data, offsets in blocks(batch, "text"):
                block = Block(data, offsets, BLANK_WORDS)
                at, anchors = _windows(block, length)
                bounds = np.searchsorted(at, block.first)
                keep = np.zeros(len(at), dtype=bool)
                for i in range(e - a):
                    lo, hi = bounds[i], bounds[i + 1]
                    keep[lo:hi] = np.isin(anchors[lo:hi].view(np.int64), seeds[a + i].values.to_numpy(), kind="sort")
                yield _distinct(_whole(block, length, at[keep]), block.texts()[at[keep]], ids[a:e])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, doc_id): those of hashes of two documents or more.

    The first and the last run of a partition may go on in another one; they count as shared.
    """
    last: tuple | None = None
    known = held = False
    rows = lambda h, d: pa.RecordBatch.from_arrays([pa.array(h), pa.array(d)], names=_SEEDS)
    for batch in batches:
        h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(h):
            continue
        if held:
            h, d = np.append(last[0], h), np.append(last[1], d)
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        end = np.append(start[1:], len(h))
        shared = d[start] != d[end - 1]
        if last is None or (known and h[0] == last[0]):
            shared[0] = True
        known, last = bool(shared[-1]), (h[-1], d[-1])
        held = not known
        keep = np.repeat(shared, end - start)
        yield rows(h[keep], d[keep])
    if held:
        yield rows(np.array([last[0]]), np.array([last[1]]))


#: What `_repeats` says of a row: it repeats; it may (its hash may have begun in a partition before); the least of a hash that may go on.
_SURE, _OPEN, _LEAST = 0, 1, 2


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, check, doc_id), with what each says."""
    first = current = least = None

    def rows(h, c, d, say):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(d), pa.array(np.full(len(h), say, np.int32))], names=[*_PAIRS, "says"])

    for batch in batches:
        h, c, d = (batch.column(k).to_numpy() for k in range(3))
        if not len(h):
            continue
        first = (h[0], c[0]) if first is None else first
        start = np.flatnonzero(_changes(h, c))
        low = d[start].copy()
        if current is not None and (h[0], c[0]) == current:
            low[0] = least
        current, least = (h[-1], c[-1]), low[-1]
        begun = np.repeat(low, np.diff(np.append(start, len(h))))
        open_ = (h == first[0]) & (c == first[1])
        sure = (d > begun) & ~open_
        yield rows(h[sure], c[sure], d[sure], _SURE)
        if open_.any():
            yield rows(h[open_], c[open_], d[open_], _OPEN)
    if current is not None:
        yield rows(np.array([current[0]]), np.array([current[1]]), np.array([least]), _LEAST)


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, copies = batch.column(2), batch.column(3).to_pylist()
            for a, e, data, offsets in blocks(batch, "text"):
                block = Block(data, offsets, BLANK_WORDS)
                at = np.flatnonzero(block.room(length))
                windows = _one(_whole(block, length, at))
                raw, n_removed, spans, texts = data.tobytes(), [], [], []
                for i in range(e - a):
                    lo, hi = block.first[i], block.first[i + 1]
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    x, y = np.searchsorted(at, (lo, hi))
                    starts = at[x:y] - lo
                    if copies[a + i]:
                        pass
                    elif hits[a + i].is_valid:
                        starts = starts[np.isin(windows[x:y], _one(_pairs(hits[a + i].values)), kind="sort")]
                    else:
                        starts = starts[:0]
                    mine = []
                    for s in starts.tolist():
                        if mine and s <= mine[-1]["end"]:
                            mine[-1]["end"] = s + length
                        else:
                            mine.append({"start": s, "end": s + length})
                    for m in reversed(mine):
                        del words[m["start"] : m["end"]]
                    spans.append(mine)
                    n_removed.append(int(hi - lo) - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, e - a),
                        pa.array(np.diff(block.first)),
                        pa.array(n_removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(texts, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "spans", "text"],
                )

    return run


def _pairs(hits: pa.StructArray) -> np.ndarray:
    return np.stack([hits.field(k).to_numpy() for k in ("hash", "check")], axis=1)


def _sorted(pairs: DataFrame, by: list[str]) -> DataFrame:
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartitionByRange(n, *by).sortWithinPartitions(*by)


#: A group of copies that holds over one row in this many is dealt over several tasks; so there are no more such groups than that.
HOT = 2048

_TEXT = ["k1", "k2", "k3"]


def _copies(named: DataFrame) -> DataFrame:
    """doc_id and `copied`, the hashes of those of its texts that a smaller doc_id has too."""
    keys = named.select("doc_id", F.xxhash64("text").alias("k1"), F.crc32(F.encode("text", "UTF-8")).alias("k2"), F.octet_length("text").alias("k3"))
    most = max(named.count() // HOT, 1)
    groups = keys.groupBy(*_TEXT).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    cells = groups.select(*_TEXT, "first", F.explode(F.sequence(F.lit(0), (F.col("n") / most).cast("int"))).alias("cell"))
    # as many rows as there are groups of over a HOT-th of all rows
    hot = F.broadcast(groups.filter(F.col("n") > most).select(*_TEXT, ((F.col("n") / most).cast("int") + 1).alias("n_cells")))
    placed = keys.join(hot, _TEXT, "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("doc_id"), "n_cells").cast("int"), F.lit(0)))
    return placed.join(cells, [*_TEXT, "cell"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("k1").alias("copied"))


def dedup(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans removed (start, end in words) and the words left, joined by one space.

    What copies and repeats are is written as tables first, so it is computed once and all later steps see the same borders of partitions.
    """
    tables = Tables(docs.sparkSession, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = texts.filter("doc_id IS NOT NULL")
    copies = tables.write("copies", _copies(named))
    is_copy = F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False))

    pairs, wide = "hash long, doc_id long", "hash long, check long, doc_id long"
    # copies can't seed: what they share with later documents their first one shares too
    firsts = named.join(copies, "doc_id", "left").filter(~is_copy).select("doc_id", "text")
    seeds = _sorted(firsts.mapInArrow(_anchors(length), pairs), _SEEDS).mapInArrow(_shared, pairs)
    seeds = seeds.groupBy("doc_id").agg(F.collect_list("hash").alias("seeds"))
    windows = named.join(seeds, "doc_id").select("doc_id", "text", "seeds").mapInArrow(_seeded(length), wide)
    said = tables.write("said", _sorted(windows, _PAIRS).mapInArrow(_repeats, wide + ", says int"))
    border = said.filter(F.col("says") != _SURE).groupBy("hash", "check").agg(F.min("doc_id").alias("least"))
    # two hashes for each partition at most
    settled = said.filter(F.col("says") == _OPEN).join(F.broadcast(border), ["hash", "check"]).filter("doc_id > least")
    repeats = said.filter(F.col("says") == _SURE).select(*_PAIRS).unionByName(settled.select(*_PAIRS))
    repeats = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "check")).alias("hits"))
    ready = texts.join(repeats, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "hits", is_copy.alias("copy"))
    return ready.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
