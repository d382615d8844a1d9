"""Benchmark decontamination with an FM-index per training shard.

The windows of a benchmark item are its runs of 13 words (all its words, if
fewer).  A task indexes its documents shard by shard: the shard's text is the
sequence of word numbers in the benchmark's vocabulary, reduced to the runs of
known words that are long enough to hold a window, which loses no occurrence.
Windows are searched backward through the ranks of a wavelet matrix over the
Burrows-Wheeler transform, all at once; occurrences are located by walking to
sampled suffix positions, and overlapping spans are merged.

Long items are cut into pieces that share the words of a window but one, equal pieces
count once, and pieces are held in blocks of at most `BLOCK_TEXT` bytes (in
expectation).  Each block is broadcast for one pass over the texts.  All passes but the
last write only the spans and items of texts that are hit, by the texts' SHA-256; the last
one returns all rows and is joined with these.

Defined results: a null or empty text has no words and is never contaminated;
an item without words has no windows; a null item_id hits words but is not
listed; a null doc_id is an ordinary value; repeated rows are judged each on its
own; empty tables give no hits.  Only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables
from .words import ALNUM_WORDS, Block, blocks, same_spans, span_hashes

WINDOW = 13
#: Bytes of benchmark text whose windows a task holds at a time.
BLOCK_TEXT = 8 << 20
#: Windows that begin in one piece of an item.
PIECE_WORDS = 1 << 15
_SAMPLE, _SALTS = 8, 16


class FMIndex:
    """Over word numbers 1..; zeros separate runs and are never matched."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        gaps = text == 0
        # separators are distinct and smaller than words, so no comparison goes past one
        rank = np.where(gaps, np.cumsum(gaps) - 1, text.astype(np.int64) + int(gaps.sum()))
        order, h = np.argsort(rank, kind="stable"), 1
        while True:
            key = rank[order]
            same = key[1:] == key[:-1]
            if h > 1:
                next_ = second[order]
                same &= next_[1:] == next_[:-1]
            fresh = np.zeros(n, dtype=np.int64)
            fresh[order[1:]] = np.cumsum(~same)
            rank = fresh
            if not same.any():
                break
            second = np.zeros(n, dtype=np.int64)
            second[:-h] = rank[h:] + 1
            order = np.argsort(rank * (n + 1) + second)
            h *= 2
        self.n = n
        bwt = text[order - 1]
        bwt[order == 0] = 0
        self.bwt = bwt
        counts = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        starts = np.append(True, gaps[:-1])
        marked = (order % _SAMPLE == 0) | starts[order]
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.marked = marked
        self.samples = order[marked]
        self.levels = []
        seq = bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            ranks = np.concatenate(([0], np.cumsum(ones))).astype(np.int64)
            zeros = n - int(ranks[-1])
            self.levels.append((bit, ranks, zeros))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbols occur before the positions of the transform."""
        low, high = np.zeros_like(at), at.copy()
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = ranks[low], ranks[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns, rows padded with zeros at the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((step < lengths) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, at = np.zeros(len(rows), np.int64), rows.copy()
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = at[todo]
            done = self.marked[here]
            out[todo[done]] = self.samples[self.mark_rank[here[done]]] + steps
            todo, here = todo[~done], here[~done]
            symbol = self.bwt[here]
            at[todo] = self.before[symbol] + self.rank(symbol, here)
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items over their vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]]):
        words: dict[bytes, int] = {}
        numbered: list[np.ndarray] = []
        for _, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            block = Block(data, np.array([0, len(data)]), ALNUM_WORDS, lower=True)
            raw = block.data.tobytes()
            numbered.append(np.array([words.setdefault(raw[a:b], len(words)) for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True)], np.int64))
        # the words, in the order of their hashes: all bytes, where each ends, its hash
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum(np.array([len(w) for w in words], np.int64))
        self.starts = self.ends - np.array([len(w) for w in words], np.int64)
        hashes = span_hashes(self.data, self.starts, self.ends)
        order = np.argsort(hashes, kind="stable")
        self.vocabulary, self.starts, self.ends = hashes[order], self.starts[order], self.ends[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found: dict[tuple[int, ...], set[int]] = {}
        for i, own in enumerate(numbered):
            numbers = (place[own] + 1).tolist()
            size = min(WINDOW, len(numbers))
            for a in range(len(numbers) - size + 1 if size else 0):
                found.setdefault(tuple(numbers[a : a + size]), set()).add(i)
        self.names = [None if k is None else str(k) for k, _ in items]
        self.items = list(map(sorted, found.values()))
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.least = int(self.lengths.min()) if found else 0
        self.patterns = np.zeros((len(found), WINDOW), dtype=np.int64)
        for row, w in enumerate(found):
            self.patterns[row, : len(w)] = w

    def numbers(self, block: Block) -> np.ndarray:
        """The number of each word of a block in the vocabulary, from 1; 0 for others.  Hashes find a word, its bytes decide."""
        hashes = block.hashes()
        out = np.zeros(len(hashes), np.int64)
        place = np.searchsorted(self.vocabulary, hashes)
        both, shift = np.concatenate((block.data, self.data)), len(block.data)
        open_ = np.arange(len(hashes))
        while True:
            open_ = open_[place[open_] < len(self.vocabulary)]
            open_ = open_[self.vocabulary[place[open_]] == hashes[open_]]
            if not len(open_):
                return out
            at = place[open_]
            same = same_spans(both, block.starts[open_], block.ends[open_], self.starts[at] + shift, self.ends[at] + shift)
            out[open_[same]] = at[same] + 1
            open_ = open_[~same]
            place[open_] += 1

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Merged spans of hit words (starts, ends, in the words of the block) and the items of each text."""
        texts = block.texts()
        items: list[set[int]] = [set() for _ in range(len(block.first) - 1)]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), items
        if not len(self.patterns) or not len(block.starts):
            return none
        numbers = self.numbers(block)
        known = numbers > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (texts[1:] != texts[:-1])
        start = np.flatnonzero(begins)
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (texts[1:] != texts[:-1])
        end = np.flatnonzero(ends) + 1
        long = end - start >= self.least
        start, end = start[long], end[long]
        if not len(start):
            return none
        # the runs, each followed by a separator; origin: word of the block at each place
        sizes = end - start + 1
        first = np.cumsum(sizes) - sizes
        origin = np.arange(sizes.sum()) - np.repeat(first - start, sizes)
        reduced = numbers[np.minimum(origin, len(numbers) - 1)]
        reduced[first + sizes - 1] = 0
        # only windows all of whose words the shard has can occur
        present = np.ones(len(self.vocabulary) + 1, bool)
        present[1:] = np.bincount(reduced, minlength=len(present))[1:] > 0
        wanted = np.flatnonzero(present[self.patterns].all(axis=1))
        if not len(wanted):
            return none
        index = FMIndex(reduced, len(self.vocabulary))
        low, high = index.search(self.patterns[wanted], self.lengths[wanted])
        occur = high > low
        rows, low, counts = wanted[occur], low[occur], (high - low)[occur]
        if not len(rows):
            return none
        suffixes = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
        window = np.repeat(rows, counts)
        at = origin[index.locate(suffixes)]
        for text, w in set(zip(texts[at].tolist(), window.tolist(), strict=True)):
            items[text].update(self.items[w])
        edge = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.lengths[window], -1)
        hit = np.cumsum(edge[:-1]) > 0
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | (texts[1:] != texts[:-1])
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | (texts[1:] != texts[:-1])
        return np.flatnonzero(begin), np.flatnonzero(stop) + 1, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _union(spans: list[dict]) -> list[dict]:
    """The spans, sorted, with those that overlap or touch joined."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def _search(sent: Broadcast):
    """Over batches of carried columns and, last, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = sent.value
        for batch in batches:
            n_carried = batch.num_columns - 1
            for a, e, data, offsets in blocks(batch, batch.schema.names[n_carried]):
                block = Block(data, offsets, ALNUM_WORDS, lower=True)
                starts, ends, items = windows.hits(block)
                texts = block.texts()[starts] if len(starts) else starts
                base = block.first[texts] if len(starts) else starts
                bounds = np.searchsorted(texts, np.arange(e - a + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(
                    pa.array(bounds), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"])
                )
                names = [sorted({windows.names[i] for i in s} - {None}) for s in items]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, e - a) for i in range(n_carried)), pa.array(np.diff(block.first)), spans.cast(_SPANS), pa.array(names, pa.list_(pa.string()))],
                    names=[*batch.schema.names[:n_carried], "n_words", "spans", "items"],
                )

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over carried columns, n_words, spans, items, and the spans and items of other passes (or null)."""
    for batch in batches:
        n = batch.num_columns - 4
        spans, items, more_spans, more_items = (batch.column(n + k).to_pylist() for k in range(4))
        spans = [_union([*x, *y]) if y else x for x, y in zip(spans, more_spans, strict=True)]
        items = [sorted({*x, *(y or ())}) for x, y in zip(items, more_items, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n], pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names[: n + 2]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) by pieces; no piece of a longer item is shorter than a window."""
    for batch in batches:
        for a, e, data, offsets in blocks(batch, "text"):
            block = Block(data, offsets, ALNUM_WORDS, lower=True)
            rows, texts = [], []
            for i, (lo, hi) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)):
                for at in range(lo, max(hi - WINDOW + 1, min(lo + 1, hi)), PIECE_WORDS):
                    stop = min(hi, at + PIECE_WORDS + WINDOW - 1)
                    rows.append(a + i)
                    texts.append(block.data[block.starts[at] : block.ends[stop - 1]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["item_id", "text"])


def _item_blocks(benchmark: DataFrame, tables: Tables) -> list[DataFrame]:
    """The different pieces of the items in blocks of at most BLOCK_TEXT bytes in expectation."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    pieces = tables.write("pieces", items.mapInArrow(_cut, items.schema).distinct())
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_TEXT))
    return [pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else pieces for i in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, merged spans (start, end in words) and the sorted ids (text) of the items hit."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    span = T.StructType().add("start", "long").add("end", "long")
    more = T.StructType().add("n_words", "long").add("spans", T.ArrayType(span)).add("items", T.ArrayType(T.StringType()))

    def searched(part: DataFrame, *columns: Column) -> tuple[DataFrame, Broadcast]:
        # one block at a time, of a bounded size
        sent = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()]))
        rows = docs.select(*columns, text.alias("text"))
        return rows.mapInArrow(_search(sent), T.StructType(rows.schema.fields[:-1] + more.fields)), sent

    tables = Tables(spark, "decontam")
    *first, last = _item_blocks(benchmark, tables)
    own = [docs[c] for c in carried]
    if not first:
        found = searched(last, *own)[0]
        tables.drop("pieces")
        return found
    key, hits = F.sha2(text, 256), []
    for k, part in enumerate(first):
        found, sent = searched(part, key.alias("key"))
        found = found.filter("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("more_spans"), F.first("items").alias("more_items"))
        hits.append(tables.write(f"pass{k}", found))
        sent.destroy()
    # a text may be on a third of all rows: its hits are there once for each salt
    whole = reduce(DataFrame.unionByName, hits).groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("more_spans", "more_items")))
    salted = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    found = searched(last, F.struct(*own).alias("own"), key.alias("key"), F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"))[0]
    tables.drop("pieces")
    both = found.join(salted, ["key", "salt"], "left").select("own.*", *more.names, "more_spans", "more_items")
    return both.mapInArrow(_united, T.StructType(both.schema.fields[:-2]))


def _hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contract's rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs, benchmark).withColumn("n_hit", _hit()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    packed = docs.select(F.struct("*").alias("whole"), F.col("text"))
    found = find(packed, benchmark, ("whole",)).filter(~contaminated(_hit(), F.col("n_words")))
    return found.select("whole.*")
