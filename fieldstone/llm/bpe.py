"""Byte-level BPE encoding by folding ranked merges over distinct words, and decoding.

`fold_words` is the method in Spark higher-order functions: each distinct word
starts as an array of single bytes, and a fold merges the neighbours whose joined
bytes have the lowest rank until no joined pair has one.  The rank map is a literal: an array
of small maps, one for each bucket of a hash, so that a look-up is not a search.

On whole tables that form is too slow: ids are needed in the order of the text,
and bringing the encodings of distinct words back to their documents takes either a
shuffle of all words or a fold for each word of each document.  So
`encode` runs the same fold inside Arrow tasks: words are cut out by the split pattern,
each distinct word is folded once a task and remembered (up to `MOST_WORDS`), and the
ids of a text are those of its words.  The rank map is a bytes-to-rank dictionary
that the driver reads and broadcasts; it is as large as the vocabulary.

Defined results: null and empty texts have no ids; a null doc_id is an ordinary value;
repeated rows are encoded each on its own; an empty table gives an empty table; words of
any length are folded in time n log n; other columns are carried only if named.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .native import let
from .words import blocks

#: Distinct words that a task remembers.
MOST_WORDS = 500_000
#: Buckets of the literal rank map.
BUCKETS = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Bytes -> rank from a file of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


# ---- in Spark expressions


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps hex -> rank, the buckets of xxhash64."""
    held: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        held[xxhash.xxh64(piece, seed=42).intdigest() % BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def fold_word(word: Column, table: Column) -> Column:
    """The ids of a binary word."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(table, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), F.hex(piece))

    def step(parts: Column, _: Column) -> Column:
        joined = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda right, i: F.concat(F.get(parts, i), right))
        return let(F.transform(joined, rank), lambda found: merged(parts, found))

    def merged(parts: Column, found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        first = F.slice(parts, F.lit(1), at - 1)
        both = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        return F.when(F.array_min(found).isNull(), parts).otherwise(F.concat(first, both, F.slice(parts, at + 2, F.size(parts))))

    n = F.length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), n), single, step)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank))


def fold_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """word (binary) and ids (array<int>), one row for each distinct word of the column `text`."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    distinct = texts.select(F.explode(found).alias("word")).distinct().select(F.encode("word", "UTF-8").alias("word"))
    return distinct.select("word", fold_word(F.col("word"), rank_map(ranks)).alias("ids"))


# ---- in Arrow tasks


class Folder:
    """The fold over one word, and what is known of words met before."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.known: dict[str, list[int]] = {}

    def fold(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._short(word) if len(word) <= 64 else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        found = [get(word[i : i + 2], 1 << 60) for i in range(len(word) - 1)]
        while found and (least := min(found)) < 1 << 60:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _long(self, word: bytes) -> list[int]:
        """The same with a heap of (rank, place) and links between parts."""
        n = len(word)
        end = list(range(1, n + 1))  # of the part that begins here
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := self.ranks.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            offer(before[i])
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def ids(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        if len(known) > MOST_WORDS:
            known.clear()
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.fold(w.encode("utf-8"))
                if len(w) <= 64:
                    known[w] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_folders: dict[str, Folder] = {}


def folder(data: bytes) -> Folder:
    """The folder of a rank file; a worker process reads each file once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _folders:
        _folders[key] = Folder(read_ranks(data))
    return _folders[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, carried: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The carried columns, ids (array<int>) and, if wanted, decoded (binary: what the ids decode to)."""
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, find = folder(ranks.value), regex.compile(pattern)
        for batch in batches:
            for a, e, data, offsets in blocks(batch, "text"):
                raw, at = data.tobytes(), offsets.tolist()
                ids = [fold.ids(find.findall(raw[x:y].decode("utf-8"))) for x, y in zip(at, at[1:], strict=False)]
                kept = [batch.column(i).slice(a, e - a) for i in range(len(carried))]
                made = [pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    made.append(pa.array([fold.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*carried, "ids", "decoded"][: len(kept) + len(made)])

    chosen = docs.select(*carried, "text")
    more = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary").fields
    schema = T.StructType(chosen.schema.fields[:-1] + more[: 1 + decode])
    return chosen.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
