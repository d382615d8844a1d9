"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A piece of length l belongs to the class k = capacity // l, and a sequence of
class k takes exactly k pieces.  Documents are cut so that full sequences have
little padding: whole sequences first; what remains stays in one piece if k such
pieces all but fill a sequence, and else gives off the largest piece of the next class.
Full sequences of class k <= 64 so have at most capacity/256 tokens of padding; those
of shorter pieces, the ends of documents, at most capacity/64.

Each task fills the sequences of its own rows, so nothing is shuffled and a hot source
costs no task more than its rows.  A task holds less than one sequence a class.  When its rows end,
the pieces of unfilled sequences are laid end to end and cut anew at the
capacity, and the rest into powers of two, which need no padding.

Each distinct word is tokenized once and remembered: the tokenizer drops white space and none of
its rules reaches over a space.  Texts of ASCII, accented Latin letters and common punctuation, for which the rules are plain, are cut into
words here; chunks between spaces that hold anything else go through the tokenizer.

Defined results: a null or empty text has no tokens but the end token; a null
doc_id is an ordinary value; repeated rows are packed each on its own; an empty
table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Tokens of a sequence.
CAPACITY = 4096
#: Distinct words, and chunks, that a task remembers, and the longest of them in characters.
MOST_WORDS, LONGEST = 1_000_000, 64
#: Characters of a text that are tokenized at a time, cut at a space.
_SEGMENT = 1 << 20
#: Bytes of ids after which a batch of pieces is handed on.
_BATCH_BYTES = 4 << 20

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters (without the dotted capital I, which becomes two characters) and punctuation that need no normalization.
_LETTERS, _MARKS, _BLANKS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F", "\u00A1\u00A7\u00AB\u00BB\u00BF\u2010-\u2027", " \t\n\x0B\f\r"
#: The split rule for lower-case texts of these.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_BLANKS}0-9{_LETTERS}]+")


class Encoder:
    """The ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        fits = (
            steps == ["NFC", "Replace", "Lowercase"]
            and split["pattern"] == {"Regex": _SPLIT}
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and byte_level["type"] == "ByteLevel"
            and not (byte_level["add_prefix_space"] or byte_level["use_regex"])
            and not any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
            and not any(" " in t["content"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError("only tokenizers that drop white space after NFC and lower-casing are cut into chunks")
        self.whole = Tokenizer.from_buffer(data)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.odd = re.compile(rf"[^!-~{_LETTERS}{_MARKS}{_BLANKS}]" + (f"|{special}" if special else ""))
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + _SEGMENT)
            end = len(text) if end < 0 else end
            self._segment(text[at:end], out)
            at = end + 1
        return b"".join(out)

    def _segment(self, text: str, out: list[bytes]) -> None:
        for held in (self.words, self.chunks):
            if len(held) > MOST_WORDS:
                held.clear()
        at = 0
        while odd := self.odd.search(text, at):
            start, end = text.rfind(" ", at, odd.start()) + 1 or at, text.find(" ", odd.start())
            end = len(text) if end < 0 else end
            out += (self._plain(text[at:start]), self._chunk(text[start:end]))
            at = end
        out.append(self._plain(text[at:]))

    def _plain(self, text: str) -> bytes:
        words, known = _WORDS.findall(text.lower()), self.words
        long = {}
        for word in set(words).difference(known):
            (known if len(word) <= LONGEST else long)[word] = self._ids(word)
        get = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return b"".join(map(get, words))

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            found = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(chunk) <= LONGEST:
                self.chunks[chunk] = found
        return found

    def _ids(self, word: str) -> bytes:
        if not word.isascii():  # printable ASCII is written as it is at the level of bytes
            ((word, _),) = self.byte_level.pre_tokenize_str(word)
        ids = [t.id for t in self.whole.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a tokenizer's JSON file; a worker process reads each file once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def cuts(length: int, capacity: int) -> list[int]:
    """The lengths of the pieces of a remainder shorter than a sequence."""
    slack, out = capacity // 256, []
    while length:
        k = capacity // length
        if capacity - k * length <= slack or length <= 4 * slack:
            return [*out, length]
        out.append(capacity // (k + 1))
        length -= out[-1]
    return out


class Packer:
    """Sequences of one task: lists of pieces (document, start, length, ids, tokens of the document)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        self.cuts: dict[int, list[int]] = {}

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """The sequences that are full now."""
        total, at = len(ids) // 4, 0
        rest = total % self.capacity
        if rest not in self.cuts:
            self.cuts[rest] = cuts(rest, self.capacity)
        for length in [*[self.capacity] * (total // self.capacity), *self.cuts[rest]]:
            k = self.capacity // length
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, at, length, ids[4 * at : 4 * (at + length)], total))
            at += length
            if len(pieces) == k:
                yield self.open.pop(k)

    def rest(self) -> Iterator[list[tuple]]:
        """What is left, cut at the capacity and then into powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(p[2] for p in pieces)
        self.open, room, sequence = {}, 0, []
        for doc, start, length, ids, total in pieces:
            at = 0
            while at < length:
                if not room:
                    if sequence:
                        yield sequence
                    room, sequence = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1, []
                take = min(room, length - at)
                sequence.append((doc, start + at, take, ids[4 * at : 4 * (at + take)], total))
                at, room, left = at + take, room - take, left - take
        if sequence:
            yield sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: the path of its JSON file, which the driver reads; end_id follows the ids of each
    document; capacity: a power of two, 256 at least.  A sequence's number is its task's number and its place there,
    so a task that runs again gives the same.
    """
    if capacity < 256 or capacity & capacity - 1:
        raise ValueError("the capacity has to be a power of two, 256 at least")
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names)])
    kind = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(spec.value).encode, Packer(capacity), end_id.to_bytes(4, "little")
        number, docs_of, rows_of, held = TaskContext.get().partitionId() << 32, [], [], 0
        doc_kind = None

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows_of, strict=True), kind, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(docs_of, doc_kind), *columns], names=schema.names)

        def sequences() -> Iterator[list[tuple]]:
            nonlocal doc_kind
            for batch in batches:
                doc_kind = batch.column(0).type
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield from packer.add(doc.as_py(), encode(text.as_py()) + end)
            yield from packer.rest()

        for sequence in sequences():
            offset = 0
            for doc, start, length, ids, total in sequence:
                docs_of.append(doc)
                rows_of.append((start, length, ids, total, number, offset))
                offset += length
                held += len(ids)
            number += 1
            if held > _BATCH_BYTES:
                yield made()
                docs_of, rows_of, held = [], [], 0
        if rows_of:
            yield made()

    return rows.mapInArrow(work, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """What the numbered query returns, from the rows of pack()."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
