"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers are compiled from the tokenizer's file.

The first reads classes of characters and marks where pieces (the matches of
the tokenizer's split pattern) start.  It has 12 states, so what a chunk of text does
is a map of 12 states to 12 states: chunks are run from all states at once,
their maps are composed by a parallel prefix scan, and each chunk is run again
from the state that it is really entered in.  A special string of the tokenizer
is cut out before and counts as one token.

The second reads the bytes of a piece and annotates each transition with the
change of the token count.  Its state holds, for each place from which a token
may still go on, the position in the tree of tokens, the last token before
that place and the count there relative to the count now.  A token may follow
another one if no merge across their border comes first, which makes the last
token of every prefix unique.  States are compiled as they are met; a task
forgets them when there are `MOST_STATES`.

Equal pieces of a block of texts are counted once.  A task holds one block of
texts at a time; a text longer than a block is a block of its own.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null doc_id is an
ordinary value; repeated rows are counted each on its own; an empty table gives an
empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, same_spans, span_hashes

LIMIT = 512
#: Characters of a chunk of the first transducer.
CHUNK = 512
#: States, and counts of pieces, that a task remembers.
MOST_STATES, MOST_PIECES = 200_000, 1_000_000

# classes of characters: a space, other white space, letters (those of contractions by themselves), ...
_BLANK, _SPACE, _LETTER, _STMD, _R, _V, _L, _E, _NUMBER, _QUOTE, _OTHER, _CUT = range(12)
# states: after a cut or a complete piece, in letters, numbers or others, after a quote, after a quote and r, v or l,
# after one blank (a space or not), after several (the last a space or not)
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _QUOTED, _QR, _QV, _QL, _ONE_BLANK, _ONE_OTHER, _MORE_BLANK, _MORE_OTHER = range(12)
_STATES = _CLASSES = 12
# what a transition says: a piece starts here; one starts at the character before
_HERE, _BEFORE = 1, 2


def _split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and says[class, state] for the split pattern of byte-level BPE.

    The pattern: 's 't 're 've 'm 'll 'd, then runs of letters, numbers or others with at most
    one space before, then blanks not followed by a non-blank, then blanks.
    """
    after = np.zeros((_CLASSES, _STATES), np.uint8)
    says = np.zeros((_CLASSES, _STATES), np.uint8)
    fresh = {_BLANK: _ONE_BLANK, _SPACE: _ONE_OTHER, _NUMBER: _IN_NUMBERS, _QUOTE: _QUOTED, _OTHER: _IN_OTHERS, _CUT: _START}
    letters = (_LETTER, _STMD, _R, _V, _L, _E)
    fresh |= dict.fromkeys(letters, _IN_LETTERS)
    in_run = {c: _IN_LETTERS for c in letters} | {_NUMBER: _IN_NUMBERS, _QUOTE: _IN_OTHERS, _OTHER: _IN_OTHERS}
    for c in range(_CLASSES):
        for q in range(_STATES):
            to, say = fresh[c], 0 if c == _CUT else _HERE
            if c == _CUT:
                say = _BEFORE if q in (_QR, _QV, _QL) else 0
            elif q in (_IN_LETTERS, _IN_NUMBERS) and in_run.get(c) == q:
                to, say = q, 0
            elif q == _IN_OTHERS and in_run.get(c) == q:
                to, say = q, 0
            elif q == _QUOTED:
                if c == _STMD:
                    to, say = _START, 0
                elif c in (_R, _V, _L):
                    to, say = {_R: _QR, _V: _QV, _L: _QL}[c], 0
                elif c in (_QUOTE, _OTHER):
                    to, say = _IN_OTHERS, 0
            elif q in (_QR, _QV, _QL):
                if c == (_L if q == _QL else _E):
                    to, say = _START, 0
                elif c in letters:
                    to, say = _IN_LETTERS, _BEFORE
                else:
                    say |= _BEFORE
            elif q in (_ONE_BLANK, _ONE_OTHER, _MORE_BLANK, _MORE_OTHER):
                if c in (_BLANK, _SPACE):
                    to, say = {_BLANK: _MORE_BLANK, _SPACE: _MORE_OTHER}[c], 0
                elif q == _ONE_BLANK:
                    to, say = in_run[c], 0
                elif q == _MORE_BLANK:
                    to, say = in_run[c], _BEFORE
                elif q == _MORE_OTHER:
                    say = _HERE | _BEFORE
            after[c, q], says[c, q] = to, say
    return after, says


_AFTER, _SAYS = _split_transducer()


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    place = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[place(m.start()) : place(m.end() - 1) + 1] = kind
    table[ord(" ")], table[ord("'")] = _BLANK, _QUOTE
    for kind, chars in ((_STMD, "stmd"), (_R, "r"), (_V, "v"), (_L, "l"), (_E, "e")):
        table[[ord(c) for c in chars]] = kind
    return table


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """True at the characters at which a piece starts; classes begins with a cut."""
    n = len(classes)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, _CUT, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    base = steps.astype(np.intp) * _STATES
    flat, said = _AFTER.ravel(), _SAYS.ravel()
    # what each chunk does from every state
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for j in range(CHUNK):
        maps = flat[base[j][:, None] + maps]
    # prefix scan: after the step with shift 2**k a map covers 2**(k+1) chunks
    shift = 1
    while shift < rows:
        maps = np.concatenate((maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)))
        shift *= 2
    state = np.concatenate(([np.uint8(_START)], maps[:-1, _START])).astype(np.intp)
    out = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = base[j] + state
        out[j] = said[at]
        state = flat[at].astype(np.intp)
    says = out.T.ravel()
    starts = (says & _HERE) > 0
    starts[:-1] |= (says[1:] & _BEFORE) > 0
    return starts[:n]


class Transducer:
    """Counts the tokens of a piece byte by byte."""

    def __init__(self, pairs: dict[tuple[bytes, bytes], int]):
        self.pairs = pairs
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]:
            at = 0
            for b in t:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                at = nxt
            self.token[at] = t
        self.made = {a + b: (a, b, rank) for (a, b), rank in pairs.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        #: a state is a tuple of (place in the tree, last token before, count there less the count now)
        self.states: list[tuple] = [((0, b"", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token that stand at its left (0) or right (1) end in turn, each with the rank that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            known, part, ends = [], token, 1 << 30
            while True:
                known.append((part, ends))
                if len(part) == 1:
                    break
                left, right, ends = self.made[part]
                part = (left, right)[side]
            self.spines[side][token] = known
        return known

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether no merge across the border of two tokens comes before both are complete.

        Of equal pairs the left one is merged first, so a pair that ends the right part of a at the same rank wins.
        """
        if not a:
            return True
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) >= MOST_PIECES:
                self.follows.clear()
            rank = self.pairs.get
            known = self.follows[a, b] = not any(
                (r := rank((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self._spine(a, 1) for y, y_ends in self._spine(b, 0)
            )
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        entries, found = [], None
        for node, last, count in self.states[state]:
            node = self.children[node].get(byte)
            if node is None:
                continue
            entries.append((node, last, count))
            token = self.token[node]
            if found is None and token is not None and self._may_follow(last, token):
                found = (token, count + 1)
        token, change = found
        entries = (*((node, last, count - change) for node, last, count in entries), (0, token, 0))
        to = self.number.get(entries)
        if to is None:
            to = self.number[entries] = len(self.states)
            self.states.append(entries)
        move = self.moves[state << 8 | byte] = (to, change)
        return move

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._clear()
        state = total = 0
        moves = self.moves
        for b in piece:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state, change = move
            total += change
        return total


class Counter:
    """The tokenizer of a JSON file, compiled."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE with its split pattern, without a normalizer, is compiled")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer = Transducer({(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)})
        if any(t[flag] for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized") if t.get(flag)):
            raise ValueError("added tokens that strip, match single words only or are normalized are not compiled")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.find = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.classes = _class_table()
        self.pieces: dict[bytes, int] = {}

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block of UTF-8 texts."""
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        if not len(data):
            return out
        raw = data.tobytes()
        chars = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes
        text = raw.decode("utf-8")
        classes = np.empty(len(chars) + n, np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # a cut stands before each text, so a character has its text's number and one as its shift
        of = np.searchsorted(offsets, chars, side="right") - 1
        # empty texts share their offset with the next one, which is the one that has the character
        place = np.arange(len(chars)) + of + 1
        classes[:] = _CUT
        classes[place] = self.classes[points]
        begin_bytes = np.zeros(len(classes), np.int64)
        begin_bytes[place] = chars
        cuts: list[int] = []  # where special strings begin
        if self.find is not None and any(s in text for s in self.special):
            firsts = np.searchsorted(chars, offsets)
            for i in range(n):
                for m in self.find.finditer(text[firsts[i] : firsts[i + 1]]):
                    a, b = firsts[i] + m.start(), firsts[i] + m.end()
                    out[i] += 1
                    classes[place[a] : place[b - 1] + 1] = _CUT
                    cuts.append(int(chars[a]))
        start = np.flatnonzero(piece_starts(classes))
        if not len(start):
            return out
        begin = begin_bytes[start]
        # a piece ends where the next one, the next text or a special string begins
        text_of = np.searchsorted(offsets, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(raw)), offsets[text_of + 1])
        if cuts:
            stops = np.array([*cuts, len(raw)], np.int64)
            end = np.minimum(end, stops[np.searchsorted(stops, begin, side="right")])
        keys = span_hashes(data, begin, end)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sizes = np.empty(len(first), np.int64)
        pieces, count = self.pieces, self.transducer.count
        if len(pieces) > MOST_PIECES:
            pieces.clear()
        for k, (a, b) in enumerate(zip(begin[first].tolist(), end[first].tolist(), strict=True)):
            piece = raw[a:b]
            found = pieces.get(piece)
            if found is None:
                found = count(piece)
                if b - a <= 64:
                    pieces[piece] = found
            sizes[k] = found
        each = sizes[inverse]
        for k in np.flatnonzero(~same_spans(data, begin, end, begin[first][inverse], end[first][inverse])).tolist():  # equal hashes of different pieces
            each[k] = count(raw[begin[k] : end[k]])
        np.add.at(out, text_of, each)
        return out


_compiled: dict[str, Counter] = {}


def compiled(data: bytes) -> Counter:
    """The compiled tokenizer; a worker process compiles each file once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _compiled:
        _compiled[key] = Counter(data)
    return _compiled[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; tokenizer: the path of its JSON file, which the driver reads."""
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(spec.value)
        for batch in batches:
            for a, e, data, offsets in blocks(batch, "text"):
                arrays = [batch.column(0).slice(a, e - a), pa.array(np.diff(offsets)), pa.array(counter.counts(data, offsets))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
