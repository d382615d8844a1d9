"""Packing: pieces against the library's ids, and what a packing has to hold."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldstone.llm import packing
from test_operators import DOC, odd, odd_rows, rows, same, table  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def library():
    return Tokenizer.from_file(WORDS)


def test_ids():
    """Chunk by chunk as the library has the whole text."""
    with open(WORDS, "rb") as f:
        encode = packing.Encoder(f.read()).encode
    texts = [t or "" for _, t, *_ in odd_rows()] + [
        "It's DON'T we'll 'tis o'clock --'s ''s 's's 12345 a1b2 x²½Ⅷ", "ΣΟΦΟΣ ΌΣΟΣ. İstanbul straße ẞ ﬁne Å é e ́ ́x", "a b c　d​e \x1c\x1f \x85 x\ty\nz",
        "<|endoftext|> x<|startoftext|>y<|ENDOFTEXT|> <| endoftext|>", "   lead  and trail   ", "漢字かな カナ 한국어 ไทย עברית 🙂🙃 👩‍👩‍👧", "A" * 5000, "é" * 3000, "!?" * 2000, "…—–«»“”", "\x00\x01\x7f", "ſ K Å DŽ ǅ", "plain 漢 words é漢é,é İi İ ÀÖ×Øö÷øÿ ĀſŸ «x» ¿q? “z”… ‑ ǿ ª º µ ² ³ ¼", "<|endoftext|>", "a\u2028b\u00a0c\u00add",
    ]
    tokenizer = library()
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


def test_segments(monkeypatch):
    monkeypatch.setattr(packing, "_SEGMENT", 7)
    monkeypatch.setattr(packing, "MOST_WORDS", 2)
    with open(WORDS, "rb") as f:
        encode = packing.Encoder(f.read()).encode
    for text in ("some words  of a text that is cut   here", " " * 30, "x" * 40 + " y", "y " + "x" * 40):
        assert np.frombuffer(encode(text), "<u4").tolist() == library().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [256, 4096])
def test_cuts(capacity):
    for length in range(capacity):
        pieces = packing.cuts(length, capacity)
        assert sum(pieces) == length and all(p > 0 for p in pieces) and len(pieces) <= 5
        for p in pieces:
            k = capacity // p
            assert capacity - k * p <= max(capacity // 256, k - 1) or p <= capacity // 64


def held(df, plain, capacity):
    """Checks a packing; how much of it is padding."""
    tokenizer, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for doc, start, length, ids, total, sequence, offset in rows(df, "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"):
        assert len(ids) == 4 * length > 0
        by_doc[doc].append((start, length, bytes(ids), total))
        by_sequence[sequence].append((offset, length))
    want = defaultdict(list)
    for doc, text in plain:
        want[doc].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        if len(want[doc]) == 1:
            pieces.sort()
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
            assert b"".join(p[2] for p in pieces) == want[doc][0] and {p[3] for p in pieces} == {len(want[doc][0]) // 4}
        else:
            assert sum(p[1] for p in pieces) == sum(map(len, want[doc])) // 4
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))]
        size = sum(p[1] for p in pieces)
        assert size <= capacity
        total += size
        padding += capacity - size if size & size - 1 else 0
    return padding / total


@pytest.mark.parametrize("capacity", [256, 4096])
def test_packing(odd, table, capacity):  # noqa: F811
    for df, plain in (odd, table):
        assert held(packing.pack(df, WORDS, 2, capacity), plain, capacity) < 0.02


def test_query(table):  # noqa: F811
    df, _ = table
    pieces = packing.pack(df, WORDS, 2)
    got = packing.digest(pieces)
    assert tuple(got.columns) == COLUMNS
    ids = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in pieces.collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in got.collect()} == ids


def test_few_rows(spark):
    assert packing.pack(spark.createDataFrame([], DOC), WORDS, 2).count() == 0
    odd_df = spark.createDataFrame([(None, None)], "doc_id string, text string").withColumn("ids", F.lit(1))
    got = packing.digest(packing.pack(odd_df, WORDS, 2)).drop("sequence_id")
    assert [tuple(r) for r in got.collect()] == [(None, 0, 1, zlib.crc32(b"\2\0\0\0"), 1, 0)]
