"""Vectorized word spans and hashes over Arrow string columns.

Every operator that needs the words of whole texts inside a Python task works on
the UTF-8 bytes of a block of documents at once: a 256-entry table says which
bytes belong to words, so all separators must be ASCII.  Words of up to 16 bytes are
hashed as one or two numbers by a bit mixer, longer ones by XXH3; n-grams mix the
hashes of their words.  Hashes choose what is compared: `same_spans` compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at a time inside a task.
BLOCK_BYTES = 2 << 20

_LENGTH, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes of words, False for the given separator bytes."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words are runs of anything but space, tab, LF, VT, FF and CR.
BLANK_WORDS = byte_table(b" \t\n\x0b\x0c\r")
#: Words are runs of a-z, 0-9 and non-ASCII characters (after lower-casing A-Z).
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer; the argument is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks for the first 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _numbers(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each of some spans; different for different spans of the same length of up to 8 bytes."""
    sizes = ends - starts
    at = _numbers(data)
    out = mix((at[starts] & _MASKS[np.minimum(sizes, 8)]) ^ sizes.astype(np.uint64) * _LENGTH ^ np.uint64(seed))
    two = np.flatnonzero((sizes > 8) & (sizes <= 16))
    second = mix((at[starts[two] + 8] & _MASKS[sizes[two] - 8]) + _SECOND)
    out[two] = mix((out[two] ^ second) * _SECOND + second)
    long = np.flatnonzero(sizes > 16)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digest = xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """True where a span has the bytes of its other span."""
    at, sizes = _numbers(data), ends - starts
    same = sizes == other_ends - others
    for k in range(0, 64, 8):
        live = np.flatnonzero(same & (sizes > k))
        if not len(live):
            return same
        mask = _MASKS[np.minimum(sizes[live] - k, 8)]
        same[live] = (at[starts[live] + k] ^ at[others[live] + k]) & mask == 0
    for i in np.flatnonzero(same & (sizes > 64)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[others[i] : other_ends[i]])
    return same


class Block:
    """The words of a block of texts: starts, ends, and first[i]:first[i+1] for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = table[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside
        ends = np.append(ends[:-1] & ~ends[1:], ends[-1:])
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = table[self.data[cut]]
        ends[cut - 1] = table[self.data[cut - 1]]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        return span_hashes(self.data, self.starts, self.ends, seed)

    def texts(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self, k: int) -> np.ndarray:
        """True for words at which k consecutive words of one text start."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.starts)) + k <= last


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; entries that cross texts are to be masked by room()."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : i + n]
    return mix(out)


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a record batch of about BLOCK_BYTES: first row, end row, UTF-8 bytes, offsets.

    Null texts count as empty.  A text longer than the block size is a block of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, offset_buffer, data_buffer = col.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
