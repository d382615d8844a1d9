"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a character other than white space is good or bad; its features are measures of the line
itself and of its neighbours.  Forward-backward marginals of the lines, weighted
by their lengths, are summed up to the document's share of good text; a
logistic curve over that share turns it into a score.

Only whole documents are labelled.  Fitting is on the driver over a bounded
sample of labelled rows (`SAMPLE` rows and `SAMPLE_BYTES` of text in all, chosen by a hash whatever their length): lines of good
documents are good; the lines of bad documents start as bad and are labelled
again by the field itself (never all as good) in each of `ROUNDS` rounds.
A document whose crc32(doc_id as text) mod 5 is 0 is never learned from, and labels,
lang, source and doc_id are never inputs of a score.

Scoring runs in Arrow tasks over whole texts; a task holds one block of texts at a time.

Defined results: a null or empty text has no lines and gets the score of the curve at no
good share; a null doc_id is scored, is not held out, and is not learned from; repeated
rows are learned from once and scored each on its own; an empty table gives an empty table; without labels
of both kinds every score is 0.5; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLANK_WORDS, Block, blocks

#: Labelled documents, and bytes of their texts together, that the field is fitted on, at most (in expectation).
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
ROUNDS, STEPS = 4, 60
THRESHOLD, FOLDS = 0.3, 5
OWN = ("symbols", "upper", "bars", "marks", "digits", "repeats", "seen", "short", "long_words", "closed", "few")
N_FEATURES = 3 * len(OWN) + 1


@dataclass(frozen=True)
class Lines:
    """Features of the lines of a block: rows of features, weights, and first[i]:first[i+1] for text i."""

    features: np.ndarray
    weights: np.ndarray
    first: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[ends] - total[starts]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _BARS, _MARKS = _table(b"#*$%&<>^~\\{}"), _table(b"|"), _table(b"!?")
_DIGITS, _UPPER, _LETTERS = _table(b"0123456789"), _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_CLOSING = _table(b".!?:;\"')")


def line_features(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Of a block of UTF-8 texts; lines are the parts between line feeds that hold a word."""
    n = len(offsets) - 1
    block = Block(data, offsets, BLANK_WORDS)
    starts, ends = block.starts, block.ends
    if not len(starts):
        return Lines(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(n + 1, np.int64))
    feeds = np.concatenate(([0], np.cumsum(data == 10)))[starts]
    texts = block.texts()
    new = np.append(True, (feeds[1:] != feeds[:-1]) | (texts[1:] != texts[:-1]))
    word_a = np.flatnonzero(new)  # first word of each line
    word_b = np.append(word_a[1:], len(starts))
    a, b = starts[word_a], ends[word_b - 1]
    n_words, n_bytes = (word_b - word_a).astype(float), (b - a).astype(float)
    hashes = block.hashes()
    twin = np.append(False, (hashes[1:] == hashes[:-1]) & ~new[1:])
    again = np.zeros(len(hashes), bool)  # windows of 6 words that the text has had before
    if len(hashes) > 6:
        keys = hashes[:-5].copy()
        for i in range(1, 6):
            keys = keys * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - 5 + i]
        room = block.room(6)[: len(keys)]
        order = np.lexsort((np.arange(len(keys)), keys, texts[: len(keys)]))
        same = (keys[order][1:] == keys[order][:-1]) & (texts[order][1:] == texts[order][:-1]) & room[order][1:]
        again[order[1:][same]] = True
    rate = lambda table: _sums(table[data], a, b) / n_bytes
    letters = np.maximum(_sums(_LETTERS[data], a, b), 1)
    own = np.stack(
        [
            np.minimum(_sums(_SYMBOLS[data], a, b) / n_words, 3),
            _sums(_UPPER[data], a, b) / letters,
            np.minimum(_sums(_BARS[data], a, b) / n_words, 1) * 2,
            np.minimum(_sums(_MARKS[data], a, b) / n_words, 2),
            rate(_DIGITS) * 4,
            _sums(twin, word_a, word_b) / n_words * 2,
            _sums(again, word_a, word_b) / n_words * 2,
            (n_bytes < 40).astype(float),
            np.minimum(n_bytes / n_words / 8, 3),
            _CLOSING[data[b - 1]].astype(float),
            (n_words < 4).astype(float),
        ],
        axis=1,
    )
    of = texts[word_a]
    first = np.searchsorted(of, np.arange(n + 1))
    zero = np.zeros((1, own.shape[1]))
    before = np.concatenate((zero, own[:-1]))
    before[first[:-1][first[:-1] < len(own)]] = 0
    after = np.concatenate((own[1:], zero))
    after[np.maximum(first[1:] - 1, 0)[first[1:] > first[:-1]]] = 0
    return Lines(np.concatenate((own, before, after, np.ones((len(own), 1))), axis=1), n_bytes, first)


@dataclass(frozen=True)
class Field:
    """Emission weights for good against bad, transition scores, and the curve from share to score."""

    emission: np.ndarray
    transition: np.ndarray
    curve: np.ndarray


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of good for each line, and of each pair of neighbouring labels summed over all chains.

    All chains go forward and backward together, a place in the chain at a time, as long as any goes on.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    lens = n_lines[order]
    at = first[:-1][order]
    emit = np.stack((np.zeros_like(scores), scores), axis=1)
    fore, back = np.zeros_like(emit), np.zeros_like(emit)
    longest = int(lens[0]) if len(lens) else 0
    live = [int(np.searchsorted(-lens, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(longest):
        rows = at[: live[t]] + t
        here = emit[rows]
        if t:
            past = fore[rows - 1]
            here = here + np.logaddexp(past[:, :1] + transition[0], past[:, 1:] + transition[1])
        fore[rows] = here
    for t in range(longest - 2, -1, -1):
        rows = at[: live[t + 1]] + t
        ahead = back[rows + 1] + emit[rows + 1]
        back[rows] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
    both = fore + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(scores), bool)
    ends = first[1:][n_lines > 0] - 1
    inner[ends] = False
    rows = np.flatnonzero(inner)
    pair = fore[rows][:, :, None] + transition[None] + (emit + back)[rows + 1][:, None, :] - total[rows][:, None, None]
    return good, np.exp(pair).sum(axis=0)


def _document(good: np.ndarray, lines: Lines) -> np.ndarray:
    """What the curve reads of each document: 1, its share of good text, the logit of that share, and no text at all."""
    n = len(lines.first) - 1
    weight = _sums(lines.weights, lines.first[:-1], lines.first[1:])
    share = _sums(lines.weights * good, lines.first[:-1], lines.first[1:]) / np.maximum(weight, 1)
    bound = np.clip(share, 0.01, 0.99)
    return np.stack((np.ones(n), share, np.log(bound / (1 - bound)), 1 / (1 + weight / 50)), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(start: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(lines: Lines, quality: np.ndarray) -> Field:
    """The field and the curve from documents labelled 0 or 1."""
    n_lines = np.diff(lines.first)
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    labels = quality[doc].astype(float)
    inner = np.flatnonzero(np.append(doc[1:] == doc[:-1], False)) if len(doc) else np.zeros(0, np.int64)
    params = np.zeros(N_FEATURES + 4)
    size = max(1, len(doc))
    for _ in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[inner].astype(int), labels[inner + 1].astype(int)), 1)

        def gradient(p: np.ndarray, labels=labels, seen=seen) -> np.ndarray:
            good, pairs = marginals(lines.features @ p[:N_FEATURES], lines.first, p[N_FEATURES:].reshape(2, 2))
            return np.concatenate(((good - labels) @ lines.features, (pairs - seen).ravel())) / size + 1e-3 * p

        params = _adam(params, gradient, STEPS, 0.15)
        good, _ = marginals(lines.features @ params[:N_FEATURES], lines.first, params[N_FEATURES:].reshape(2, 2))
        # in bad documents only lines that look clearly good become good, and never the worst one
        least = np.full(len(n_lines), np.inf)
        np.minimum.at(least, doc, good)
        labels = np.where(quality[doc] == 1, 1.0, ((good > 0.8) & (good > least[doc])).astype(float))
    reads = _document(good, lines)
    curve = _adam(np.zeros(reads.shape[1]), lambda c: (_sigmoid(reads @ c) - quality) @ reads / len(quality) + 1e-4 * c, 500, 0.1)
    return Field(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2), curve)


def score(field: Field, lines: Lines) -> np.ndarray:
    good, _ = marginals(lines.features @ field.emission, lines.first, field.transition)
    return _sigmoid(_document(good, lines) @ field.curve)


def is_held_out():
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(~is_held_out()).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    none = Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(4))
    if len(counts) < 2:
        return none
    # both kinds by the same share, so that scores keep the frequency of labels
    share = min(1.0, sample / sum(counts.values()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    # the labels picked are bounded, so they may be broadcast; a doc_id may have any number of texts and these may be long, so both are bounded again
    chosen = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").distinct()
    n, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, sample * 2 / max(n, 1), SAMPLE_BYTES / max(size, 1))
    if share < 1:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", "quality", "text", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = chosen.select("doc_id", "quality", "text").orderBy("doc_id", "quality", "text").toArrow()
    quality = rows.column("quality").to_numpy().astype(np.int64)
    if len(set(quality.tolist())) < 2:
        return none
    parts = []
    for batch in rows.to_batches():
        for _, _, data, offsets in blocks(batch, "text"):
            parts.append(line_features(data, offsets))
    first = np.concatenate([[0], *[np.diff(p.first) for p in parts]]).cumsum()
    return fit(Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.weights for p in parts]), first), quality)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    field = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, data, offsets in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, e - a), pa.array(score(field, line_features(data, offsets)))], names=["doc_id", "score"]
                )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
