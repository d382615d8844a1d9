"""Repair of the structure of conversations, by A* on the edit lattice.

Rows of a conversation are put in order by turn (nulls first), then role, the first
`HEAD` characters of the text and its SHA-256.  A row is blank, a duplicate (its role and text
came before) or truncated (its last character that is not blank is none of `.!?`); the first that
fits counts.  The cheapest edits give the roles the form `(s?(ua)+)?` by their initials: K(eep) 0,
R(erole) 2, D(elete) 3 and I(nsert) 2; blank rows and duplicates have to be deleted and a truncated
row that stays costs 1.  Of several cheapest, the least by ASCII.

A node of the lattice is (rows read, state): nothing yet, after s, after u, after a.
The search takes nodes by (cost + heuristic, audit).  The heuristic sums, over the rows
not yet read, 3 for each that has to be deleted and 1 for each truncated one; it never
exceeds the cost and falls by no more than a step costs, so the first path that
reaches a node is its cheapest and, of those, the least.

Rows are searched in segments of `SEGMENT` rows, from each state they can be entered
in; best paths of segments are joined in order.  So a task holds one segment, and
rows of one conversation may lie in several tasks: light rows (no texts) are dealt by
range, each task gives one row a conversation it has part of, and only these rows meet.
In the end texts stream by conversation past their decision, as the
result has one hash (and one audit, as long as the conversation) for each; nothing but the audit is held.

Defined results: a null role or text is one space; a null turn comes first; a null conv_id
is a conversation; rows that are alike in everything count each; a conversation of which no row is left
has zeros, an empty audit and no repaired row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import BLANK_CHARS

#: Rows that are searched at a time.
SEGMENT = 512
#: Characters of a text that order rows of the same turn and role.
HEAD = 32
#: Repaired rows handed on at a time, and their bytes.
_BATCH, _BATCH_BYTES = 5_000, 4 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OK, CUT, GONE = 0, 1, 2
#: States: nothing yet, after s, after u, after a.  What a kept initial leads to, and an inserted or changed role.
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Rows to insert at the end of a conversation.
_MISSING = (0, 2, 1, 0)
_LEGAL = {"su", "ua", "au"}


def search(rows: list[tuple[str, int]], entry: int) -> dict[int, tuple[int, str]]:
    """For each state that rows (initial, fault) can be left in: the least cost and its least audit."""
    left = [0]
    for _, fault in reversed(rows):
        left.append(left[-1] + (DELETE if fault == GONE else TRUNCATED if fault == CUT else 0))
    left.reverse()
    heap, closed, found = [(left[0], "", 0, entry)], set(), {}
    while heap:
        estimate, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows):
            found[state] = (estimate, audit)
            continue
        initial, fault = rows[i]
        cost = estimate - left[i]
        steps = [("D", DELETE, i + 1, state), ("I", INSERT, i, _NEXT[state])]
        if fault != GONE:
            kept = _KEPT.get((state, initial))
            if kept is not None:
                steps.append(("K", KEEP + fault * TRUNCATED, i + 1, kept))
            if kept != _NEXT[state]:
                steps.append(("R", REROLE + fault * TRUNCATED, i + 1, _NEXT[state]))
        for edit, price, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(heap, (cost + price + left[j], audit + edit, j, to))
    return found


Paths = dict[tuple[int, int], tuple[int, str]]


def joined(first: Paths, then: Paths) -> Paths:
    """Best paths (entered, left) -> (cost, audit) through two stretches of rows, one after the other."""
    out: Paths = {}
    for (a, b), (cost, audit) in first.items():
        for (c, d), (more, rest) in then.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = (cost + more, audit + rest)
    return out


def finished(paths: Paths) -> tuple[int, str]:
    """The best whole path."""
    return min((cost + INSERT * _MISSING[b], audit + "I" * _MISSING[b]) for (a, b), (cost, audit) in paths.items() if a == 0)


class Part:
    """Consecutive rows of one conversation: counts of faults, what its ends look like, and its best paths."""

    def __init__(self, entries: tuple[int, ...]):
        self.entries = entries
        self.paths: Paths = {(e, e): (0, "") for e in entries}
        self.rows: list[tuple[str, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.rows.append((initial, {"": OK, "truncated": CUT}.get(fault, GONE)))
        if len(self.rows) == SEGMENT:
            self.close()

    def close(self) -> None:
        """Search the rows that are held."""
        if self.rows:
            reached = sorted({b for _, b in self.paths})
            self.paths = joined(self.paths, {(e, x): path for e in reached for x, path in search(self.rows, e).items()})
            self.rows = []

    def values(self) -> tuple:
        self.close()
        paths = [{"entered": a, "left": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in self.paths.items()]
        return self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.least, self.most, self.first, self.last, paths


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, least long, most long"
_PATHS = "array<struct<entered:int,left:int,cost:bigint,audit:string>>"
_PART = f"conv_id {{conv}}, part long, {_COUNTS}, first string, last string, paths {_PATHS}"
_LONGS = 7
_ARROW_PATHS = pa.list_(pa.struct([("entered", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summary(parts: list[tuple]) -> dict:
    """The counts, cost and audit of a conversation from the values of its parts, in order."""
    total, paths, last, least, most, turns = [0] * 4, {(0, 0): (0, "")}, None, None, None, 0
    for *counts, part_turns, part_least, part_most, part_first, part_last, part_paths in parts:
        total = [a + b for a, b in zip(total, counts, strict=True)]
        if part_first is not None:
            total[3] += last is not None and last + part_first not in _LEGAL
            last = part_last
        if part_least is not None:
            turns += part_turns - (part_least == most)
            least = part_least if least is None else least
            most = part_most
        paths = joined(paths, {(p["entered"], p["left"]): (p["cost"], p["audit"]) for p in part_paths})
    cost, audit = finished(paths)
    gaps = 0 if least is None else most - least + 1 - turns
    return dict(zip(_SUMMARY, (gaps, *total, cost), strict=True)) | {"audit": audit}


def _rows(conversations: DataFrame, times: str | None) -> DataFrame:
    """conv_id, turn, role, text, times, and what orders rows."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    plain = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.lit(1) if times is None else F.col(times)).cast("long").alias("times"),
    )
    return plain.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.sha2("text", 256))})


_ORDER = ("conv_id", "turn", "role", "head", "digest")


def parts(rows: DataFrame) -> DataFrame:
    """A row for each conversation and task that has rows of it: conv_id, part (ascending in the conversation's order) and the values of a Part."""
    bare = F.rtrim("text", F.lit(BLANK_CHARS))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    light = rows.groupBy(*_ORDER, fault.alias("fault")).agg(F.sum("times").alias("times"))
    least = light.filter("times > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    seen = least.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = light.join(seen, same, "left").select(
        *_ORDER, F.substring("role", 1, 1).alias("initial"), "fault", "times", F.col("turn").eqNullSafe(F.col("least.turn")).alias("is_first")
    )
    ordered = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv_id", "turn", "initial", "fault", "times", "is_first")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, part, conv, entries, out, held, conv_kind = TaskContext.get().partitionId(), None, None, (0, 1, 2, 3), [], 0, None

        def made() -> pa.RecordBatch:
            kinds = [conv_kind, pa.int64(), *[pa.int64()] * _LONGS, pa.string(), pa.string(), _ARROW_PATHS]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            conv_kind = batch.column(0).type
            for c, turn, initial, fault, times, is_first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part is None or c != conv:
                    if part is not None:
                        out.append((conv, part_id, *part.values()))
                        held += sum(len(p["audit"]) for p in out[-1][-1])
                        entries = (0,)  # it begins in this task
                    part, conv = Part(entries), c
                for k in range(times):
                    part.add(turn, initial, fault if fault == "blank" or is_first and not k else "duplicate")
            if len(out) > _BATCH or held > _BATCH_BYTES:
                yield made()
                out, held = [], 0
        if part is not None:
            out.append((conv, part_id, *part.values()))
        if out:
            yield made()

    schema = _PART.format(conv=kind)
    names = ["conv_id", "part", *(x.split()[0] for x in _COUNTS.split(", ")), "first", "last", "paths"]
    return ordered.mapInArrow(work, schema)


def repaired(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """The rows of repaired conversations, in order: conv_id, place (from 0), turn, role, text, edit (K, R or I).

    A last row of each conversation has place null and its summary: gaps, blank, duplicate, truncated,
    illegal, cost (null in other rows) and the audit.  times: a column with how often a row stands (0: not at all, but its
    conversation is there).  All rows of a conversation stand in one partition, one after the other.
    """
    rows = _rows(conversations, times)
    found = parts(rows)
    none = [c for c in found.columns if c != "conv_id"]
    texts = rows.filter("times > 0").select(*_ORDER, "text", "times")
    stream = found.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("part").isNull(), "part", "turn", "role", "head", "digest"
    )
    stream = stream.select("conv_id", *none, "turn", "role", "text", "times")
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _SUMMARY)
    schema = f"conv_id {kind}, place long, turn long, role string, text string, edit string, {numbers}, audit string"
    names = ["conv_id", "place", "turn", "role", "text", "edit", *_SUMMARY, "audit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, conv_kind = [], 0, None
        longs = [pa.int64()] * len(_SUMMARY)

        def made() -> pa.RecordBatch:
            kinds = [conv_kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *longs, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def records() -> Iterator[tuple]:
            nonlocal conv_kind
            for batch in batches:
                conv_kind = batch.column(0).type
                yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)

        for row in _walk(records()):
            out.append(row)
            held += len(row[4] or "")
            if len(out) > _BATCH or held > _BATCH_BYTES:
                yield made()
                out, held = [], 0
        if out:
            yield made()

    return stream.mapInArrow(work, schema)


def _walk(records: Iterator[tuple]) -> Iterator[tuple]:
    """Edits applied to sorted records: for each conversation the values of its parts, then its rows."""
    blank = (None,) * (len(_SUMMARY) + 1)
    conv, held, result, audit, at, state, place, begun = None, [], None, "", 0, 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            yield (conv, place, None, _ROLE[state], "", "I", *blank)
            at, place = at + 1, place + 1

    def ended() -> Iterator[tuple]:
        nonlocal result, audit
        if begun:
            if result is None:
                result = summary(held)
                audit = result["audit"]
            yield from inserted()
            yield (conv, None, None, None, None, None, *(result[c] for c in _SUMMARY), audit)

    for c, part, *values, turn, role, text, times in records:
        if not begun or c != conv:
            yield from ended()
            conv, held, result, audit, at, state, place, begun = c, [], None, "", 0, 0, 0, True
        if part is not None:
            held.append(tuple(values))
            continue
        if result is None:
            result, held = summary(held), []
            audit = result["audit"]
        for _ in range(times):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = _KEPT[state, role[:1]] if edit == "K" else _NEXT[state]
            yield (conv, place, turn, role if edit == "K" else _ROLE[state], text, edit, *blank)
            place += 1
    yield from ended()


def digest(rows: DataFrame) -> DataFrame:
    """A row a conversation, from the rows of repaired(): its summary and the hash of its `role:text` lines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in _SUMMARY)}, audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for batch in batches:
            places, roles, texts = (batch.column(i) for i in (1, 3, 4))
            ends, hashes = [], []
            for i, (place, role, text) in enumerate(zip(*(x.to_pylist() for x in (places, roles, texts)), strict=True)):
                if place is None:
                    ends.append(i)
                    hashes.append(state.hexdigest())
                    state = hashlib.sha256()
                else:
                    state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            last = batch.take(pa.array(ends, pa.int64()))
            columns = [last.column(0), *last.columns[6:], pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_SUMMARY, "audit", "repaired_sha256"])

    return rows.mapInArrow(work, schema)
