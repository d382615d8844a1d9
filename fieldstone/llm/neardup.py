"""Near-duplicate groups by b-bit MinHash with full confirmation.

A document's set is its distinct 4-word shingles (64-bit hashes).  128 minima
give 32 bands of 4; documents with an equal band are candidates.  The low 4
bits of each (mixed) minimum are packed into a signature of 64 bytes: the
collision-corrected similarity estimated from the number of equal nibbles drops
candidates that are far below the threshold, and the others are confirmed on
their full sets.

Links serve to find components, so no step writes a row for each pair:

1. Equal sets are one member (`heads`), so copies are never paired.
2. `_partners` compares the signatures of a band's members, a block at a time, and
   writes a row for each member: the block's most central member if that may be linked.
3. Each member is confirmed against the most similar of these hubs; the links are
   joined to components.
4. In bands that still hold members of several components, the members outside
   the band's largest component are tested against all others on full sets, inside the task,
   which writes only links that join two components.  A round takes as many blocks of such
   members as have no more rows than the first block of all bands, so a round's rows grow with
   the members, whatever their number; its links rename only the components that they join.
5. Sets of more than 1 / HOT of all rows are fewer than HOT, so their members are named by a
   broadcast; the others are joined by set.

At the threshold of 0.8 a pair shares no band with probability
(1 - 0.8**4)**32 < 1e-7, and is dropped by its estimate (6 deviations off)
with less; the README has measured figures.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; a row with a null doc_id is kept and linked with nothing; rows
with the same doc_id count as one document, with the links of each of its texts; an
empty table gives an empty table; only doc_id and text are read by `groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables
from .words import BLANK_WORDS, Block, blocks, grams, mix

SHINGLE, PERCENT = 4, 80
HASHES, BANDS, BITS = 128, 32, 4
#: Estimates below this are not confirmed.
LEAST_ESTIMATE = 0.58
#: Members, and shingles, that a task compares with each other at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 20
#: A set of more than one in HOT rows is a hot key.
HOT = 1000

_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SIGNED = "doc_id long, key long, n_shingles long, d1 long, d2 long, packed binary, bands array<long>"


def shingle_sets(block: Block) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = block.hashes()
    full = grams(words, SHINGLE)
    for lo, hi in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(full[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield mix(grams(words[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            yield words[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set, over blocks of it."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(folded), 4096):
        np.minimum(out, (_FACTORS[:, None] * folded[None, i : i + 4096]).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Four bits of each mixed minimum, two to a byte."""
    nibbles = (mix(low.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return nibbles[0::2] | (nibbles[1::2] << np.uint8(4))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of 8 uint64), corrected for chance collisions of 4 bits."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of minima, different for different bands."""
    rows = low.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, e, data, offsets in blocks(batch, "text"):
            block = Block(data, offsets, BLANK_WORDS, lower=True)
            sizes, sums, xors, packed, bands = [], [], [], [], []
            for s in shingle_sets(block):
                sizes.append(len(s))
                sums.append(int(s.sum().astype(np.int64)))
                xors.append(int(np.bitwise_xor.reduce(mix(s.copy())).astype(np.int64)) if len(s) else 0)
                low = minima(s) if len(s) else None
                packed.append(pack(low).tobytes() if len(s) else None)
                bands.append(band_keys(low) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, e - a),
                    batch.column(1).slice(a, e - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(xors, pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n_shingles", "d1", "d2", "packed", "bands"],
            )


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of rows with equal first columns, and where the runs start; batches are sorted by these."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = _starts(held, keys)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _near_in_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, block, n_blocks, hid, n_shingles, packed) by band and block: the members that may be linked there.

    hub is the member of the block with the largest sum of estimates, null for the hub itself and for members that can't be linked with it.
    """
    for table, starts in _whole_runs(batches, 2):
        hid, sizes, signs = table.column("hid").to_numpy(), table.column("n_shingles").to_numpy(), _signatures(table)
        lengths = np.diff(np.append(starts, len(hid)))
        run = np.repeat(np.arange(len(starts)), lengths)
        score = np.zeros(len(hid))
        for shift in range(1, int(lengths.max())):
            i = np.flatnonzero(run[shift:] == run[:-shift])
            i = i[_near_in_size(sizes[i], sizes[i + shift])]
            similar = estimate(signs[i], signs[i + shift])
            similar[similar < LEAST_ESTIMATE] = 0
            score[i] += similar
            score[i + shift] += similar
        top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, starts), lengths))
        hub = top[np.unique(run[top], return_index=True)[1]][run]
        similar = estimate(signs, signs[hub])
        fits = (similar >= LEAST_ESTIMATE) & _near_in_size(sizes, sizes[hub]) & (hub != np.arange(len(hid)))
        stay = (score > 0) | (table.column("n_blocks").to_numpy() > 1)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("band").combine_chunks().filter(pa.array(stay)),
                pa.array(hid[stay]),
                pa.array(sizes[stay]),
                pa.array(hid[hub][stay], mask=~fits[stay]),
                pa.array(similar[stay]),
            ],
            names=["band", "hid", "n_shingles", "hub", "similar"],
        )


def _sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in blocks(pa.record_batch({"text": texts}), "text"):
        yield from shingle_sets(Block(data, offsets, BLANK_WORDS, lower=True))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, block, side, hid, component, twin, n_shingles, packed, text) by unit and block: links (a, b) of members of side 0 with such of side 1.

    Only members of different components are tested, and each link that is returned joins two: fewer links than members.
    Members that are on both sides (twin) are tested once.
    """
    for table, starts in _whole_runs(batches, 2):
        a, b = [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            for x, y in _joining(table.slice(lo, hi - lo)):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joining(unit: pa.Table) -> Iterator[tuple[int, int]]:
    hid, sizes, signs = unit.column("hid").to_numpy(), unit.column("n_shingles").to_numpy(), _signatures(unit)
    twin = unit.column("twin").to_numpy()
    root = np.unique(unit.column("component").to_numpy(), return_inverse=True)[1]
    right = np.flatnonzero(unit.column("side").to_numpy() == 1)
    sets = list(_sets_of(unit.column("text").combine_chunks()))
    known, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    mark = np.zeros(len(known), bool)
    for i in np.flatnonzero(unit.column("side").to_numpy() == 0):
        open_ = right[(root[right] != root[i]) & _near_in_size(sizes[right], sizes[i]) & (~twin[right] | (hid[right] > hid[i]))]
        similar = estimate(signs[open_], signs[i])
        order = np.argsort(-similar, kind="stable")
        open_ = open_[order[: np.count_nonzero(similar >= LEAST_ESTIMATE)]]
        mark[tokens[ends[i] - sizes[i] : ends[i]]] = True
        while len(open_):
            now, open_ = open_[:64], open_[64:]
            both = np.array([np.count_nonzero(mark[tokens[ends[j] - sizes[j] : ends[j]]]) for j in now])
            for j in now[100 * both >= PERCENT * (sizes[i] + sizes[now] - both)]:
                if root[j] != root[i]:
                    yield int(hid[i]), int(hid[j])
                    root[root == root[j]] = root[i]
            open_ = open_[root[open_] != root[i]]
        mark[tokens[ends[i] - sizes[i] : ends[i]]] = False


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(id, component) for the ends of edges (a, b): the least id that each end can reach; written as a table.

    Alternates large-star and small-star steps; each is a constant number of shuffles of at most
    the edges, and each round's edges are written, so the lineage stays short.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    state, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = tables.write(f"edges{k}", small.filter("u > v").distinct())
        if k:
            tables.drop(f"edges{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, k = now, k + 1
    found = tables.write(name, edges.select(F.col("u").alias("id"), F.col("v").alias("component")))
    tables.drop(f"edges{k}")
    return found


def _extended(found: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """found after more links, as a table: steps run over the components that these join, not over all links so far."""
    ends = links
    for end in ("a", "b"):
        of = found.select(F.col("id").alias(end), F.col("component").alias("of"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    moved = components(ends, tables, f"{name}_moved")
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    renamed = found.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = tables.write(name, renamed.unionByName(moved))
    tables.drop(f"{name}_moved")
    return out


def _n_blocks(members: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK_MEMBERS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1).cast("long"))


def _tested(units: DataFrame, held: DataFrame) -> DataFrame:
    """The links in units: rows (unit, block, side, hid, component, twin)."""
    rows = units.join(held, "hid").select("unit", "block", "side", "hid", "component", "twin", "n_shingles", "packed", "text")
    return rows.repartition("unit", "block").sortWithinPartitions("unit", "block").mapInArrow(_links, "a long, b long")


def _stars(near: DataFrame) -> DataFrame:
    """Units in which each member meets the most similar of its hubs; a hub with many members has several blocks."""
    chosen = near.filter("hub IS NOT NULL").groupBy("hid", "n_shingles").agg(F.max_by("hub", F.struct("similar", "hub")).alias("unit"))
    sizes = chosen.groupBy("unit").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("n_blocks", _n_blocks("n", "s"))
    points = chosen.join(sizes, "unit").select("unit", F.pmod(F.xxhash64("hid"), "n_blocks").alias("block"), F.lit(1).alias("side"), "hid")
    hubs = sizes.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("unit").alias("hid"))
    return points.unionByName(hubs).select("*", F.col("hid").alias("component"), F.lit(False).alias("twin"))


def _mixed(near: DataFrame, found: DataFrame) -> DataFrame:
    """The members of bands with several components, and their blocks.

    left: the round of a member outside the band's largest component, else null; right: its block on the other side.
    """
    placed = near.select("band", "hid", "n_shingles").join(found.withColumnRenamed("id", "hid"), "hid", "left").withColumn("component", F.coalesce("component", "hid"))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    bands = (
        parts.groupBy("band")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("main"))
        .filter("parts > 1")
        .select("band", F.col("main.component").alias("main"), "n", "s", (F.col("n") - F.col("main.n")).alias("left_n"), (F.col("s") - F.col("main.s")).alias("left_s"))
        .select("band", "main", _n_blocks("left_n", "left_s").alias("lefts"), _n_blocks("n", "s").alias("rights"))
    )
    return placed.join(bands, "band").select(
        "band",
        "hid",
        "lefts",
        "rights",
        F.when(F.col("component") != F.col("main"), F.pmod(F.xxhash64("hid"), "lefts")).alias("left"),
        F.pmod(F.xxhash64(F.lit(1), "hid"), "rights").alias("right"),
    )


def _ranges(rows: dict[int, float]) -> Iterator[tuple[int, int]]:
    """The left blocks of each round; rows: the rows of a left block in all bands with that many of them."""

    def cost(lo: int, hi: int) -> float:
        return sum(r * max(0, min(hi, n) - lo) for n, r in rows.items())

    lo, most = 0, max(rows, default=0)
    while lo < most:
        hi = lo + 1
        while hi < most and cost(lo, hi + 1) <= cost(0, 1):
            hi += 1
        yield lo, hi
        lo = hi


def _block_rows(mixed: DataFrame) -> dict[int, float]:
    """For each number of left blocks: the rows that one of them brings about in the bands with so many."""
    lefts = F.sum(F.when(F.col("left").isNotNull(), F.col("rights")).otherwise(0)) / F.col("lefts")
    return {r["lefts"]: r["n"] for r in mixed.groupBy("lefts").agg((lefts + F.count("*")).alias("n")).collect()}


def _round(mixed: DataFrame, found: DataFrame, lo: int, hi: int) -> DataFrame:
    """Units in which the members of the left blocks from lo to hi meet all others of their bands that they have not met in a block before."""
    now = mixed.filter(F.col("lefts") > lo).join(found.withColumnRenamed("id", "hid"), "hid", "left").withColumn("component", F.coalesce("component", "hid"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = now.filter((F.col("left") >= lo) & (F.col("left") < hi)).withColumns({"of": F.col("left"), "at": F.explode(upto(F.col("rights")))})
    last = F.least(F.lit(hi).cast("long"), F.col("lefts"), F.coalesce(F.col("left") + 1, "lefts")) - 1
    right = now.filter(F.col("left").isNull() | (F.col("left") >= lo)).withColumns({"of": F.explode(F.sequence(F.lit(lo).cast("long"), last)), "at": F.col("right")})
    twin = F.coalesce(F.col("left") == F.col("of"), F.lit(False))
    both = left.withColumns({"side": F.lit(0), "twin": F.lit(False)}).unionByName(right.withColumns({"side": F.lit(1), "twin": twin}))
    return both.select(F.col("band").alias("unit"), (F.col("of") * F.col("rights") + F.col("at")).alias("block"), "side", "hid", "component", "twin")


def _same_document(named: DataFrame, heads: DataFrame) -> DataFrame | None:
    """Links between the members that rows with the same doc_id belong to; None if each doc_id has one set."""
    one = F.struct("n_shingles", "d1", "d2")
    again = named.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo != hi").select("doc_id")
    if again.isEmpty():
        return None
    of = named.join(again, "doc_id").join(heads, ["n_shingles", "d1", "d2"]).select("doc_id", "hid").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("hid").alias("a")), "doc_id").filter("hid > a").select("a", F.col("hid").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    tables = Tables(docs.sparkSession, "neardup")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    signed = tables.write("signed", texts.mapInArrow(_signed, _SIGNED))
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets have equal signatures
    equal = named.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.first("packed").alias("packed"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    heads = tables.write("heads", equal.select(F.monotonically_increasing_id().alias("hid"), "least.doc_id", "least.key", "n_shingles", "d1", "d2", "packed", "bands", "copies"))
    # a row for each member and band goes through the shuffles, so it holds no signature; those are joined to shared bands
    members = heads.select("hid", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("n_blocks"))
    placed = members.join(shared, "band").join(heads.select("hid", "n_shingles", "packed"), "hid")
    placed = placed.select("band", F.pmod(F.xxhash64("hid"), "n_blocks").alias("block"), "n_blocks", "hid", "n_shingles", "packed")
    partners = placed.repartition("band", "block").sortWithinPartitions("band", "block").mapInArrow(_partners, "band long, hid long, n_shingles long, hub long, similar double")
    near = tables.write("near", partners)

    wanted = near.select("hid").distinct().join(heads.select("hid", "doc_id", "key", "n_shingles", "packed"), "hid")
    held = tables.write("held", texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "hid"]).select("hid", "n_shingles", "packed", "text"))
    links = tables.write("stars", _tested(_stars(near), held))
    same = _same_document(named, heads.select("n_shingles", "d1", "d2", "hid"))
    links = links if same is None else links.unionByName(tables.write("same", same))
    found = components(links, tables, "found")
    mixed = tables.write("mixed", _mixed(near, found))
    tables.drop("near")
    for lo, hi in _ranges(_block_rows(mixed)):
        links = tables.write(f"links{lo}", _tested(_round(mixed, found, lo, hi), held))
        if not links.isEmpty():
            found = _extended(found, links, tables, f"found{lo}")
        tables.drop(f"links{lo}")
    tables.drop("held", "mixed")

    placed = heads.select("hid", "doc_id", "n_shingles", "d1", "d2", "copies").join(found.withColumnRenamed("id", "hid"), "hid", "left").withColumn("component", F.coalesce("component", "hid"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    one = ["n_shingles", "d1", "d2"]
    named_sets = tables.write("sets", placed.join(least, "component").select(*one, "least", (F.col("copies") * HOT > named.count()).alias("hot")))
    # fewer than HOT sets are hot, so these may be broadcast; texts without words or doc_id are joined with nothing
    rows = signed.select("doc_id", *one)
    of = rows.join(F.broadcast(named_sets.filter("hot").drop("hot")), one, "left")
    open_ = F.col("least").isNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    of = of.filter(~open_).unionByName(of.filter(open_).drop("least").join(named_sets.filter("NOT hot").drop("hot"), one, "left"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    judged = tables.write("groups", of.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    tables.drop_others("groups")
    return judged


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which each group's least doc_id stays; rows with the same id stay together."""
    dropped = groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
