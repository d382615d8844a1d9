"""Order-dependent operators as windows: islands, carry-forward, first-wins, keepers, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, *keys: str, start: Column, end: Column, order: Column, gap: int = 1) -> DataFrame:
    """Runs of rows, each at most `gap` after the end of the row before it (not of the longest one so far): column `island`.

    start and end are numbers (days or years); a row without a start, or after one without an end, begins a run.
    """
    by = Window.partitionBy(*keys).orderBy(start.asc_nulls_last(), end.asc_nulls_last(), order)
    before = F.lag(end).over(by)
    new = before.isNull() | start.isNull() | (start - before > gap)
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(rows: DataFrame, *keys: str, start: str, end: str, order: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each island: the carried columns of its first row, the least start, the greatest end, the number of rows.

    A run with an open end stays open.
    """
    first = [F.min_by(c, F.struct(F.col(start).isNull(), start, F.col(end).isNull(), end, order)).alias(c) for c in carried]
    last = F.when(F.count_if(F.col(end).isNull()) == 0, F.max(end))
    return rows.groupBy(*keys, "island").agg(*first, F.min(start).alias(start), last.alias(end), F.count("*").alias("n_rows"))


def carry_forward(rows: DataFrame, column: str, *keys: str, order: str) -> DataFrame:
    """Nulls filled with the last value before them."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(column, F.coalesce(column, F.last(column, True).over(before)))


def first_of_key(rows: DataFrame, *key: Column, order: list[Column], comparable: Column | None = None) -> DataFrame:
    """The first row of each key; rows that are not comparable are always kept."""
    by = Window.partitionBy(*key, *([comparable] if comparable is not None else [])).orderBy(*order)
    keep = F.row_number().over(by) == 1
    return rows.withColumn("_keep", keep if comparable is None else (keep | ~comparable)).filter("_keep").drop("_keep")


def first_and_last(rows: DataFrame, *keys: str, order: Column, columns: tuple[str, ...]) -> DataFrame:
    """first_... and last_...: columns of the first and the last row of each key, by one aggregation."""
    row = F.struct(*columns)
    ends = rows.groupBy(*keys).agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"))
    return ends.select(*keys, *[F.col(f"_{at}.{c}").alias(f"{at}_{c}") for at in ("first", "last") for c in columns])


def keeper(rows: DataFrame, key: Column, row_id: str, last: bool = False) -> DataFrame:
    """`keeper_id`: the least (or the greatest) id of each key; a row is a duplicate if it is not its own keeper.  One aggregation and a join, no sort."""
    least = rows.groupBy(key.alias("_key")).agg((F.max if last else F.min)(row_id).alias("keeper_id"))
    return rows.withColumn("_key", key).join(least, "_key").drop("_key")


def relinked(children: DataFrame, keepers: DataFrame, fk: str, row_id: str) -> DataFrame:
    """Children that point at the keeper of what they pointed at."""
    side = keepers.select(F.col(row_id).alias(fk), "keeper_id")
    return children.join(side, fk, "left").withColumn(fk, F.coalesce("keeper_id", fk)).drop("keeper_id")


def latest(rows: DataFrame, *keys: str, order: Column, columns: tuple[str, ...]) -> DataFrame:
    """The last row of each key, by one aggregation with map-side combining."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*keys, "_last.*")


def best_candidate(scores: DataFrame, *keys: str, candidate: str) -> DataFrame:
    """The candidate table with the fewest missing holders, then the most rows, then the least number.

    It must have fewer missing holders than the current one (column `current_missing`).
    """
    better = scores.filter("n_rows > 0 AND missing < current_missing")
    rank = F.struct(F.col("missing").alias("m"), (-F.col("n_rows")).alias("r"), F.col(candidate).alias("c"))
    best = better.groupBy(*keys).agg(F.min(rank).alias("b"))
    return best.select(*keys, F.col("b.c").alias(candidate), F.col("b.m").alias("missing"), (-F.col("b.r")).alias("n_rows"))


def missing_holders(stored: DataFrame, parsed: DataFrame, *keys: str, holder: str) -> DataFrame:
    """How many stored holders of each key the parsed rows lack."""
    known = stored.filter(F.col(holder) != "").select(*keys, holder).distinct()
    gone = known.join(parsed.select(*keys, holder).distinct(), [*keys, holder], "left_anti")
    counts = gone.groupBy(*keys).agg(F.count("*").alias("missing"))
    return known.select(*keys).distinct().join(counts, list(keys), "left").fillna(0, ["missing"])


#: Parts into which the holders of one key are numbered, so that no task numbers them all.
_PARTS = 64


def table_scores(stored: DataFrame, parsed: DataFrame, key: str, candidate: str, holder: str, coarse: str) -> DataFrame:
    """key, candidate, n_rows, n_stored, missing, missing_coarse: for each candidate table how many of the key's stored holders it lacks.

    stored: key and the holders by their exact and their coarse key (`holder`, `coarse`; blanks and nulls are none); parsed: the same for the rows of each
    candidate.  Stored holders are numbered, and what a table has of them is a bitmap of fixed size for each part of the
    numbers, built by partial aggregation.
    """
    scores = parsed.groupBy(key, candidate).agg(F.count("*").alias("n_rows"))
    for column, name in ((holder, "missing"), (coarse, f"missing_{coarse}")):
        known = stored.filter(F.coalesce(F.col(column), F.lit("")) != "").select(key, F.col(column).alias("_h")).distinct()
        part = F.pmod(F.xxhash64("_h"), F.lit(_PARTS)).cast("int")
        number = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_h")).cast("long")
        known = known.withColumn("_part", part).withColumn("_n", number)
        held = parsed.select(key, candidate, F.col(column).alias("_h")).join(known, [key, "_h"])
        bits = held.groupBy(key, candidate, "_part", F.bitmap_bucket_number("_n").alias("_bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("_n"))).alias("n"))
        covered = bits.groupBy(key, candidate).agg(F.sum("n").alias("_covered"))
        total = known.groupBy(key).agg(F.count("*").alias("_total"))
        scores = scores.join(total, key, "left").join(covered, [key, candidate], "left")
        scores = scores.withColumn(name, F.coalesce("_total", F.lit(0)) - F.coalesce("_covered", F.lit(0)))
        scores = (scores.withColumn("n_stored", F.coalesce("_total", F.lit(0))) if column == holder else scores).drop("_total", "_covered")
    return scores.select(key, candidate, "n_rows", "n_stored", "missing", F.col(f"missing_{coarse}").alias("missing_coarse"))


def shifted_tables(scores: DataFrame, current: DataFrame, key: str, candidate: str, limit: float = 0.40) -> DataFrame:
    """key, current, missing_before, found, missing_after: for keys whose current table lacks more than a share of the stored holders.

    current: the key's table now; one that was not parsed lacks all holders.  found is the table that lacks fewer holders than the current one, by exact keys, then by coarse ones; of
    several the one with more rows, but the first of those that lack none; ties: the first.  Null if no table is better.
    """
    now = current.select(key, F.col(candidate).alias("current"))
    own = now.join(scores, (now[key] == scores[key]) & (F.col("current") == F.col(candidate)), "left").select(now[key], "current", "missing", "missing_coarse")
    stored = scores.groupBy(key).agg(F.max("n_stored").alias("n_stored"))
    own = own.join(stored, key).select(
        key, "current", "n_stored", F.coalesce("missing", "n_stored").alias("missing_before"), F.coalesce("missing_coarse", "n_stored").alias("coarse_before")
    )
    alarmed = own.filter(F.col("missing_before") > limit * F.col("n_stored"))
    worse = F.struct("missing", "missing_coarse") < F.struct(F.col("missing_before").alias("missing"), F.col("coarse_before").alias("missing_coarse"))
    others = scores.drop("n_stored").join(alarmed, key).filter((F.col(candidate) != F.col("current")) & worse)
    rows = F.when((F.col("missing") == 0) & (F.col("missing_coarse") == 0), 0).otherwise(-F.col("n_rows"))
    best = others.groupBy(key).agg(F.min(F.struct("missing", "missing_coarse", rows.alias("r"), F.col(candidate).alias("t"))).alias("_b"))
    return alarmed.join(best, key, "left").select(key, "current", "missing_before", F.col("_b.t").alias("found"), F.col("_b.missing").alias("missing_after"))


def renumbered(rows: DataFrame, changes: DataFrame, *keys: str, number: str) -> DataFrame:
    """Numbers changed as asked (keys, number, new_number); the row that had a new number gets the old one."""
    forth = changes.select(*keys, F.col(number), F.col("new_number").alias("_to"))
    back = changes.select(*keys, F.col("new_number").alias(number), F.col(number).alias("_to"))
    moves = forth.unionByName(back.join(forth, [*keys, number], "left_anti"))
    return rows.join(moves, [*keys, number], "left").withColumn(number, F.coalesce("_to", number)).drop("_to")


def table_proposals(configs: DataFrame, scores: DataFrame, key: str, candidate: str, confirmed: Column) -> DataFrame:
    """What a search for a better table says of each config (key, candidate, n_terms, current_missing), and the table after it.

    message: 'no terms', 'none better', 'proposed' or, where it was confirmed, 'updated'.
    """
    searched = configs.filter("n_terms > 0").select(key, "current_missing")
    best = best_candidate(scores.join(searched, key), key, candidate=candidate).select(key, F.col(candidate).alias("proposed"), F.col("missing").alias("missing_after"))
    found, taken = F.col("proposed").isNotNull(), F.coalesce(confirmed, F.lit(False))
    message = F.when(F.coalesce("n_terms", F.lit(0)) == 0, "no terms").when(~found, "none better").when(taken, "updated").otherwise("proposed")
    before = F.when(message != "no terms", F.col("current_missing")).alias("missing_before")
    return configs.join(best, key, "left").select(key, message.alias("message"), F.when(found & taken, F.col("proposed")).otherwise(F.col(candidate)).alias(candidate), "proposed", before, "missing_after")
