"""Relational writes as joins: each returns the whole table as it is to be written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matched(stored: DataFrame, new: DataFrame, key: tuple[str, ...], how: str) -> tuple[DataFrame, DataFrame, Column]:
    left, right = stored.alias("s"), new.alias("n")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    return left, right, on


def upsert(stored: DataFrame, new: DataFrame, *key: str, keep_old_where_null: bool = False, faithful: bool = False) -> DataFrame:
    """Rows of `new` replace those of their key (null equals null) or are added.

    keep_old_where_null: a null in `new` keeps what is stored.  faithful: a key with a null never matches, so its rows are appended.
    new holds at most one row for each key.
    """
    left, right, on = _matched(stored.withColumn("_in", F.lit(1)), new.withColumn("_in", F.lit(1)), key, "full")
    if faithful:
        for k in key:
            on = on & F.col(f"s.{k}").isNotNull()
    both = left.join(right, on, "full")
    has_new = F.col("n._in").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"s.{c}")
        if keep_old_where_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}"))
        return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))

    return both.select(*[value(c).alias(c) for c in stored.columns])


def insert_ignore(stored: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of `new` whose key is not stored are added, one for each key."""
    fresh = new.dropDuplicates(list(key)).join(stored, list(key), "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def delete(stored: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return stored.join(keys.select(*key).distinct(), list(key), "left_anti")


def delete_unreferenced(stored: DataFrame, ids: DataFrame, key: str, references: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(the table after the delete, the ids refused because a row of `references` (its foreign key: the table) points at them)."""
    wanted, refused = ids.select(key).distinct(), None
    for fk, table in references.items():
        hit = wanted.join(table.select(F.col(fk).alias(key)), key, "left_semi")
        refused = hit if refused is None else refused.union(hit)
    refused = wanted.limit(0) if refused is None else refused.distinct()
    return delete(stored, wanted.join(refused, key, "left_anti"), key), refused


def set_where(stored: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Columns changed where a condition holds."""
    return stored.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def superseded(terms: DataFrame, people: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placeholders (moves: placeholder_id, individual_id) give way to people: terms, people with `superseded_by`, and the log."""
    side = moves.select(F.col("placeholder_id").alias("_from"), F.col("individual_id").alias("_to"))
    moved = terms.join(side, terms["individual_id"] == side["_from"], "left")
    log = moved.filter("_to IS NOT NULL").groupBy("_from", "_to").agg(F.count("*").alias("n_terms")).withColumnsRenamed({"_from": "placeholder_id", "_to": "individual_id"})
    new_terms = moved.withColumn("individual_id", F.coalesce("_to", "individual_id")).drop("_from", "_to")
    marked = people.join(side, people["individual_id"] == side["_from"], "left").withColumn("superseded_by", F.col("_to")).drop("_from", "_to")
    return new_terms, marked, log


def move_table(tables: DataFrame, table_id: int, to_office: int) -> DataFrame:
    """The tables with one moved; unchanged if its office would be left without any."""
    own = tables.filter(F.col("table_id") == table_id).select("office_id")
    left = tables.filter(F.col("table_id") != table_id).join(own, "office_id", "left_semi").agg((F.count("*") > 0).alias("ok"))
    ok = left.withColumn("_id", F.lit(table_id))
    joined = tables.join(ok, tables["table_id"] == ok["_id"], "left")
    return joined.withColumn("office_id", F.when(F.coalesce("ok", F.lit(False)), F.lit(to_office)).otherwise(F.col("office_id"))).drop("ok", "_id")


def created(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows with ids above those stored, in the order of all their columns; new is what one request adds."""
    highest = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    rank = F.row_number().over(Window.orderBy(*new.columns))
    # one row, so the product is as large as the new rows
    numbered = new.withColumn("_rank", rank).join(F.broadcast(highest))
    return stored.unionByName(numbered.withColumn(key, (F.col("_top") + F.col("_rank")).cast(stored.schema[key].dataType)).drop("_rank", "_top"), allowMissingColumns=True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside, then put in place by two renames.

    A reader that lists files between the renames finds no table; after a crash there, the old one is at `<path>.old`.  A file system or table format
    with atomic commits closes that gap.
    """
    spark = df.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(old), True)
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(staged), hadoop(path))
    fs.delete(hadoop(old), True)
