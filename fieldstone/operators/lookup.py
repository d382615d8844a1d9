"""Filters, scopes, look-ups and joins over the relational tables.

Sides are never forced to be broadcast: Spark does so where statistics say that one is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def optional_filters(df: DataFrame, filters: Mapping[str, object], contains: Mapping[str, str | None] | None = None) -> DataFrame:
    """All filters that are given (None: not given): equality, and parts of texts in any case."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    for name, part in (contains or {}).items():
        if part:
            df = df.filter(F.contains(F.lower(name), F.lit(part.lower())))
    return df


def search(df: DataFrame, query: str, *columns: str, key: str, limit: int = 20) -> DataFrame:
    """Rows with the query in any of the columns; nothing for a query under two characters."""
    if len(query.strip()) < 2:
        return df.limit(0)
    met = F.lit(False)
    for c in columns:
        met = met | F.coalesce(F.contains(F.col(c), F.lit(query)), F.lit(False))
    return df.filter(met).orderBy(key).limit(limit)


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def stale(df: DataFrame, stamp: str, as_of: Column, days: int) -> DataFrame:
    """Rows never checked, or last checked before a cool-down."""
    return df.filter(F.col(stamp).isNull() | (F.col(stamp) < as_of - F.make_interval(days=F.lit(days))))


def is_living_page(people: DataFrame) -> Column:
    """People held to be living whose page can be read: neither a dead link nor a placeholder."""
    return (F.col("is_living") == 1) & (F.col("is_dead_link") == 0) & ~F.col("wiki_url").startswith("No link:")


def url_sets(people: DataFrame) -> DataFrame:
    """(kind, wiki_url): the distinct links of the living, and the dead ones."""
    kinds = F.array(F.when(is_living_page(people), "living"), F.when(F.col("is_dead_link") == 1, "dead_link"))
    return people.select(F.explode(F.array_compact(kinds)).alias("kind"), "wiki_url").distinct()


def refresh_batch(people: DataFrame, bucket: int, most: int) -> DataFrame:
    """The living of one batch, those never refreshed first, then those refreshed longest ago."""
    own = people.filter(is_living_page(people) & (F.col("bio_batch") == bucket))
    return own.orderBy(F.col("bio_refreshed_at").asc_nulls_first(), "wiki_url").limit(most)


def lacks_vitals() -> Column:
    """No birth date, or known to be dead without a date of death."""
    return F.col("birth_date").isNull() | (F.col("death_date").isNull() & (F.col("is_living") == 0))


def matching_people(terms: DataFrame, people: DataFrame, *keys: str, overwrite: bool = False) -> DataFrame:
    """For each category: matching terms, people among them, and people eligible for a run (without a birth date unless overwritten)."""
    blank = F.trim(F.coalesce("birth_date", F.lit(""))) == ""
    eligible = people.select("individual_id", (F.lit(overwrite) | blank).alias("_open"))
    joined = terms.join(eligible, "individual_id", "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("matching_records"),
        F.count_distinct("individual_id").alias("matching_individuals"),
        F.count_distinct(F.when(F.coalesce("_open", F.lit(True)), F.col("individual_id"))).alias("eligible_individuals"),
    )


def by_url(requests: DataFrame, pages: DataFrame, url: str, key: str) -> DataFrame:
    """requests with the least key of a page whose link is the same but for case and outer blanks; a blank request has none."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    side = pages.groupBy(norm(url).alias("_u")).agg(F.min(key).alias(key)).filter("_u <> ''")
    return requests.withColumn("_u", norm(url)).join(side, "_u", "left").drop("_u")


def page_list(pages: DataFrame, offices: DataFrame, tables: DataFrame, names: Mapping[str, tuple[DataFrame, str, str]], equal: Mapping[str, int | None], category: int | None = None, office_count: str = "all", limit: int | None = None) -> DataFrame:
    """Pages with names and counts of offices and tables, filtered and sorted by names.

    equal: columns of pages and what they have to be; 0 and None are no filters, but for `enabled`, where only None is.
    office_count: all, gt0 (with offices), eq0 (without).
    """
    for column, value in equal.items():
        if value is not None and (value != 0 or column == "enabled"):
            pages = pages.filter(F.col(column) == value)
    if category:
        pages = pages.join(offices.filter(F.col("office_category_id") == category), "page_id", "left_semi")
    per_office = tables.groupBy("office_id").agg(F.count("*").alias("n"))
    counts = offices.join(per_office, "office_id", "left").groupBy("page_id").agg(
        F.count("*").alias("office_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("table_count"), F.min("office_id").alias("first_office_id")
    )
    listed = with_names(pages, names).join(counts, "page_id", "left").fillna(0, ["office_count", "table_count"])
    if office_count != "all":
        listed = listed.filter("office_count > 0" if office_count == "gt0" else "office_count = 0")
    if limit is None:
        return listed
    order = [F.coalesce(F.col(fk.removesuffix("_id")), F.lit("")) for fk in names]
    return listed.orderBy(*order, "url").limit(limit)


def saved_configs(tables: DataFrame, office_id: int, table_no: int | None = None) -> DataFrame:
    """The stored configs of one office, or that of one of its tables."""
    own = tables.filter(F.col("office_id") == office_id)
    return own if table_no is None else own.filter(F.col("table_no") == table_no)


def offsets(total: Column, offset: Column, size: int) -> Column:
    """struct(previous, next): where the pages before and after begin; null if there is none."""
    return F.struct(
        F.when(offset > 0, F.greatest(offset - size, F.lit(0))).alias("previous"), F.when(offset + size < total, offset + size).alias("next")
    )


def batch(df: DataFrame, key: str, buckets: int, bucket: int) -> DataFrame:
    """One of the staggered batches."""
    return df.filter(F.pmod(F.col(key), F.lit(buckets)) == bucket)


def in_scope(items: DataFrame, bridges: Mapping[str, tuple[DataFrame, object]], key: str) -> DataFrame:
    """Items whose scope holds the context; in each dimension an empty scope applies to all.

    bridges: dimension column -> (bridge of key and dimension, value of the context or None).
    """
    for dimension, (bridge, value) in bridges.items():
        scope = bridge.groupBy(key).agg(F.max(F.coalesce(F.col(dimension) == F.lit(value), F.lit(False))).alias("in_scope"))
        items = items.join(scope, key, "left").filter(F.coalesce("in_scope", F.lit(True))).drop("in_scope")
    return items


def enabled_units(tables: DataFrame, offices: DataFrame, pages: DataFrame) -> DataFrame:
    """Table configs that are enabled with their office and page."""
    on = lambda df: df.filter("enabled = 1").drop("enabled")
    return on(tables).join(on(offices), "office_id").join(on(pages), "page_id")


def recent(df: DataFrame, column: str, as_of: Column, days: int = 90) -> DataFrame:
    """Rows whose YYYY-MM-DD text lies in the days up to as_of; other texts never do."""
    from ..functions.dates import real_date

    day = real_date(F.col(column))
    return df.filter(day.between(F.date_sub(as_of, days), as_of))


def by_either_key(rows: DataFrame, lookup: DataFrame, value: str, scope: str, key: str, names: tuple[str, str], found: str) -> DataFrame:
    """An equi-join on either of two keys within a scope; of several matches the least id wins."""
    keys = lookup.select(scope, key, F.explode(F.array(*[F.trim(F.col(n)) for n in names])).alias("_k")).filter("_k IS NOT NULL AND _k <> ''")
    keys = keys.groupBy(scope, "_k").agg(F.min(key).alias(found))
    return rows.withColumn("_k", F.trim(F.col(value))).join(keys, [scope, "_k"], "left").drop("_k")


def nearest(rows: DataFrame, stored: DataFrame, key: str, row_id: str, row_year: str, stored_id: str, stored_year: str) -> DataFrame:
    """Each row with the stored row of its key whose year is nearest (none counts as 0); without a year the first; ties: the first, by stored_id.

    No pair of a row and a stored row is made: the first stored row of each year and the years asked for stand in one line by year,
    where the last one before and the first one after a year are looked up.  A key's line holds a row for each distinct
    year, and rows meet their year's answer in an equi-join.  A row with none stored keeps nulls.
    """
    columns = [c for c in stored.columns if c != key]
    year = F.coalesce(F.col(stored_year), F.lit(0)).cast("long")
    first = F.min_by(F.struct(year.alias("y"), F.col(stored_id).alias("i"), F.struct(*columns).alias("row")), F.col(stored_id)).alias("_held")
    held = stored.groupBy(key, year.alias("_year")).agg(first)
    asked_year = F.coalesce(F.col(row_year), F.lit(0)).cast("long")
    asked = rows.select(key, asked_year.alias("_year")).distinct()
    line = held.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    of_key = Window.partitionBy(key)
    up = of_key.orderBy("_year", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = of_key.orderBy(F.desc("_year"), "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = line.select(
        key, "_year", "_asked", F.last("_held", True).over(up).alias("b"), F.last("_held", True).over(down).alias("a"), F.min_by("_held", F.col("_held.i")).over(of_key).alias("any")
    ).filter("_asked")
    gap = lambda side: F.abs(F.col(f"{side}.y") - F.col("_year"))
    before = F.col("a").isNull() | (gap("b") < gap("a")) | ((gap("b") == gap("a")) & (F.col("b.i") <= F.col("a.i")))
    best = F.when(F.col("_year") == 0, F.col("any")).when(F.col("b").isNotNull() & before, F.col("b")).otherwise(F.col("a"))
    met = rows.withColumn("_year", asked_year).join(near.select(key, "_year", best["row"].alias("_row")), [key, "_year"], "left")
    return met.select(*rows.columns, *(F.col("_row")[c].alias(c) for c in columns))


#: Bytes of names that a task holds at a time.
NAMES_BLOCK = 4 << 20


def first_name_in(texts: DataFrame, names: DataFrame, scope: str, text: str, found: str) -> DataFrame:
    """(scope, text, found): for each of distinct texts (lower case) the first name, in the order of names, of its scope that it holds, whatever the name's case.

    Names (scope, name) go into Aho-Corasick automata, one for each scope, and each text is read once for all of them.  They are
    broadcast in blocks of NAMES_BLOCK bytes by their hash, one block at a time, so texts are read once a block.  Texts
    that hold no name, and nulls, are left out.
    """
    spark = texts.sparkSession
    names = names.filter("name <> ''").select(scope, "name").distinct()
    size = names.agg(F.coalesce(F.sum(F.octet_length("name") + F.lit(32)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // NAMES_BLOCK))
    schema = texts.select(scope, text).schema.add(found, "string")

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _automata(sent.value)
            for batch in batches:
                best = [_least(of.get(s), t) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                hit = pa.array([b is not None for b in best])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string())], names=schema.names).filter(hit)

        return run

    rows, parts = texts.select(scope, text), []
    for k in range(blocks):
        block = names.filter(F.pmod(F.xxhash64(scope, "name"), F.lit(blocks)) == k) if blocks > 1 else names
        sent = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])  # NAMES_BLOCK bytes in expectation
        parts.append(rows.mapInArrow(search(sent), schema))
    met = reduce(DataFrame.unionByName, parts)
    return met if blocks == 1 else met.groupBy(scope, text).agg(F.min(found).alias(found))


def party_finder(parties: DataFrame) -> Callable[[Column, Column], Column] | None:
    """A function of a country and of cells (key, links), the key in lower case, that gives the party of the first cell that has one: by the
    first of its links that is a party's, else the first party in the order of names that the key holds.

    The parties (country, name and, if there, link) are broadcast, so that rows are neither shuffled nor read twice; None if they exceed NAMES_BLOCK bytes.
    """
    own = parties.select("country", "name", F.col("link") if "link" in parties.columns else F.lit(None).cast("string").alias("link")).filter("country IS NOT NULL AND name IS NOT NULL").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length(F.coalesce("link", F.lit(""))) + F.lit(32)), F.lit(0))).first()[0]
    if size > NAMES_BLOCK:
        return None
    sent = parties.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])
    made: dict = {}

    @arrow_udf("string")
    def find(countries: pa.Array, cells: pa.Array) -> pa.Array:
        if not made:
            made["names"] = _automata([(c, n) for c, n, _ in sent.value if n])
            made["links"] = links = {}
            for c, n, link in sent.value:
                if link is not None:
                    links[c, link] = min(n, links.get((c, link), n), key=str.encode)
        names, links = made["names"], made["links"]

        def party(country, cells):
            words = names.get(country)
            for c in cells or ():
                met = next((links[country, x] for x in c["links"] or () if (country, x) in links), None)
                if met is None and (met := _least(words, c["key"])) is None:
                    continue
                return met

        return pa.array([party(s, c) for s, c in zip(countries.to_pylist(), cells.to_pylist(), strict=True)], pa.string())

    return find


def _automata(names: list[tuple]) -> dict:
    """scope -> an automaton whose words hold the least name that is written like them in lower case."""
    of: dict = {}
    for scope, name in names:
        words = of.setdefault(scope, ahocorasick.Automaton())
        key = name.lower()
        words.add_word(key, min(name, words.get(key, name)))
    for words in of.values():
        words.make_automaton()
    return of


def _least(words, text: str | None) -> str | None:
    if words is None or text is None:
        return None
    return min((name for _, name in words.iter(text)), default=None, key=str.encode)


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """Parents with the sorted list of their children."""
    child = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(child)).alias(name))
    return parents.join(lists, key, "left")


def with_names(rows: DataFrame, dimensions: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """A star: foreign key -> (dimension, its key, its name); the name comes as a column named like the foreign key without _id."""
    for fk, (dim, pk, name) in dimensions.items():
        side = dim.select(F.col(pk).alias(fk), F.col(name).alias(fk.removesuffix("_id")))
        rows = rows.join(side, fk, "left")
    return rows


def unlinked_people(people: DataFrame, url: str = "wiki_url") -> DataFrame:
    return people.filter(F.col(url).startswith("No link:"))


def placeholders_like(placeholders: DataFrame, rows: DataFrame, office: str, name: str) -> DataFrame:
    """Rows with the placeholder of their office and name; the key is No link:<office>:<name>."""
    parts = F.split("wiki_url", ":", 3)
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    side = placeholders.filter(F.col("wiki_url").startswith("No link:")).select(
        F.get(parts, 1).try_cast("long").alias(office), norm(F.get(parts, 2)).alias("_n"), F.col("individual_id").alias("placeholder_id")
    )
    side = side.groupBy(office, "_n").agg(F.min("placeholder_id").alias("placeholder_id"))
    return rows.withColumn("_n", norm(F.col(name))).join(side, [office, "_n"], "left").drop("_n")


def distinct_columns_problem(*columns: Column) -> Column:
    """A message unless the configured columns (0: none) differ from each other."""
    used = F.filter(F.array(*columns), lambda c: c > 0)
    return F.when(F.size(F.array_distinct(used)) < F.size(used), "columns must differ").when(F.exists(F.array(*columns), lambda c: c < 0), "columns must not be negative")


def level_problem(level: Column, state: Column, city: Column, branch: Column) -> Column:
    """Federal offices have neither state nor city (but for the legislature), state ones a state, local ones both."""
    low = F.lower(F.coalesce(level, F.lit("")))
    legislative = F.lower(F.coalesce(branch, F.lit(""))) == "legislative"
    return (
        F.when((low == "federal") & city.isNotNull(), "federal offices have no city")
        .when((low == "federal") & state.isNotNull() & ~legislative, "federal offices have no state")
        .when((low == "state") & state.isNull(), "state offices need a state")
        .when((low == "state") & city.isNotNull(), "state offices have no city")
        .when((low == "local") & (state.isNull() | city.isNull()), "local offices need a state and a city")
    )


def scoped_filters(wanted: DataFrame, filters: DataFrame, bridges: Mapping[str, DataFrame], filter_id: str, *keys: str) -> DataFrame:
    """`filter_id` for each row: the least filter with its keys whose scope is the row's in every dimension, null if there is none.

    bridges: a dimension's column -> (filter_id, that column); a row without a value meets the filters that have no row in that bridge.
    """
    scoped = filters.select(filter_id, *keys)
    for dimension, bridge in bridges.items():
        scoped = scoped.join(bridge.select(filter_id, dimension), filter_id, "left")
    least = scoped.groupBy(*keys, *bridges).agg(F.min(filter_id).alias(filter_id))
    w, s = wanted.alias("w"), least.alias("s")
    met = [F.col(f"w.{k}") == F.col(f"s.{k}") for k in keys] + [F.col(f"w.{d}").eqNullSafe(F.col(f"s.{d}")) for d in bridges]
    return w.join(s, met, "left").select("w.*", F.col(f"s.{filter_id}").alias(filter_id))


def unresolved(resolved: str = "resolved") -> Column:
    """What is open: marked as not resolved; a row without a mark is neither."""
    return F.coalesce(~F.col(resolved).cast("boolean"), F.lit(False))
