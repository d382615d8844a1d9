"""Table rows to term rows under an extraction config: binding of columns, links, dates, parties, carry-over.

A config's fields (columns are 0-based; -1: none) are Python values, which shape
the plan, or columns of a table of configs that `extract_units` joins to the rows, so that one plan
serves all units.  Every step is a Column expression over `cells`; only what looks at the rows
before (a continuation under a rowspan) is a window over one table's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from ..functions.common import once
from ..sources import html
from . import infobox
from .lookup import first_name_in, party_finder

NO_PARTY, NO_DISTRICT = "No party", "No district"


@dataclass(frozen=True)
class Config:
    """An extraction config; columns are 0-based, -1 is none.  A field is a value or a Column."""

    table_no: int = 1
    table_rows: int = 2
    link_column: int = 0
    party_column: int = -1
    term_start_column: int = 1
    term_end_column: int = 2
    district_column: int = -1
    filter_column: int = -1
    filter_criteria: str = ""
    dynamic_parse: bool = False
    read_right_to_left: bool = False
    parse_rowspan: bool = False
    years_only: bool = False
    term_dates_merged: bool = False
    ignore_non_links: bool = False
    find_date_in_infobox: bool = False
    party_link: bool = False
    party_ignore: bool = False
    district_ignore: bool = False
    district_at_large: bool = False

    COLUMNS = ("link_column", "party_column", "term_start_column", "term_end_column", "district_column")

    @classmethod
    def of(cls, config: Column, *named: str) -> Config:
        """The fields of a struct column of configs, of which it has those named; a null, or a field that is not named, has its default."""
        return cls(**{f.name: F.coalesce(config[f.name].cast(_TYPES[f.type]), F.lit(f.default)) for f in fields(cls) if f.name in named})


_TYPES = {"int": "int", "str": "string", "bool": "boolean"}


def either(flag: bool | Column, yes: Callable[[], Column], no: Callable[[], Column]) -> Column:
    """yes() or no(): once for all by a value, row by row by a Column."""
    if isinstance(flag, Column):
        return F.when(flag, yes()).otherwise(no())
    return yes() if flag else no()


def _col(value: int | str | bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _may(flag: bool | Column) -> bool:
    """Whether a flag can be set for any row."""
    return isinstance(flag, Column) or flag


def cell(i: Column) -> Column:
    """The cell at an index; null for none or one beyond the row."""
    return F.when(i >= 0, F.get("cells", i))


def mirrored(i: Column, right_to_left: bool | Column) -> Column:
    """Columns counted from the right; none stays none, and the filter column is not mirrored."""
    return either(right_to_left, lambda: F.when(i < 0, i).otherwise(F.size("cells") - 1 - i), lambda: i)


def passes_filter(column: int | Column, criteria: str | Column) -> Column:
    """Whether one cell holds a text, whatever its case and white space."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    at, wanted = _col(column), squeeze(_col(criteria))
    return (at < 0) | (wanted == "") | F.coalesce(F.contains(squeeze(cell(at)["text_sp"]), wanted), F.lit(False))


def link_target(href: Column) -> Column:
    """The full address of a cell's link; null if it cannot be a holder's page."""

    def path(bare: Column) -> Column:
        return (
            F.when(bare.rlike("^https?://"), F.regexp_replace(bare, r"^https?://[^/]*", ""))
            .when(bare.startswith("./"), F.concat(F.lit("/wiki/"), F.substring(bare, F.lit(3), F.length(bare))))
            .when(bare.startswith("/wiki/"), bare)
            .when(bare.startswith("/"), F.concat(F.lit("/wiki"), bare))
            .otherwise(F.concat(F.lit("/wiki/"), bare))
        )

    def judged(bare: Column) -> Column:
        bad = (F.instr(bare, "/File:") > 0) | (F.instr(bare, "#") > 0) | (bare == "")
        foreign = bare.rlike("^https?://") & (F.instr(bare, urls.WIKI_HOST) == 0)
        return F.when(~bad & ~foreign, once(path(bare), lambda p: F.when(~urls.is_ignored(p), F.concat(F.lit(urls.WIKI_BASE), p))))

    return once(F.trim(href), judged)


def holder_link(i: Column, excluded: Column, probe_before: Column) -> Column:
    """The first link of a cell that may be a holder; if the cell has links but none that may, of the cells before the dates."""

    def first(links: Column) -> Column:
        found = F.filter(F.transform(links, lambda a: link_target(a["href"])), lambda u: u.isNotNull() & ~F.array_contains(excluded, u))
        return F.get(found, 0)

    own = F.coalesce(cell(i)["links"], F.array().cast("array<struct<href:string,text:string>>"))
    others = F.flatten(F.transform(F.slice("cells", F.lit(1), F.greatest(probe_before, F.lit(0))), lambda c: c["links"]))
    return F.when(F.size(own) > 0, F.coalesce(first(own), first(others)))


def found_link_column(low: Column, high: Column) -> Column:
    """The first cell from low to high, else of the whole row, with a link to a page; -1 if there is none."""
    ok = F.transform("cells", lambda c, i: F.exists(c["links"], lambda a: link_target(a["href"]).isNotNull()))
    near = lambda ok: F.transform(ok, lambda x, i: x & (i >= low) & (i <= high))
    at = once(ok, lambda ok: F.coalesce(F.nullif(F.array_position(near(ok), True), F.lit(0)), F.array_position(ok, True)))
    return (at - 1).cast("int")


def sort_value_date(c: Column, last: bool) -> Column:
    """The machine date of a cell, for cells whose text gives none."""
    value = F.element_at(c["sort_values"], -1) if last else F.get(c["sort_values"], 0)
    return F.nullif(F.regexp_extract(F.when(F.size(c["sort_values"]) > 0, value), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def _or_sort_value(parsed: Column, c: Column, last: bool) -> Column:
    return F.when(parsed == dates.INVALID, F.coalesce(sort_value_date(c, last), parsed)).otherwise(parsed)


def _may_be_range(c: Column) -> Column:
    return c["text_sp"].rlike("–| - | to ")


def recovered_range(ranges: Column, skip: Column, known: Column | None = None) -> Column:
    """The first of the ranges of a row's cells (see prepared_dates) that has a start, but for one cell."""
    tried = F.transform(ranges, lambda x, i: F.when((i != skip) & x.isNotNull(), dates.settled_range(x, known)))
    return F.get(F.filter(tried, lambda r: r.isNotNull() & (r["start"] != dates.INVALID)), 0)


_DATE = "struct<done:string,loose:string>"
_RANGE = f"struct<start:{_DATE},end:{_DATE}>"


def prepared_dates(start: Column, end: Column, short: Column, config: Config) -> Column:
    """struct(start, end, ranges, singles) of a row's dates before the free-form parser: of the cells for start and end, as ranges of cells
    (merged dates: the cell for both and those with a delimiter; short rows: all) and of the first cells of short rows."""
    none = lambda kind: F.lit(None).cast(kind)
    dated = lambda make: either(config.years_only, lambda: none(_DATE), lambda: either(config.term_dates_merged, lambda: none(_DATE), make))
    asked = lambda c, i: _col(config.term_dates_merged) & ((i == start) | _may_be_range(c)) | short
    ranges = lambda: F.transform("cells", lambda c, i: F.when(asked(c, i), dates.prepared_range(c["text_sp"])))
    singles = lambda: F.when(short, F.transform(F.slice("cells", 1, 3), lambda c: dates.prepared_single(c["text_sp"])))
    in_ranges = _may(config.term_dates_merged) or _may(config.parse_rowspan)
    return F.struct(
        dated(lambda: dates.prepared_single(cell(start)["text_sp"])).alias("start"),
        dated(lambda: dates.prepared_single(cell(end)["text_sp"])).alias("end"),
        either(config.years_only, lambda: none(f"array<{_RANGE}>"), lambda: ranges() if in_ranges else none(f"array<{_RANGE}>")).alias("ranges"),
        either(config.years_only, lambda: none(f"array<{_DATE}>"), lambda: singles() if _may(config.parse_rowspan) else none(f"array<{_DATE}>")).alias("singles"),
    )


def loose_texts(prepared: Column) -> Column:
    """The date texts of a row that the fixed forms do not settle."""
    none = F.array().cast("array<string>")
    ranges = F.flatten(F.transform(prepared["ranges"], lambda x: F.array(x["start"]["loose"], x["end"]["loose"])))
    singles = F.transform(prepared["singles"], lambda x: x["loose"])
    return F.array_compact(F.concat(F.array(prepared["start"]["loose"], prepared["end"]["loose"]), F.coalesce(ranges, none), F.coalesce(singles, none)))


def term_dates(prepared: Column, start: Column, end: Column, years_only: bool | Column, merged: bool | Column, known: Column | None = None) -> Column:
    """struct(term_start, term_end, term_start_year, term_end_year) by the config's mode, of what prepared_dates gives."""
    a, b = cell(start), cell(end)
    no_text, no_year = F.lit(None).cast("string"), F.lit(None).cast("int")
    pair = lambda first, last: F.struct(first.alias("start"), last.alias("end"))

    def in_years() -> Column:
        years = either(merged, lambda: dates.year_range(a["text_sp"]), lambda: pair(dates.year_range(a["text_sp"])["start"], dates.year_range(b["text_sp"])["end"]))
        return F.struct(no_text.alias("term_start"), no_text.alias("term_end"), years["start"].alias("term_start_year"), years["end"].alias("term_end_year"))

    def in_one() -> Column:
        kept = lambda own: F.when(own["start"] == dates.INVALID, F.coalesce(recovered_range(prepared["ranges"], start, known), own)).otherwise(own)
        return once(dates.settled_range(F.get(prepared["ranges"], start), known), lambda own: dated(once(kept(own), lambda x: x), a))

    def in_two() -> Column:
        return dated(pair(dates.settled(prepared["start"], known), dates.settled(prepared["end"], known)), b)

    def dated(own: Column, c: Column) -> Column:
        def texts(own: Column) -> Column:
            first, last = _or_sort_value(own["start"], a, False), _or_sort_value(own["end"], c, True)
            return F.struct(first.alias("term_start"), last.alias("term_end"), no_year.alias("term_start_year"), no_year.alias("term_end_year"))

        return once(own, texts)

    return either(years_only, in_years, lambda: either(merged, in_one, in_two))


def table_years(start: Column, end: Column) -> Column:
    """struct(start, end): the years in a row's date cells; a cell of its own for the end decides it alone."""
    first, last = dates.year_range(cell(start)["text_sp"]), dates.year_range(cell(end)["text_sp"])
    own_end = (start != end) & cell(end).isNotNull()
    return F.struct(first["start"].alias("start"), F.when(own_end, F.coalesce(last["end"], last["start"])).otherwise(first["end"]).alias("end"))


def infobox_dates(terms: DataFrame, people: DataFrame, offices: DataFrame, *keys: str, role: str | None = None) -> DataFrame:
    """The terms with the dates of their holders' infoboxes, one row for each term found there.

    terms: with `table_years`, which stand alone if the infobox gives no date; rows without a link, or with null table_years, keep their dates.
    people: (wiki_link, page); offices: keys and office_path.
    """
    asked = F.col("table_years").isNotNull()
    pairs = terms.filter(asked & (F.col("wiki_link") != urls.NO_LINK)).select(*keys, "wiki_link").distinct()
    boxes = infobox.infobox_terms(pairs.join(people, "wiki_link", "left"), pairs.join(offices, [*keys]), *keys, "wiki_link", role=role)
    boxes = boxes.select(*keys, "wiki_link", F.col("term_start").alias("box_start"), F.col("term_end").alias("box_end"))
    joined = terms.join(boxes, [*keys, "wiki_link"], "left")
    linked, none = asked & F.col("box_start").isNotNull(), F.coalesce(F.col("box_start") == infobox.PLACEHOLDER, F.lit(False))
    chosen = {}
    for side in ("start", "end"):
        chosen[f"term_{side}"] = F.when(linked, F.when(~none, F.col(f"box_{side}"))).otherwise(F.col(f"term_{side}"))
        chosen[f"term_{side}_year"] = F.when(linked, F.when(none, F.col("table_years")[side])).otherwise(F.col(f"term_{side}_year"))
    return joined.withColumns(chosen).select(*[c for c in terms.columns if c != "table_years"])


def extract(
    rows: DataFrame, config: Config, *keys: str, excluded_links: Column | None = None, people: DataFrame | None = None, offices: DataFrame | None = None, role: str | None = None
) -> DataFrame:
    """Term rows of the tables in `rows` (keys, table_no, row_index, cells) under one config.

    Returns the keys, table_no, row_index, wiki_link ('No link' if none), name_from_table, party_text, district,
    term_start, term_end, term_start_year, term_end_year, dead_link, continued, party_cells; rows that the config drops are left out.
    continued: a short row under the rowspan of the last row that gave a term, whose link it has, and whose district and party if none of its cells has any.
    party_cells: (text, hrefs) of the cells in which a party is looked for: the party's cell, or all of a continued row; hrefs only with party_link.
    With find_date_in_infobox, people and offices are those of infobox_dates; with party_link there are also party_links, the addresses in the party's cell.
    """
    n, excluded = F.size("cells"), F.array().cast("array<string>") if excluded_links is None else excluded_links
    rowspan = config.parse_rowspan
    data = rows.filter((F.col("table_no") == config.table_no) & (F.col("row_index") > 0)).filter(passes_filter(config.filter_column, config.filter_criteria))
    bound = data.select("*", *[mirrored(_col(getattr(config, c)), config.read_right_to_left).alias(c) for c in Config.COLUMNS])
    few = _col(rowspan) & (_col(config.term_end_column) >= 0) & (n <= _col(config.term_end_column))
    bound = bound.withColumns({"few": few, "is_bound": F.lit(True)})
    if _may(config.dynamic_parse):
        dynamic = _col(config.dynamic_parse)
        high = F.greatest("term_end_column", "link_column")
        # not deterministic, so that the filters below do not each compute it anew
        bound = bound.withColumn("found", F.when(dynamic & (F.monotonically_increasing_id() >= 0), found_link_column(F.lit(0), high)))
        bound = bound.withColumn("is_bound", ~dynamic | (F.col("found") >= 0)).filter("few OR is_bound")
        moved = dynamic & F.col("is_bound")
        bound = bound.withColumn("move", F.when(moved & (F.col("link_column") >= 0), F.col("found") - F.col("link_column")).otherwise(0)).withColumns(
            {
                "link_column": F.when(moved, F.col("found")).otherwise(F.col("link_column")),
                "term_start_column": F.when(F.col("term_start_column") < 0, -1).otherwise(F.col("term_start_column") + F.col("move")),
                "term_end_column": F.when(F.col("term_end_column") < 0, -1).otherwise(F.col("term_end_column") + F.col("move")),
                "district_column": F.when(F.col("district_column") <= 0, F.col("district_column")).otherwise(F.col("district_column") + F.col("move")),
                "party_column": F.when(F.col("party_column") <= 0, F.col("party_column")).otherwise(F.col("party_column") + F.col("move")),
            }
        )
    reaches = n > F.col("term_end_column")
    bound = bound.filter(either(rowspan, lambda: n >= 2, lambda: (n >= _col(config.table_rows)) & (reaches | _col(config.find_date_in_infobox))))
    own = F.when(F.col("is_bound"), holder_link(F.col("link_column"), excluded, F.col("term_start_column")))
    linked = bound.withColumn("own_link", own).withColumn("own_district", rules.district(cell(F.col("district_column"))["text"]))
    if _may(rowspan):
        # the last row before that gave a term is the one that a short row goes on
        before = Window.partitionBy(*keys, "table_no").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
        alone = F.col("own_link").isNotNull() & either(config.ignore_non_links, lambda: urls.is_person_link(F.col("own_link")), lambda: F.lit(True))
        linked = linked.withColumn("alone", alone).withColumn("begun", F.coalesce(F.max("alone").over(before), F.lit(False)))
        linked = linked.withColumn("short", F.col("few") & F.col("begun"))
        gives = F.col("alone") & ~F.col("short") & (reaches | ~F.col("begun"))
        probed = F.get(F.filter(F.transform("cells", lambda c: rules.district(c["text"])), lambda d: d != NO_DISTRICT), 0)
        district = F.when(F.col("short"), probed).when(gives, F.coalesce("own_district", F.lit(NO_DISTRICT)))
        linked = linked.withColumns({"given": F.when(gives, F.col("own_link")), "district_here": district, "gives": gives})
        goes_on = F.col("short")
        linked = linked.withColumns(
            {
                "link": F.when(goes_on, F.last("given", True).over(before)).otherwise(F.col("own_link")),
                "kept_district": F.when(goes_on, F.coalesce("district_here", F.last("district_here", True).over(before))).otherwise(F.col("own_district")),
            }
        ).filter(~_col(rowspan) | F.col("short") | F.col("gives"))
    else:
        linked = linked.withColumns({"short": F.lit(False), "link": F.col("own_link"), "kept_district": F.col("own_district")})

    def dated(known: Column) -> Column:
        full = term_dates(F.col("prepared"), F.col("term_start_column"), F.col("term_end_column"), config.years_only, config.term_dates_merged, known)
        if not _may(rowspan):
            return full
        # a short row: the first cell with a range, else two cells of one date each, else the first date
        no = lambda kind: F.lit(None).cast(kind)

        def in_texts() -> Column:
            valid = F.filter(F.transform(F.col("prepared")["ranges"], lambda x: dates.settled_range(x, known)), lambda r: (r["start"] != dates.INVALID) & (r["end"] != dates.INVALID))
            single = lambda k: dates.settled(F.get(F.col("prepared")["singles"], F.lit(k)), known)
            apart = lambda r: (r["start"] != r["end"]) & (r["start"] != dates.INVALID) & (r["end"] != dates.INVALID)
            pairs = F.filter(F.array(*(F.struct(single(k).alias("start"), single(k + 1).alias("end")) for k in (0, 1))), lambda r: F.coalesce(apart(r), F.lit(False)))

            def best(valid: Column) -> Column:
                neither = F.struct(single(0).alias("start"), single(1).alias("end"))
                found = F.coalesce(F.get(F.filter(valid, lambda r: r["start"] != r["end"]), 0), F.get(pairs, 0), F.get(valid, 0), neither)
                return once(found, lambda r: F.struct(r["start"].alias("term_start"), r["end"].alias("term_end"), no("int").alias("term_start_year"), no("int").alias("term_end_year")))

            return once(valid, best)

        def in_years() -> Column:
            years = F.filter(F.transform("cells", lambda c: dates.year_range(c["text_sp"])), lambda r: r["start"].isNotNull() | r["end"].isNotNull())
            first = F.get(years, 0)
            return F.struct(no("string").alias("term_start"), no("string").alias("term_end"), first["start"].alias("term_start_year"), first["end"].alias("term_end_year"))

        return F.when(F.col("short"), either(config.years_only, in_years, in_texts)).otherwise(full)

    # not deterministic, so that it is computed once for the texts and the dates
    prepared = F.when(F.monotonically_increasing_id() >= 0, prepared_dates(F.col("term_start_column"), F.col("term_end_column"), F.col("short"), config))
    linked = linked.withColumn("prepared", prepared)
    in_infobox = _may(config.find_date_in_infobox) and config.years_only is not True and not (isinstance(config.find_date_in_infobox, Column) and people is None)
    asked = _col(config.find_date_in_infobox) & ~_col(config.years_only)
    link_cell, party_cell = cell(F.col("link_column")), cell(F.col("party_column"))
    hrefs = lambda c: either(config.party_link, lambda: F.transform(c["links"], lambda a: a["href"]), lambda: F.array().cast("array<string>"))
    searched = F.when(F.col("short"), F.col("cells")).when(party_cell.isNotNull(), F.array(party_cell)).otherwise(F.slice("cells", 1, 0))
    out = dates.free_forms(linked, loose_texts(F.col("prepared"))).withColumn("dates", dated(F.col("known"))).select(
        *keys,
        "table_no",
        "row_index",
        F.coalesce("link", F.lit(urls.NO_LINK)).alias("wiki_link"),
        F.coalesce(F.get(link_cell["links"], 0)["text"], link_cell["text"]).alias("name_from_table"),
        party_cell["text_sp"].alias("party_text"),
        *([hrefs(party_cell).alias("party_links")] if _may(config.party_link) else []),
        either(config.district_ignore, lambda: F.lit("No District"), lambda: either(config.district_at_large, lambda: F.lit("At-Large"), lambda: F.coalesce("kept_district", F.lit(NO_DISTRICT)))).alias("district"),
        "dates.*",
        urls.is_dead(F.col("link")).alias("dead_link"),
        F.col("short").alias("continued"),
        F.when(~_col(config.party_ignore), F.transform(searched, lambda c: F.struct(c["text_sp"].alias("text"), hrefs(c).alias("hrefs")))).alias("party_cells"),
        *([config.ignore_non_links.alias("strict")] if isinstance(config.ignore_non_links, Column) else []),
        *([F.when(asked, table_years(F.col("term_start_column"), F.col("term_end_column"))).alias("table_years")] if in_infobox else []),
    )
    if in_infobox:
        if people is None or offices is None:
            raise ValueError("find_date_in_infobox needs people and offices")
        out = infobox_dates(out, people, offices, *keys, role=role)
    if isinstance(config.ignore_non_links, Column):
        return out.filter(~F.col("strict") | urls.is_person_link(F.col("wiki_link"))).drop("strict")
    return out.filter(urls.is_person_link(F.col("wiki_link"))) if config.ignore_non_links else out


def extract_units(rows: DataFrame, units: DataFrame, page: str, unit: str, people: DataFrame | None = None, offices: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Term rows of all units in one plan: what `extract` returns, keyed by page and unit.

    rows: the page's key, table_no, row_index, cells; units: the page's key, the unit's, and any fields of Config as columns (a null, or one that
    is not there, has its default).  A page may have many units, and a unit finds nothing if the page lacks its table.  With people and offices
    (keyed by page and unit), units of find_date_in_infobox take their dates from there; without, from the table.
    """
    named = [f.name for f in fields(Config) if f.name in units.columns]
    own = Config.of(F.struct(*named), *named)
    fixed = {f.name: _col(getattr(own, f.name)) for f in fields(Config)}
    configs = units.select(page, unit, F.struct(*(c.alias(name) for name, c in fixed.items())).alias("config"), fixed["table_no"].alias("table_no"))
    joined = rows.select(page, "table_no", "row_index", "cells").join(configs, [page, "table_no"])
    return extract(joined, Config(**{f.name: F.col("config")[f.name] for f in fields(Config)}), page, unit, people=people, offices=offices, role=role)


def unit_rows(pages: DataFrame, units: DataFrame, page: str, max_rows: int | None = None) -> DataFrame:
    """The rows of the tables that units ask for (a null table_no: the first), for extract_units; no other table of a page is built."""
    table = F.coalesce("table_no", F.lit(Config.table_no)) if "table_no" in units.columns else F.lit(Config.table_no)
    wanted = units.select(page, table.alias("_table")).distinct()
    return html.table_rows(pages.join(wanted, page), page, max_rows=max_rows, only=F.col("_table"))


def resolve_parties(terms: DataFrame, parties: DataFrame, country: Column, *keys: str) -> DataFrame:
    """`party` for terms of `extract`: the party of the first of the row's party_cells that has one, by its first address that is a
    party's link, else the first party in the order of names whose name the text contains.

    A continued row without any keeps the party of the row before; other rows have 'No party', and null where the config ignores parties.
    parties: (country, name), a table of names a country, and `link` for a match by links; texts and addresses are matched once each.
    Terms without party_cells have one cell each, of party_text and (if there) party_links; keys, table_no and row_index tell rows apart.
    """
    rows = terms.withColumn("country", country)
    row = [*keys, *(c for c in ("table_no", "row_index") if c in terms.columns)]
    added = [c for c in ("party_cells", "continued") if c not in terms.columns]
    if "party_cells" in added:
        links = F.coalesce("party_links", F.array().cast("array<string>")) if "party_links" in terms.columns else F.array().cast("array<string>")
        rows = rows.withColumn("party_cells", F.array(F.struct(F.col("party_text").alias("text"), links.alias("hrefs"))))
    if "continued" in added:
        rows = rows.withColumn("continued", F.lit(False))
    full = lambda href: dates.without_footnotes(F.concat(F.lit(urls.WIKI_BASE), href))
    party = party_finder(parties)
    if party is None:
        out = _join_parties(rows, parties, row, full)
    else:
        cells = F.transform("party_cells", lambda c: F.struct(F.lower(c["text"]).alias("key"), F.transform(c["hrefs"], full).alias("links")))
        # a plain column, as an argument with nested lambdas is not always taken out of the plan for Python
        plain = rows.withColumn("_cells", F.when(F.monotonically_increasing_id() >= 0, cells))
        out = plain.withColumn("own", party(F.col("country"), F.col("_cells"))).drop("_cells")
    if "continued" in added:
        return out.withColumn("party", F.coalesce("own", F.lit(NO_PARTY))).drop("own", "country", *added)
    here = F.when(F.col("continued"), F.col("own")).otherwise(F.coalesce("own", F.lit(NO_PARTY)))
    before = Window.partitionBy(*keys, "table_no").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.coalesce(F.last(here, True).over(before), F.lit(NO_PARTY))
    return out.withColumn("party", F.when(F.col("party_cells").isNotNull(), carried)).drop("own", "country", *added)


def _join_parties(rows: DataFrame, parties: DataFrame, row: list[str], full: Callable[[Column], Column]) -> DataFrame:
    """The rows with `own`, by joins: for parties that are too many for one block of names."""
    cells = rows.select("country", *row, F.posexplode("party_cells").alias("at", "c")).distinct()
    cells = cells.withColumn("key", F.lower("c.text"))
    texts = cells.select("country", "key").filter("key <> ''").distinct()
    met = first_name_in(texts, parties.select("country", "name"), "country", "key", "by_text")
    found = cells.join(met, ["country", "key"], "left")
    if "link" in parties.columns:
        hrefs = cells.select("country", *row, "at", F.posexplode("c.hrefs").alias("nth", "href"))
        named = parties.filter("link IS NOT NULL").groupBy("country", "link").agg(F.min("name").alias("name"))
        cell_of = ["country", *row, "at"]
        by_link = hrefs.withColumn("link", full(F.col("href"))).join(named, ["country", "link"]).groupBy(*cell_of).agg(F.min_by("name", "nth").alias("by_link"))
        found = found.join(by_link, cell_of, "left").withColumn("by_text", F.coalesce("by_link", "by_text"))
    first = found.filter("by_text IS NOT NULL").groupBy(*row).agg(F.min_by("by_text", "at").alias("own"))
    return rows.join(first, row, "left")


def preview(terms: DataFrame, *keys: str, most: int = 50, years_only: bool = False) -> DataFrame:
    """The first rows of each page, in the order of the table, that an import would take."""
    gate = rules.import_gate(
        F.col("wiki_link"), F.col("term_start"), F.col("term_end"), F.col("term_start_year"), F.col("term_end_year"), F.col("name_from_table"), F.lit(years_only)
    )
    taken = terms.filter(gate["accepted"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("table_no", "row_index"))
    return taken.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def check_config(tables: DataFrame, config: Config, *keys: str) -> DataFrame:
    """(ok, message) for each page: whether the table is there, has rows, and the columns are in range.

    tables: keys and the array of tables of each page.
    """
    table = F.get(F.filter("tables", lambda t: t["table_no"] == config.table_no), 0)
    widest = F.array_max(F.transform(table["rows"], lambda r: F.size(r["cells"])))
    most = max(getattr(config, c) for c in Config.COLUMNS)
    message = (
        F.when(F.size("tables") == 0, "no tables")
        .when(table.isNull(), "table not found")
        .when(F.size(table["rows"]) < 2, "no data rows")
        .when(widest <= most, "column out of range")
        .otherwise("ok")
    )
    return tables.select(*keys, (message == "ok").alias("ok"), message.alias("message"))
