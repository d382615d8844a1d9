"""Rules on single records: suspicious names, impossible terms, article markup, fingerprints, labels, casts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dates import normalize_date, year_of

# Fixed values that results depend on.
SQL_WORDS = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|FROM|WHERE)\b"
HTML_LEFT = r"[<>]|&lt;|&gt;|&amp;"
TITLES = r"(?i)\b(congressman|congresswoman|senator|representative|governor)\b"
LONGEST_NAME, LONGEST_SPAN, LAST_YEAR = 100, 80, 2030


def _messages(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, m if isinstance(m, Column) else F.lit(m)) for test, m in tests]))


def suspicious(name: Column, url: Column) -> Column:
    """The codes of the rules that a record's name and link break, in the order of the rules."""
    name, url = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, url))
    return _messages(
        (name.rlike(r"^\d{4}$"), "year_as_name"),
        (name.rlike(SQL_WORDS), "sql_in_name"),
        (url.rlike(SQL_WORDS), "sql_in_url"),
        (F.length(name) > LONGEST_NAME, "long_name"),
        (url.rlike(HTML_LEFT), "html_in_url"),
        (name.rlike(TITLES), "title_in_name"),
    )


def bad_years(start: Column, end: Column) -> Column:
    """What is wrong with a term's years; zero counts as no year."""
    a, b = F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0))
    return _messages((b < a, "end_before_start"), (b - a > LONGEST_SPAN, "long_span"), (b > LAST_YEAR, "end_in_future"), (a > LAST_YEAR, "start_in_future"))


def first_failure(start: Column, end: Column, party_text: Column, party_id: Column) -> Column:
    """The first rule that fails: bad_dates, party_resolution_failure, or null."""
    unresolved = (F.coalesce(party_text, F.lit("")) != "") & party_id.isNull()
    return F.when(F.size(bad_years(start, end)) > 0, "bad_dates").when(unresolved, "party_resolution_failure")


def check_type(url: Column, name: Column) -> Column:
    """What a check of a record is about."""
    missing = (F.coalesce(url, F.lit("")) == "") | url.startswith("No link:")
    return F.when(missing, "missing_wiki_url").when(F.coalesce(name, F.lit("")) == "", "incomplete_individual").otherwise("general")


# What the markup of an article has to hold, and the names of what it lacks.
WIKITEXT_NEEDS = (
    (r"(?i)\{\{infobox officeholder", "missing_infobox"),
    ("(?i)<ref", "missing_refs"),
    (r"(?i)\{\{reflist", "missing_reflist"),
    (r"(?i)==\s*References\s*==", "missing_references_section"),
    (r"(?i)\[\[Category:", "missing_categories"),
)
NOWIKI = "(?is)<nowiki>.*?</nowiki>"
BIRTH_DATE = r"(?i)\|\s*birth_date\s*=\s*\S"
BORN = r"(?i)\bborn\s+\w"
BIRTH_TEMPLATE = r"(?i)\{\{birth date"


def wikitext_errors(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return _messages(*[(~text.rlike(pattern), name) for pattern, name in WIKITEXT_NEEDS])


def wikitext_warnings(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    shown = F.regexp_replace(text, NOWIKI, "")
    count = lambda s: F.length(shown) - F.length(F.replace(shown, F.lit(s), F.lit(s[0])))
    born = text.rlike(BIRTH_DATE) | text.rlike(BORN)
    return _messages((count("{{") != count("}}"), "unmatched_braces"), (born & ~text.rlike(BIRTH_TEMPLATE), "missing_birth_date_template"))


def fingerprint(prefix: str, *parts: Column) -> Column:
    """prefix-<16 hex digits>; null parts count as empty."""
    raw = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(raw, 256), 1, 16))


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def cache_key(url: Column, table_no: Column, full_page: Column) -> Column:
    """The key of a cached table."""
    return F.substring(F.sha2(F.concat_ws("|", F.trim(url), table_no.cast("string"), full_page.cast("string")), 256), 1, 32)


def holder_label(url: Column, start: Column, end: Column) -> Column:
    """'Name (start–end)' of a stored term."""
    name = F.replace(F.substring_index(F.trim(url), "/", -1), F.lit("_"), F.lit(" "))
    dated = F.concat(name, F.lit(" ("), F.coalesce(start, F.lit("?")), F.lit("–"), F.coalesce(end, F.lit("?")), F.lit(")"))
    return F.when(start.isNotNull() | end.isNotNull(), dated).otherwise(name)


def label_lists(rows: DataFrame, *keys: str, most: int = 20) -> DataFrame:
    """`labels`: the first labels of each key in their order, joined, and how many more there are.

    Tasks keep the first labels of each key among their own rows, so no task gathers all labels of a key.
    """
    salted = rows.withColumn("_salt", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("label"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = salted.withColumn("_rank", rank).filter(F.col("_rank") <= most).groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("label")), 1, most).alias("_first"))
    more = F.when(F.col("_n") > most, F.concat(F.lit(" … and "), (F.col("_n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(counts, list(keys)).select(*keys, F.concat(F.array_join("_first", ", "), more).alias("labels"))


def term_changed(old: Callable[[str], Column], new: Callable[[str], Column], years_only: Column, use_infobox: Column) -> Column:
    """Whether a parsed term says something else than the stored one.

    old and new give the columns term_start, term_end, term_start_year, term_end_year of either side.
    """
    differs = lambda a, b: ~a.eqNullSafe(b)
    end_text = F.lower(F.trim(F.coalesce(new("term_end"), F.lit(""))))
    ended = old("term_end").isNull() & old("term_end_year").isNull() & year_of(new("term_end")).isNotNull() & ~end_text.isin("present", "incumbent", "")
    by_year = differs(new("term_start_year"), old("term_start_year")) | differs(new("term_end_year"), old("term_end_year"))
    infobox = differs(year_of(new("term_start")), F.coalesce(year_of(old("term_start")), old("term_start_year"))) | differs(
        year_of(new("term_end")), F.when(F.coalesce(old("term_end"), F.lit("")) != "", year_of(old("term_end"))).otherwise(old("term_end_year"))
    )
    dates = differs(normalize_date(new("term_start"))["date"], old("term_start")) | differs(normalize_date(new("term_end"))["date"], old("term_end"))
    return F.when(years_only, by_year).when(ended, True).when(use_infobox, infobox).otherwise(dates)


def import_gate(link: Column, start: Column, end: Column, start_year: Column, end_year: Column, name: Column, years_only: Column, include_no_link: bool = False) -> Column:
    """struct(accepted, term_start, term_end, start_imprecise, end_imprecise, start_year, end_year) of a parsed row."""
    linked = ~F.coalesce(link, F.lit("")).isin("", "No link")
    a, b = normalize_date(start), normalize_date(end)
    any_date = a["date"].isNotNull() | b["date"].isNotNull()
    any_year = start_year.isNotNull() | end_year.isNotNull()
    named = F.lit(include_no_link) & (F.coalesce(name, F.lit("")) != "")
    accepted = (linked | F.lit(include_no_link)) & F.when(years_only, any_year).otherwise(any_date | any_year | named)
    by_date = accepted & ~years_only & any_date
    by_year = accepted & (years_only | ~any_date) & any_year
    return F.struct(
        accepted.alias("accepted"),
        F.when(by_date, a["date"]).alias("term_start"),
        F.when(by_date, b["date"]).alias("term_end"),
        (by_date & a["imprecise"]).alias("start_imprecise"),
        (by_date & b["imprecise"]).alias("end_imprecise"),
        F.when(by_year, start_year).alias("start_year"),
        F.when(by_year, end_year).alias("end_year"),
    )


def district(text: Column) -> Column:
    """An ordinal, 'At-large' or 'Territory' district; else 'No district'."""
    ok = text.rlike(r"\b\d+(st|nd|rd|th)\b") | text.rlike("(?i)^(At-large|Territory)")
    return F.when(ok, text).otherwise("No district")


def zero_based(column: Column) -> Column:
    """Columns are configured from 1; 0 means none."""
    return F.when(column > 0, column - 1).otherwise(-1)


def flag(cell: Column) -> Column:
    return F.coalesce(F.upper(F.trim(cell)).isin("TRUE", "1", "YES"), F.lit(False)).cast("int")


def whole_number(cell: Column, default: int) -> Column:
    return F.coalesce(F.trim(cell).try_cast("int"), F.lit(default))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def json_list(text: Column) -> Column:
    """A JSON list of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def setting(value: Column, kind: str, default: Column) -> Column:
    """A stored setting as the type that it is declared with."""
    if kind == "boolean":
        return F.when(value.isNull(), default).otherwise(F.lower(F.trim(value)).isin("1", "true", "yes", "on"))
    return F.coalesce(F.trim(value).try_cast(kind), default)


def duration_text(seconds: Column) -> Column:
    """'1h 2m 3s'."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.concat_ws(" ", F.when(h > 0, F.concat(h, F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m, F.lit("m"))), F.concat(s, F.lit("s")))


def minutes_text(seconds: Column) -> Column:
    """'123m 4s', or '4s' under a minute: hours are not split off."""
    whole = F.floor(seconds)
    return F.concat(F.when(whole >= 60, F.concat(F.floor(whole / 60), F.lit("m "))).otherwise(""), whole % 60, F.lit("s"))


def error_lines(errors: Column) -> Column:
    """An array of structs (url, message) as indented lines, 'None' for no errors; null or empty parts are unknown."""
    part = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    lines = F.transform(errors, lambda e: F.concat(F.lit("  "), part(e["url"], "unknown"), F.lit("\n    "), part(e["message"], "unknown error")))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("None"))


def file_name(name: Column, most: int = 80) -> Column:
    """A name as a file name: runs of white space and of characters that file systems refuse become one underscore; 'office' if nothing is left."""
    clean = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*\s]+', "_")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("office")), 1, most)


def diff_counts(patch: Column) -> Column:
    """struct(changed lines, whether a line touches DDL, whether it imports, whether it changes a signature) of a unified diff."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2})"))
    return F.struct(
        F.size(lines).alias("changed"),
        F.exists(lines, lambda x: x.rlike(r"(?i)\b(create|alter|drop)\s+table\b")).alias("ddl"),
        F.exists(lines, lambda x: x.rlike(r"^[+-]\s*(import|from)\s")).alias("imports"),
        F.exists(lines, lambda x: x.rlike(r"^[+-]\s*(async\s+)?def\s")).alias("signature"),
    )
