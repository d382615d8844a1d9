"""Dates and years out of messy text, as Column expressions.

Texts that none of the fixed forms has settled go to the free-form parser, which needs Python: an Arrow UDF for
each text (free_form=True), or one for all texts of a row (`free_forms`), whose map the functions take as `known`,
also inside of lambdas.  Everything else is built in.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from .common import once

# Fixed values that results depend on.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
RANGE_DELIMITERS = ("–", "-", " —<br/>", " to ", " – ", ", to ")
SPECIAL_ENDS = ("incumbent", "n/a", "present")
NO_DATE_WORDS = ("present", "n/a", "incumbent", "invalid date")
INVALID = "Invalid date"
FOOTNOTE = r"(?U)\[\w+\]"
PARENTHESES = r"\([^)]*\)"
OLD_STYLE = r"(?i)\s*\[[^\]]*O\.?S\.[^\]]*\]"
MONTH_DAY_WITHOUT_COMMA = rf"(\b(?:{MONTHS})\s+\d{{1,2}})\s+(\d{{4}}\b)"
IN_OFFICE = r"(?i)^in office "

_ISO = r"^\d{4}-\d{2}-\d{2}$"
_BLANKS = " \t\n\x0b\f\r"
_YEAR = r"\b((?:17|18|19|20)\d{2})\b"


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_date(value: Column) -> Column:
    """struct(date, imprecise): the date only in the form YYYY-MM-DD (a form, not a calendar check)."""

    def judged(text: Column) -> Column:
        ok = F.coalesce(text.rlike(_ISO) & ~F.lower(text).isin(*NO_DATE_WORDS), F.lit(False))
        return F.struct(F.when(ok, text).alias("date"), (~ok).alias("imprecise"))

    return once(F.trim(value), judged)


def real_date(value: Column) -> Column:
    """DATE for YYYY-MM-DD that is in the calendar; null else (a bare year is not taken for January 1st)."""
    return F.when(value.rlike(_ISO), value.try_cast("date"))


def _built(day: Column, month: Column, year: Column) -> Column:
    # names of three letters and a bar each
    number = (F.call_function("instr", F.lit(SHORT_MONTHS.lower()), F.lower(F.substring(month, 1, 3))) + 3) / 4
    text = F.concat_ws("-", year, F.lpad(number.cast("int").cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return once(text, lambda t: F.when(t.try_cast("date").isNotNull(), t))


def _found(text: Column, pattern: str, day_first: bool = False) -> Column:
    """The date of the first match, which is read once and cut by place: it ends with the year."""
    bare = lambda c: F.btrim(c, F.lit(_BLANKS))

    def cut(met: Column) -> Column:
        if day_first:
            day = bare(F.substring(met, 1, 2))
            month = bare(F.substring(met, F.length(day) + 1, F.length(met)))
        else:
            day, month = bare(F.substring(F.substring_index(met, ",", 1), -2, 2)), met
        return F.when(met != "", _built(day, month, F.substring(met, -4, 4)))

    return once(F.regexp_extract(text, pattern, 0), cut)


@lru_cache(100_000)
def _parsed(text: str) -> str | None:
    from dateutil.parser import parse

    try:
        return parse(text, default=datetime(2000, 1, 1)).strftime("%Y-%m-%d")
    except (ValueError, TypeError, OverflowError):
        return None


@arrow_udf(T.StringType())
def _free_form(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _parsed(t) for t in texts.to_pylist()], pa.string())


@arrow_udf(T.MapType(T.StringType(), T.StringType()))
def _free_forms(texts: pa.Array) -> pa.Array:
    # each distinct text once; mostly none of a batch gives a date
    parsed = {t: _parsed(t) for t in texts.flatten().unique().to_pylist() if t is not None}
    if not any(parsed.values()):
        return pa.MapArray.from_arrays(pa.array([0] * (len(texts) + 1), pa.int32()), pa.array([], pa.string()), pa.array([], pa.string()))
    found = [{t: d for t in row or () if t is not None and (d := parsed[t]) is not None} for row in texts.to_pylist()]
    return pa.array([list(row.items()) for row in found], pa.map_(pa.string(), pa.string()))


# else the optimizer could move the call into an expression that refers to its map, where Python cannot be called
_free_forms = _free_forms.asNondeterministic()


def free_forms(rows: DataFrame, loose: Column, name: str = "known") -> DataFrame:
    """The rows with a map of the dates of those of the texts in `loose` (see loose_ranges) that the free-form parser takes."""
    # the call gets a column that is not deterministic, so a plain one: arguments with nested lambdas are not always taken out of the plan for Python
    texts = F.when(F.monotonically_increasing_id() >= 0, loose)
    return rows.withColumn(name, texts).withColumn(name, _free_forms(F.col(name)))


def format_date(value: Column, free_form: bool = False, known: Column | None = None) -> Column:
    """'YYYY-MM-DD' or 'Invalid date'; of the fixed forms the first that gives a date wins."""
    if free_form:
        text = F.coalesce(value, F.lit(""))
        return F.coalesce(_fixed(text), _free_form(_loose(text)), F.lit(INVALID))
    return once(F.coalesce(value, F.lit("")), lambda text: _formatted(text, known))


def _fixed(text: Column) -> Column:
    return F.coalesce(
        _found(text, rf"\b({MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})\b"),
        _found(text, rf"\b({SHORT_MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})\b"),
        _found(text, rf"\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\b", day_first=True),
    )


def _hopeless(bare: Column) -> Column:
    return (bare == "") | bare.rlike(r"^(17|18|19|20)\d{2}$")


def _loose(text: Column) -> Column:
    """The text that the free-form parser gets; null if a fixed form settles it."""
    return once(F.trim(text), lambda bare: F.when(~_hopeless(bare) & _fixed(bare).isNull(), bare))


def _judged(text: Column) -> Column:
    """struct(done, loose): what is settled of a text without the free-form parser, and the text that it gets where nothing is."""
    bare = F.trim(text)
    done = F.coalesce(_fixed(text), F.when(_hopeless(bare), INVALID))
    return once(done, lambda done: F.struct(done.alias("done"), F.when(done.isNull(), bare).alias("loose")))


def _as_is(text: Column) -> Column:
    return F.struct(text.alias("done"), F.lit(None).cast("string").alias("loose"))


def settled(x: Column, known: Column | None = None) -> Column:
    """The date of a struct(done, loose); a null has none."""
    iso = lambda bare: F.when(bare.rlike(_ISO), F.date_format(bare.try_cast("date"), "yyyy-MM-dd"))
    return F.coalesce(x["done"], iso(x["loose"]) if known is None else F.try_element_at(known, x["loose"]), F.lit(INVALID))


def settled_range(x: Column, known: Column | None = None) -> Column:
    """struct(start, end) of what prepared_range gives."""
    return F.struct(settled(x["start"], known).alias("start"), settled(x["end"], known).alias("end"))


def _formatted(text: Column, known: Column | None) -> Column:
    return once(_judged(text), lambda x: settled(x, known))


def without_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE, "")


def without_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, PARENTHESES, "")


def _cleaned(value: Column) -> Column:
    def unmarked(text: Column) -> Column:
        bare = F.regexp_replace(without_parentheses(without_footnotes(text)), OLD_STYLE, "")
        return F.trim(F.when(F.contains(text, F.lit("[")) | F.contains(text, F.lit("(")), bare).otherwise(text))

    return F.regexp_replace(once(F.coalesce(value, F.lit("")), unmarked), MONTH_DAY_WITHOUT_COMMA, "$1, $2")


def _halves(text: Column) -> Column:
    """Before, after, and the next part after the first of the delimiters that the text contains; null if there is none."""
    first = F.lit(None).cast("string")
    for d in reversed(RANGE_DELIMITERS):
        first = F.when(F.instr(text, d) > 0, F.lit(d)).otherwise(first)

    def cut(d: Column) -> Column:
        at = F.call_function("instr", text, d)
        rest = F.substring(text, at + F.length(d), F.length(text))
        return F.when(d.isNotNull(), F.array(F.substring(text, F.lit(1), at - 1), rest, F.call_function("substring_index", rest, d, F.lit(1))))

    return once(first, cut)


def _bare_side(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(part), IN_OFFICE, ""))


def _special(part: Column) -> Column:
    """The special word that a part of a range is, without a mark after it; null if it is none."""
    bare = F.trim(F.when(F.contains(part, F.lit("[")), F.regexp_replace(part, r"(?U)\s*\[\s*\w+\s*\]\s*$", "")).otherwise(part))
    return once(bare, lambda bare: F.when(F.lower(bare).isin(*SPECIAL_ENDS), bare))


def _side(part: Column) -> Column:
    return once(_bare_side(part), lambda part: once(_special(part), lambda word: F.when(word.isNotNull(), _as_is(word)).otherwise(_judged(part))))


def prepared_range(value: Column) -> Column:
    """struct(start, end) of struct(done, loose): what date_range knows before the free-form parser, and the texts it leaves to that."""

    def sides(halves: Column) -> Column:
        side = lambda k: F.when(halves.isNull(), _as_is(F.lit(INVALID))).otherwise(_side(F.get(halves, k)))
        return F.struct(side(0).alias("start"), side(2).alias("end"))

    return once(once(_cleaned(value), _halves), sides)


def prepared_single(value: Column) -> Column:
    """struct(done, loose) of a text for single_date."""
    return once(_cleaned(value), lambda text: F.when(F.lower(F.trim(text)).isin(*SPECIAL_ENDS), _as_is(text)).otherwise(_judged(text)))


def loose_ranges(value: Column) -> Column:
    """The texts that date_range leaves to the free-form parser."""
    return once(prepared_range(value), lambda x: F.array(x["start"]["loose"], x["end"]["loose"]))


def loose_singles(value: Column) -> Column:
    """The texts that single_date leaves to the free-form parser."""
    return F.array(prepared_single(value)["loose"])


def date_range(value: Column, free_form: bool = False, known: Column | None = None) -> Column:
    """struct(start, end) of a text such as 'May 1, 1990 – present'; special ends as written.

    With free_form the parts stand more than once in the plan, as a Python function cannot see a lambda's variable.
    """

    if not free_form:
        return once(prepared_range(value), lambda x: settled_range(x, known))
    halves = once(_cleaned(value), _halves)

    def side(k: int) -> Column:
        part = _bare_side(F.get(halves, k))
        return F.when(halves.isNull(), INVALID).otherwise(F.coalesce(_special(part), format_date(part, free_form)))

    return F.struct(side(0).alias("start"), side(2).alias("end"))


def single_date(value: Column, free_form: bool = False, known: Column | None = None) -> Column:
    """One date of a text, or a special word as written."""

    if not free_form:
        return once(prepared_single(value), lambda x: settled(x, known))
    text = _cleaned(value)
    return F.when(F.lower(F.trim(text)).isin(*SPECIAL_ENDS), text).otherwise(format_date(text, free_form))


def _year_in(text: Column) -> Column:
    return _nonempty(F.regexp_extract(text, _YEAR, 1)).try_cast("int")


def year_range(value: Column) -> Column:
    """struct(start, end): a year on each side of the first delimiter; one year alone is both; an open end is null."""

    def judged(text: Column) -> Column:
        return once(F.struct(_year_in(text).alias("any"), _halves(text).alias("halves")), pair)

    def pair(x: Column) -> Column:
        alone = x["any"].isNull() | x["halves"].isNull()
        end = F.lower(F.trim(F.get(x["halves"], 1)))
        return F.struct(
            F.when(alone, x["any"]).otherwise(_year_in(F.get(x["halves"], 0))).alias("start"),
            F.when(alone, x["any"]).when((end == "") | end.isin(*SPECIAL_ENDS), F.lit(None)).otherwise(_year_in(F.get(x["halves"], 1))).alias("end"),
        )

    return once(F.trim(without_footnotes(value)), judged)


def year_of(value: Column) -> Column:
    """The year of a date-like text: its first four digits, else the first 1xxx or 200x-203x in it."""
    text = F.trim(value)
    head = F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4))
    return F.coalesce(head, _nonempty(F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-3][0-9])\b", 1))).try_cast("int")


def weekday_batch(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def month_batch(day: Column, buckets: int = 30) -> Column:
    return F.dayofmonth(day) % buckets
