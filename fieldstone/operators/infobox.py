"""Biographies and terms out of person pages: infobox rows, first paragraphs, role queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.common import once


#: Both dates of the one term of a person whose infobox gives none.
PLACEHOLDER = "YYYY-00-00"
# Fixed value: words in the place of a date that are none.
NO_DATES = ("assumed office", "incumbent", "invalid date")


def role_query(raw: Column) -> Column:
    """struct(includes, excludes, error) of a query such as `"judge" -"chief judge"`: phrases of lower-case words, any of
    which, and none of which, a text has to hold; error says what is wrong with the query, null if nothing is.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    quoted = F.regexp_extract_all(text, F.lit('(-?"[^"]*")'), F.lit(1))
    rest = F.trim(F.regexp_replace(text, '-?"[^"]*"', " "))
    phrases = lambda parts: F.filter(F.transform(parts, _words), lambda p: p != "")
    error = (
        F.when(F.exists(quoted, lambda q: _words(q) == ""), "empty quoted part in role query")
        .when(F.contains(rest, F.lit('"')), "unbalanced quote in role query")
        .when(rest.rlike(r"(^|\s)-"), "an exclusion needs a quoted phrase")
    )
    return F.struct(
        phrases(F.concat(F.filter(quoted, lambda q: ~q.startswith("-")), F.array(rest))).alias("includes"),
        phrases(F.filter(quoted, lambda q: q.startswith("-"))).alias("excludes"),
        error.alias("error"),
    )


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def role_matches(text: Column, query: Column) -> Column:
    """Any include and no exclude, as whole words; a text without words matches no query but the empty one, and no text one with an error."""
    space = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    holds = lambda phrases: F.exists(phrases, lambda p: F.contains(space(_words(text)), space(p)))
    free = (F.size(query["includes"]) == 0) & (F.size(query["excludes"]) == 0)
    asked = ((F.size(query["includes"]) == 0) | holds(query["includes"])) & ~holds(query["excludes"]) & (_words(text) != "")
    return query["error"].isNull() & (free | asked)


def biography(page: Column, url: Column, free_form: bool = True) -> Column:
    """struct(full_name, name, birth_date, death_date, page_path): the infobox, else the first paragraph, else null."""

    def last(label: str) -> Column:
        rows = F.filter(page["rows"], lambda r: F.contains(r["label"], F.lit(label)) & r["value"].isNotNull())
        return F.when(F.size(rows) > 0, dates.single_date(F.get(rows, F.size(rows) - 1)["value"], free_form))

    name = dates.without_footnotes(page["name"])
    span = dates.date_range(page["paragraph"], free_form)
    none = F.lit(None).cast("string")
    path = urls.page_path(url).alias("page_path")
    box = F.struct(
        F.coalesce(dates.without_footnotes(page["nickname"]), name).alias("full_name"),
        name.alias("name"),
        last("Born").alias("birth_date"),
        last("Died").alias("death_date"),
        path,
    )
    text = F.struct(
        dates.without_footnotes(page["bold"]).alias("full_name"), none.alias("name"), span["start"].alias("birth_date"), span["end"].alias("death_date"), path
    )
    return F.when(page["has_infobox"], box).when(page["paragraph"].isNotNull(), text)


def slug_variants(path: Column) -> Column:
    """Lower-cased forms under which an office's page is linked: its path, its slug, without List_of_, and Y_X for X_of_Y."""
    slug = F.substring_index(F.regexp_replace(F.trim(path), "/+$", ""), "/", -1)
    listed = slug.startswith("List_of_")
    bare = F.regexp_replace(slug, "^List_of_", "")
    place = F.substring_index(bare, "_of_", -1)
    head = F.regexp_replace(bare, "_of_(?!.*_of_).*$", "")
    first = F.substring_index(head, "_", 1)
    single = (
        F.when(F.lower(first).rlike(".ies$"), F.regexp_replace(first, "(?i)ies$", "y"))
        .when(F.lower(first).rlike("[^s]s$"), F.regexp_replace(first, "(?i)s$", ""))
        .otherwise(first)
    )
    singular = F.concat(single, F.substring(head, F.length(first) + 1, F.length(head)))
    turned = F.concat(place, F.lit("_"), F.when(listed, singular).otherwise(head))
    forms = F.array(F.trim(path), slug, F.when(listed, bare), F.when(F.instr(bare, "_of_") > 0, turned))
    return F.array_distinct(F.transform(F.filter(forms, lambda x: x.isNotNull() & (x != "")), lambda x: F.lower(x)))


def infobox_terms(pages: DataFrame, offices: DataFrame, *keys: str, role: str | None = None, free_form: bool = True) -> DataFrame:
    """Terms of the office of a person (keys, page) from the infobox rows that link to it (keys, office_path).

    Each office may have a role query of its own in a column `role`; then there is a column role_error, and a query with an error finds nothing.
    Without that column the one of the argument holds for all, and an error in it is raised.

    The dates stand in one of the next two rows: a range, or one date (the end is then 'present').  A person without
    an infobox, a row that matches or a date gets one term of the placeholder, with a null `pos`.
    """
    by_office = "role" in offices.columns
    if not by_office:
        wrong = pages.sparkSession.range(1).select(role_query(F.lit(role))["error"]).first()[0]
        if wrong:
            raise ValueError(wrong)
    asked = offices.withColumn("query", role_query(F.col("role") if by_office else F.lit(role)))
    all_rows, at = F.col("page.rows"), F.col("pos")
    rows = pages.select(*keys, "page", F.posexplode("page.rows").alias("pos", "r"))
    ahead = rows.select(*keys, "pos", "r", F.get(all_rows, at + 1)["text"].alias("next1"), F.get(all_rows, at + 2)["text"].alias("next2")).filter(F.size("r.links") > 0)
    linked = ahead.withColumn("link", F.explode("r.links")).withColumn("path", F.lower(urls.infobox_path(F.col("link.href"))))
    wanted = asked.select(*keys, "query", F.explode(slug_variants(F.col("office_path"))).alias("wanted")).distinct()
    linked = linked.withColumn("wanted", F.explode(F.array_distinct(F.array(F.col("path"), F.substring_index("path", "/", -1)))))
    met = linked.join(wanted, [*keys, "wanted"]).filter(role_matches(F.col("r.text"), F.col("query"))).dropDuplicates([*keys, "pos"])

    alone = lambda text: F.regexp_replace(text, r"(?i)^\s*assumed office\s*", "")

    def dated(text: Column, known: Column | None) -> Column:
        bad = lambda c: F.lower(c).isin(*NO_DATES)

        def judged(d: Column) -> Column:
            span = d["span"]
            return F.when(~bad(span["start"]) & ~bad(span["end"]), span).when(~bad(d["alone"]), F.struct(d["alone"].alias("start"), F.lit("present").alias("end")))

        return once(F.struct(dates.date_range(text, known=known).alias("span"), dates.single_date(alone(text), known=known).alias("alone")), judged)

    either = lambda known: F.coalesce(dated(F.col("next1"), known), dated(F.col("next2"), known))
    loose = F.flatten(F.transform(F.array("next1", "next2"), lambda text: F.concat(dates.loose_ranges(text), dates.loose_singles(alone(text)))))
    dated_rows = dates.free_forms(met, loose).withColumn("d", either(F.col("known"))) if free_form else met.withColumn("d", either(None))
    found = dated_rows.filter("d IS NOT NULL")
    terms = found.select(*keys, "pos", F.col("d.start").alias("term_start"), F.col("d.end").alias("term_end"))
    no_date = lambda c: F.coalesce(c, F.lit(PLACEHOLDER)).alias(c)
    people = pages.select(*keys).distinct()
    if by_office:
        people = people.join(asked.groupBy(*keys).agg(F.max("query.error").alias("role_error")), [*keys], "left")
    errors = ["role_error"] if by_office else []
    return people.join(terms, [*keys], "left").select(*keys, "pos", no_date("term_start"), no_date("term_end"), *errors)
