"""Incremental runs: unchanged documents, differences of terms, their application, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from .lookup import nearest

CHANGES = ("new", "changed", "unchanged", "vanished_real", "placeholder")


def changed_documents(pages: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    """Pages whose content hash is not the one stored for their key."""
    hashed = pages.withColumn("html_hash", rules.content_hash(F.col("html")))
    return hashed.join(state.select(*keys, "html_hash"), [*keys, "html_hash"], "left_anti")


def diff(stored: DataFrame, parsed: DataFrame, years_only: bool = False, use_infobox: bool = False) -> DataFrame:
    """change_type for every stored and parsed term of the offices: new, changed, unchanged, vanished_real, placeholder.

    stored: office_id, term_id, wiki_url, term_start, term_end, term_start_year, term_end_year.
    parsed: office_id, row_id, wiki_link, the same four, dead_link.  Returns change_type, office_id, term_id, row_id.
    One shuffle on (office, holder) for the match and one on the term id for what has vanished; the rows matched are computed once.
    """
    start, end = F.col("term_start"), F.col("term_end")
    if not years_only:
        blank = lambda c: c.isNull() | c.isin("", dates.INVALID)
        structural = blank(start) & blank(end) & F.col("term_start_year").isNull() & F.col("term_end_year").isNull()
        parsed = parsed.filter(~structural & ~F.coalesce(end == dates.INVALID, F.lit(False)))
    key = F.when(F.coalesce("dead_link", F.lit(False)), "").otherwise(urls.holder_key(F.col("wiki_link")))
    rows = parsed.withColumn("holder", key)
    year = F.col("term_start_year") if years_only else F.coalesce(dates.year_of(start), F.col("term_start_year"))
    names = ("term_start", "term_end", "term_start_year", "term_end_year")
    new = rows.select("office_id", "row_id", "holder", year.alias("row_year"), *[F.col(c).alias(f"new_{c}") for c in names])
    old_year = F.coalesce(dates.year_of(F.col("term_start")), F.col("term_start_year"))
    old = stored.withColumn("holder", urls.holder_key(F.col("wiki_url"))).filter("holder <> ''").select(
        "office_id", "holder", F.col("term_id"), old_year.alias("old_year"), *[F.col(c).alias(f"old_{c}") for c in names]
    )
    pair = lambda df: df.withColumn("match_key", F.struct("office_id", "holder")).drop("office_id", "holder")
    met = nearest(pair(new), pair(old), "match_key", "row_id", "row_year", "term_id", "old_year")
    differs = rules.term_changed(lambda c: F.col(f"old_{c}"), lambda c: F.col(f"new_{c}"), F.lit(years_only), F.lit(use_infobox))
    kind = F.when(F.col("term_id").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    seen = met.select(kind.alias("change_type"), F.col("match_key.office_id").alias("office_id"), "term_id", "row_id")
    gone = F.when(urls.holder_key(F.col("wiki_url")) == "", "placeholder").otherwise("vanished_real")
    terms = stored.select(F.col("term_id").alias("_term"), F.col("office_id").alias("_office"), gone.alias("_gone"), F.lit(False).alias("_new"))
    # new rows have no term; their own ids spread them over the tasks
    at = seen.withColumns({"_at": F.coalesce("term_id", "row_id"), "_is_new": F.col("term_id").isNull()})
    both = at.join(terms, (F.col("_at") == F.col("_term")) & (F.col("_is_new") == F.col("_new")), "full")
    return both.select(
        F.coalesce("change_type", "_gone").alias("change_type"), F.coalesce("office_id", "_office").alias("office_id"), F.coalesce("term_id", "_term").alias("term_id"), "row_id"
    )


def skipped_holders(changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """The distinct holders (canonical links) of unchanged rows: their infoboxes need not be read again."""
    same = parsed.join(changes.filter("change_type = 'unchanged'").select("row_id"), "row_id", "left_semi")
    linked = ~F.coalesce("wiki_link", F.lit("")).isin("", urls.NO_LINK) & ~urls.is_dead(F.col("wiki_link")) & ~F.coalesce("dead_link", F.lit(False))
    return same.filter(linked).select(urls.canonical_holder(F.col("wiki_link")).alias("holder")).filter("holder <> ''").distinct()


def apply_diff(stored: DataFrame, parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored terms after a run: changed and placeholder rows go, new and changed rows come, vanished ones stay.

    An office whose table gave no rows at all keeps everything.  The changes are read once: each says what becomes of its stored and of its parsed row.
    """
    offices = parsed.select("office_id").distinct().withColumn("_parsed", F.lit(True))
    goes, comes = F.col("change_type").isin("changed", "placeholder"), F.col("change_type").isin("new", "changed")
    steps = F.array(
        F.when(goes, F.struct(F.lit("gone").alias("step"), F.col("term_id").alias("id"))),
        F.when(comes, F.struct(F.lit("added").alias("step"), F.col("row_id").alias("id"))),
    )
    wanted = changes.join(offices, "office_id").select(F.explode(F.array_compact(steps)).alias("s")).select("s.*").distinct()
    columns = [c for c in stored.columns if c in parsed.columns]
    others = [c for c in stored.columns if c not in columns and c not in ("term_id", "wiki_url")]
    old = stored.withColumns({"_step": F.lit("gone"), "_id": F.col("term_id")})
    new = parsed.select(*columns, F.col("wiki_link").alias("wiki_url"), F.lit("added").alias("_step"), F.col("row_id").alias("_id"))
    both = old.unionByName(new, allowMissingColumns=True).join(wanted.withColumn("_met", F.lit(True)), (F.col("_step") == F.col("step")) & (F.col("_id") == F.col("id")), "left")
    met = F.coalesce("_met", F.lit(False))
    kept = both.filter(F.when(F.col("_step") == "gone", ~met).otherwise(met))
    return kept.select(*[c for c in stored.columns if c in columns or c in others or c in ("term_id", "wiki_url")])


def shifted_offices(changes: DataFrame, limit: float = 0.40) -> DataFrame:
    """Offices of whose linked stored terms more than a share has vanished."""
    stored = changes.filter(F.col("change_type").isin("changed", "unchanged", "vanished_real"))
    share = F.count_distinct(F.when(F.col("change_type") == "vanished_real", F.col("term_id"))) / F.count_distinct("term_id")
    return stored.groupBy("office_id").agg(share.alias("vanished_share")).filter(F.col("vanished_share") > limit)


def fill_rate(rows: DataFrame, *keys: str, linked: Column) -> DataFrame:
    """The share of rows with a link."""
    return rows.groupBy(*keys).agg(F.avg(F.when(linked, 1.0).otherwise(0.0)).alias("fill_rate"))


def fill_rate_drops(now: DataFrame, state: DataFrame, *keys: str, limit: float = 0.30) -> DataFrame:
    """Keys whose fill rate has dropped by more than the limit since the stored one; without a stored one there is no alarm."""
    both = now.join(state.select(*keys, F.col("fill_rate").alias("last_rate")), list(keys))
    return both.filter(F.round(F.col("last_rate") - F.col("fill_rate"), 9) > limit)


def expired_jobs(jobs: DataFrame, as_of: Column, queued_hours: int = 12, running_hours: int = 8, full_hours: int = 24) -> DataFrame:
    """Jobs that have waited or run too long, with the reason."""
    hours = (as_of.cast("long") - F.coalesce("started_at", "queued_at").cast("long")) / 3600
    most = F.when(F.col("status") == "queued", queued_hours).when(F.col("mode") == "full", full_hours).otherwise(running_hours)
    reason = F.concat(F.col("status"), F.lit(" for more than "), most.cast("string"), F.lit(" h"))
    return jobs.filter(F.col("status").isin("queued", "running") & (hours > most)).withColumn("reason", reason)


def unseen(links: DataFrame, people: DataFrame, url: str = "wiki_url") -> DataFrame:
    """Distinct links that are not yet people."""
    return links.select(url).distinct().join(people.select(url), url, "left_anti")


def admitted_jobs(jobs: DataFrame, *queue: str, depth: int) -> DataFrame:
    """The queued jobs that a queue of limited depth takes, first in first out; the others are refused.

    A queue is short, so its jobs are ranked in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*queue).orderBy("queued_at", "job_id"))
    return jobs.withColumn("place", rank).withColumn("admitted", F.col("place") <= depth)
