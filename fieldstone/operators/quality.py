"""Votes, gates and checks of data quality, as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules, urls


def verdicts(votes: DataFrame, *keys: str, quorum: int = 2) -> DataFrame:
    """votes (keys, provider, is_valid or null, concerns) -> verdict, n_available, concerns (distinct, by provider)."""
    yes, no = F.count_if(F.col("is_valid")), F.count_if(~F.col("is_valid"))
    said = F.array_sort(F.collect_list(F.struct("provider", "concerns")))
    counted = votes.groupBy(*keys).agg(yes.alias("n_valid"), no.alias("n_invalid"), said.alias("said"))
    verdict = (
        F.when(F.col("n_valid") + F.col("n_invalid") < quorum, "insufficient_quorum").when(F.col("n_invalid") == 0, "valid").when(F.col("n_valid") == 0, "invalid").otherwise("disagreement")
    )
    concerns = F.array_distinct(F.flatten(F.transform("said", lambda s: F.coalesce(s["concerns"], F.array().cast("array<string>")))))
    return counted.select(*keys, verdict.alias("verdict"), (F.col("n_valid") + F.col("n_invalid")).alias("n_available"), concerns.alias("concerns"))


def gate(records: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """records (key, full_name, wiki_url) with reasons and result: passed, allowed, skipped or needs_review; without votes allowed."""
    flagged = records.withColumn("reasons", rules.suspicious(F.col("full_name"), F.col("wiki_url")))
    judged = flagged.join(verdicts(votes, key).select(key, "verdict"), key, "left")
    result = (
        F.when(F.size("reasons") == 0, "passed")
        .when(F.col("verdict") == "invalid", "skipped")
        .when(F.col("verdict").isin("disagreement", "insufficient_quorum"), "needs_review")
        .otherwise("allowed")
    )
    return judged.withColumn("result", result)


def new_findings(records: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of the rules on records that are not known yet; numbered_batches puts them in batches.

    records: record_type, record_id, term_start_year, term_end_year, party_text, party_id, wiki_url, full_name.
    """
    kind = rules.check_type(F.col("wiki_url"), F.col("full_name"))
    marked = records.withColumn("fingerprint", rules.fingerprint("dq", F.col("record_type"), F.col("record_id"), kind))
    fresh = marked.join(known.select("fingerprint"), "fingerprint", "left_anti")
    failure = rules.first_failure(F.col("term_start_year"), F.col("term_end_year"), F.col("party_text"), F.col("party_id"))
    return fresh.withColumn("check_type", failure).filter("check_type IS NOT NULL")


def numbered_batches(rows: DataFrame, order: str, buckets: int = 256, size: int = 100) -> DataFrame:
    """`batch`: (bucket, number) of at most `size` rows each, without a global sort."""
    from pyspark.sql import Window

    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(order))
    return bucketed.withColumn("batch", F.floor((rank - 1) / size))


def grouped_failures(failures: DataFrame, known: DataFrame) -> DataFrame:
    """Parse failures (function_name, error_type, wiki_url, snippet) one row a fingerprint, unless reported before: count and shortest snippet."""
    marked = failures.withColumn("fingerprint", rules.fingerprint("pf", F.col("function_name"), F.col("error_type"), F.col("wiki_url")))
    grouped = marked.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.min_by("snippet", F.struct(F.length("snippet"), "snippet")).alias("representative"), F.min("error_type").alias("error_type")
    )
    return grouped.join(known.select("fingerprint"), "fingerprint", "left_anti")


def notable(sources: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """people (key, term_dates) with `is_notable`: two independent sources, one of a government or academic kind, and term dates."""
    independent = (F.coalesce("source_url", F.lit("")) != "") & ~urls.is_mirror(F.col("source_url"))
    kind = F.lower(F.coalesce("source_type", F.lit(""))).isin("government", "academic")
    counts = sources.groupBy(key).agg(F.count_if(independent).alias("n_sources"), F.coalesce(F.max(independent & kind), F.lit(False)).alias("official"))
    dated = F.trim(F.coalesce("term_dates", F.lit(""))) != ""
    joined = people.join(counts, key, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    return joined.withColumn("is_notable", dated & (F.col("n_sources") >= 2) & F.coalesce("official", F.lit(False))).drop("official")


def living(people: DataFrame, terms: DataFrame, key: str, as_of_year: Column, years: int = 80) -> DataFrame:
    """people (key, is_living, death_date) with is_living recomputed: 0 after a death or if the first term began over 80 years ago; never back to 1."""
    from ..functions.dates import real_date

    began = F.coalesce(F.col("term_start_year"), F.year(real_date(F.col("term_start"))))
    first = terms.groupBy(key).agg(F.min(began).alias("first_year"))
    dead = (F.coalesce("death_date", F.lit("")) != "") | (as_of_year - F.col("first_year") > years)
    joined = people.join(first, key, "left")
    return joined.withColumn("is_living", F.when(F.coalesce(dead, F.lit(False)), 0).otherwise(F.col("is_living")))


def page_state(reachable: Column, has_rows: Column, verdict: Column, reparse_verdict: Column) -> Column:
    """What becomes of a page check."""
    return (
        F.when(~reachable, "fetch_failed")
        .when(~has_rows, "no_data")
        .when(verdict == "insufficient_quorum", "skipped_quorum")
        .when(verdict == "valid", "ok")
        .when(verdict == "disagreement", "manual_review")
        .when(reparse_verdict == "valid", "reparse_ok")
        .otherwise("gh_issue")
    )


def successful(rows: DataFrame, *keys: str, linked: Column) -> DataFrame:
    """A parse is a success with a row at least, half of them linked."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.avg(F.when(linked, 1.0).otherwise(0.0)) >= 0.5).alias("success"))


def next_to_check(pages: DataFrame, checks: DataFrame, key: str, seed: int) -> DataFrame:
    """The page that was checked longest ago (never first); ties by a seeded hash."""
    last = checks.groupBy(key).agg(F.max("checked_at").alias("checked_at"))
    return pages.join(last, key, "left").orderBy(F.col("checked_at").asc_nulls_first(), F.xxhash64(F.col(key), F.lit(seed)), key).limit(1)


def open_items(flags: DataFrame, reports: DataFrame) -> DataFrame:
    """What waits for a person: flags under review and reports that are not resolved."""
    a = flags.filter("result = 'needs_review'").select(F.lit("suspect_flag").alias("kind"), F.col("subject"))
    return a.unionByName(reports.filter(~F.coalesce("resolved", F.lit(False))).select(F.lit("report").alias("kind"), "subject"))


def run_counters(rows: DataFrame) -> DataFrame:
    """Counters of a run in one pass: offices, unchanged, terms, distinct links, and biographies by outcome (if rows have a column biography)."""
    counters = _counters("biography" in rows.columns)
    return rows.agg(F.count_distinct("office_id").alias("offices"), *(c.alias(name) for name, c in counters.items()), F.count_distinct("wiki_url").alias("links"))


def _counters(biographies: bool) -> dict[str, Column]:
    kinds = ("ok", "failed", "skipped") if biographies else ()
    plain = {"unchanged": F.count_if(F.col("change_type") == "unchanged"), "terms": F.count("*")}
    return plain | {f"bio_{kind}": F.count_if(F.col("biography") == kind) for kind in kinds}


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and what is counted while they are written: unchanged, terms, linked, bio_ok, bio_failed, bio_skipped.

    rows: change_type, wiki_url, biography (ok, failed, skipped or null).  No further pass: the numbers are those of the
    first action on the rows, by Observation.get.  Distinct counts can't be observed; run_counters has those.
    """
    run = Observation("run_counters")
    linked = F.count_if(F.coalesce(F.col("wiki_url") != "No link", F.lit(False)))
    counters = _counters(True) | {"linked": linked}
    return rows.observe(run, *(c.alias(name) for name, c in counters.items())), run


def eligible(people: DataFrame, most: int = 50) -> DataFrame:
    """The next people to check: those with a placeholder or no link, `most` by their ids."""
    return people.filter(F.col("wiki_url").startswith("No link:") | (F.col("wiki_url") == "")).orderBy("individual_id").limit(most)
