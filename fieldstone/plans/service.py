"""Queries on lists, batches, imports, caches, jobs and repairs over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import diff, lookup, ordered, quality, writes
from ..session import run_folder
from ..sources import files, html
from .registry import query

_TS = "timestamp_ntz"


def _text(c):
    return F.col(c).cast("string")


def _individuals(t):
    k = F.col("c_custkey")
    last = t("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("bio_refreshed_at"))
    url = F.when(k % 11 == 0, F.concat(F.lit("No link:1:"), k.cast("string"))).otherwise(F.concat(F.lit("/wiki/P_"), k.cast("string")))
    return t("customer").join(last, "c_custkey", "left").select(
        k.alias("individual_id"), url.alias("wiki_url"), (k % 9 != 0).cast("int").alias("is_living"), (k % 8 == 0).cast("int").alias("is_dead_link"), (k % 7).alias("bio_batch"), "bio_refreshed_at",
        F.when(k % 3 == 1, "").when(k % 3 == 2, "1950-01-01").alias("birth_date"), F.when(k % 2 == 0, "1999-01-01").alias("death_date"),
    )


_INDIVIDUALS = """WITH i AS (SELECT c_custkey AS individual_id, CASE WHEN c_custkey % 11 = 0 THEN 'No link:1:' || c_custkey ELSE '/wiki/P_' || c_custkey END AS wiki_url, c_custkey % 9 <> 0 AS living,
    c_custkey % 8 = 0 AS dead, c_custkey % 7 AS b, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS bio_refreshed_at,
    CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN '1950-01-01' END AS birth, CASE WHEN c_custkey % 2 = 0 THEN '1999-01-01' END AS death FROM customer)
"""


@query("P11 U2", _INDIVIDUALS + "SELECT 'living' AS kind, wiki_url FROM i WHERE living AND NOT dead AND wiki_url NOT LIKE 'No link:%' UNION ALL SELECT 'dead_link', wiki_url FROM i WHERE dead")
def url_sets(t):
    return lookup.url_sets(_individuals(t))


@query(
    "T2 P11 T7",
    _INDIVIDUALS + "SELECT wiki_url, bio_refreshed_at FROM i WHERE living AND NOT dead AND wiki_url NOT LIKE 'No link:%' AND b = 3 ORDER BY bio_refreshed_at ASC NULLS FIRST, wiki_url LIMIT 50",
)
def refresh_batch(t):
    """The 50 people of a batch that are refreshed next; those never refreshed come first."""
    return lookup.refresh_batch(_individuals(t), 3, 50).select("wiki_url", "bio_refreshed_at")


@query("P10", _INDIVIDUALS + "SELECT individual_id FROM i WHERE birth IS NULL OR (death IS NULL AND NOT living)")
def lacking_vitals(t):
    return _individuals(t).filter(lookup.lacks_vitals()).select("individual_id")


@query(
    "P18",
    _INDIVIDUALS
    + """SELECT o_orderkey % 5 AS office_category_id, count(*) AS matching_records, count(DISTINCT o_custkey) AS matching_individuals,
         count(DISTINCT o_custkey) FILTER (WHERE coalesce(birth, '') = '') AS eligible_individuals FROM orders JOIN i ON individual_id = o_custkey GROUP BY 1""",
)
def matching_people(t):
    terms = t("orders").select((F.col("o_orderkey") % 5).alias("office_category_id"), F.col("o_custkey").alias("individual_id"))
    return lookup.matching_people(terms, _individuals(t), "office_category_id")


@query(
    "T5 T1",
    """SELECT l_orderkey, l_linenumber, s FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN year(l_shipdate)::VARCHAR WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') END AS s FROM lineitem WHERE l_suppkey = 3)
       ORDER BY s DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 100 OFFSET 10""",
)
def office_terms_page(t):
    """A page of one office's terms, latest first; a year stands in for a missing date, and terms with neither come first."""
    k = F.col("l_linenumber") % 3
    terms = t("lineitem").filter("l_suppkey = 3").withColumns({"term_start": F.when(k == 1, F.date_format("l_shipdate", "yyyy-MM-dd")), "term_start_year": F.when(k == 0, F.year("l_shipdate"))})
    s = F.coalesce("term_start", _text("term_start_year"))
    return lookup.page_of(terms, [s.desc_nulls_first(), F.col("l_orderkey"), F.col("l_linenumber")], 100, 10).select("l_orderkey", "l_linenumber", s.alias("s"))


_PAGES = """WITH p AS (SELECT c_custkey AS page_id, c_nationkey AS country_id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS level_id, c_custkey % 2 AS enabled, '/' || c_custkey AS url FROM customer),
o AS (SELECT o_orderkey AS office_id, o_custkey AS page_id, o_orderkey % 50 AS category FROM orders),
f AS (SELECT page_id, n_name AS country, r_name AS level, url, enabled, country_id, (SELECT count(*) FROM o WHERE o.page_id = p.page_id) AS office_count,
      (SELECT count(*) FROM o JOIN lineitem ON l_orderkey = office_id WHERE o.page_id = p.page_id) AS table_count, (SELECT min(office_id) FROM o WHERE o.page_id = p.page_id) AS first_office_id,
      (SELECT bool_or(category = 7) FROM o WHERE o.page_id = p.page_id) AS c7 FROM p LEFT JOIN nation ON country_id = n_nationkey LEFT JOIN region ON level_id = r_regionkey)
"""
_PAGE_COLUMNS = "page_id, country, level, url, office_count, table_count, first_office_id"


@query(
    "P2 T6 J3",
    _PAGES
    + f"""SELECT 'all' AS list, {_PAGE_COLUMNS} FROM f UNION ALL SELECT 'country', {_PAGE_COLUMNS} FROM f WHERE country_id = 3 AND enabled = 0 AND office_count > 0
          UNION ALL SELECT 'category', {_PAGE_COLUMNS} FROM f WHERE c7 UNION ALL SELECT 'without', {_PAGE_COLUMNS} FROM f WHERE office_count = 0
          UNION ALL SELECT 'first', {_PAGE_COLUMNS} FROM (SELECT * FROM f WHERE enabled = 1 ORDER BY coalesce(country, ''), coalesce(level, ''), url LIMIT 30)""",
)
def page_lists(t):
    """Page lists under several filters; the last is sorted by names (none first) and cut to a page."""
    k = F.col("c_custkey")
    pages = t("customer").select(
        k.alias("page_id"), F.col("c_nationkey").alias("country_id"), F.when(k % 4 > 0, k % 4).alias("level_id"), (k % 2).alias("enabled"), F.concat(F.lit("/"), k.cast("string")).alias("url")
    )
    offices = t("orders").select(F.col("o_orderkey").alias("office_id"), F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 50).alias("office_category_id"))
    tables = t("lineitem").select(F.col("l_orderkey").alias("office_id"))
    names = {"country_id": (t("nation"), "n_nationkey", "n_name"), "level_id": (t("region"), "r_regionkey", "r_name")}
    kinds = {
        "all": lookup.page_list(pages, offices, tables, names, {"country_id": 0, "enabled": None}),
        "country": lookup.page_list(pages, offices, tables, names, {"country_id": 3, "enabled": 0}, office_count="gt0"),
        "category": lookup.page_list(pages, offices, tables, names, {}, category=7),
        "without": lookup.page_list(pages, offices, tables, names, {}, office_count="eq0"),
        "first": lookup.page_list(pages, offices, tables, names, {"enabled": 1}, limit=30),
    }
    out = None
    for name, df in kinds.items():
        one = df.select(F.lit(name).alias("list"), "page_id", "country", "level", "url", "office_count", "table_count", "first_office_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("P4", "SELECT a.page_id AS request, CASE WHEN a.page_id % 5 > 0 THEN (SELECT min(page_id) FROM pages b WHERE lower(trim(b.url)) = lower(trim(a.url))) END AS page_id FROM pages a")
def page_by_url(t):
    wanted = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("  "), F.upper("url"), F.lit(" "))).otherwise(" ")
    requests = t("pages").select(F.col("page_id").alias("request"), wanted.alias("url"))
    return lookup.by_url(requests, t("pages").select("page_id", "url"), "url", "page_id").select("request", "page_id")


@query(
    "P23",
    """SELECT 'office' AS kind, l_orderkey AS config_id, l_linenumber AS table_no FROM lineitem WHERE l_suppkey = 5
       UNION ALL SELECT 'table', l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 5 AND l_linenumber = 2""",
)
def saved_configs(t):
    tables = t("lineitem").select(F.col("l_suppkey").alias("office_id"), F.col("l_orderkey").alias("config_id"), F.col("l_linenumber").alias("table_no"))
    one = lambda kind, no: lookup.saved_configs(tables, 5, no).select(F.lit(kind).alias("kind"), "config_id", "table_no")
    return one("office", None).union(one("table", 2))


@query(
    "W10",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN greatest(0, c_custkey % 7 * 30 - 50) END::BIGINT AS previous, CASE WHEN c_custkey % 7 * 30 + 50 < 180 THEN c_custkey % 7 * 30 + 50 END::BIGINT AS next FROM customer""",
)
def page_offsets(t):
    offset = (F.col("c_custkey") % 7 * 30).cast("long")
    return t("customer").select("c_custkey", lookup.offsets(F.lit(180), offset, 50).alias("o")).select("c_custkey", "o.previous", "o.next")


@query(
    "W9",
    """SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_o_orderkey, min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus,
       max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus FROM orders GROUP BY o_custkey""",
)
def first_and_last(t):
    return ordered.first_and_last(t("orders"), "o_custkey", order=F.struct("o_orderdate", "o_orderkey"), columns=("o_orderkey", "o_orderstatus"))


@query("J12", "SELECT n_nationkey, CASE WHEN count(s_suppkey) > 0 THEN string_agg(s_name, ',' ORDER BY s_name) END AS alt_links FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def office_links(t):
    links = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return lookup.with_children(t("nation").select("n_nationkey"), links, "n_nationkey", "l", "s_name").select("n_nationkey", F.array_join("l", ",").alias("alt_links"))


@query(
    "J16",
    """SELECT l_orderkey, l_linenumber, s_name AS supplier, p_name AS part, c_name AS customer, n_name AS nation FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN nation ON n_nationkey = l_linenumber + 20""",
)
def names_of_ids(t):
    rows = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id")), "l_orderkey", "left")
    rows = rows.select("l_orderkey", "l_linenumber", "customer_id", F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("part_id"), (F.col("l_linenumber") + 20).alias("nation_id"))
    dims = {"supplier_id": (t("supplier"), "s_suppkey", "s_name"), "part_id": (t("part"), "p_partkey", "p_name"), "customer_id": (t("customer"), "c_custkey", "c_name"), "nation_id": (t("nation"), "n_nationkey", "n_name")}
    return lookup.with_names(rows, dims).select("l_orderkey", "l_linenumber", "supplier", "part", "customer", "nation")


@query(
    "J14 W4",
    """WITH k AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer)
       SELECT o_orderkey, keeper AS page_id, o_custkey = keeper AS enabled FROM orders JOIN k ON o_custkey = c_custkey""",
)
def relinked_children(t):
    """Pages with the same link: the least id stays enabled, and what points at the others points at it."""
    pages = t("customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit(" "), _text("c_nationkey"), F.lit("/"), "c_mktsegment", F.lit(" ")).alias("url"))
    kept = ordered.keeper(pages, F.trim("url"), "page_id")
    marked = writes.set_where(kept.withColumn("enabled", F.lit(True)), F.col("page_id") != F.col("keeper_id"), {"enabled": F.lit(False)})
    children = t("orders").select("o_orderkey", F.col("o_custkey").alias("page_id"))
    state = children.join(marked.select("page_id", "enabled"), "page_id").select("o_orderkey", "enabled")
    return ordered.relinked(children, kept, "page_id", "page_id").join(state, "o_orderkey").select("o_orderkey", "page_id", "enabled")


@query("A7", "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS keeper_id FROM orders")
def keep_greatest_id(t):
    return ordered.keeper(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.struct("o_custkey", "o_orderstatus"), "o_orderkey", last=True).select("o_orderkey", "keeper_id")


@query(
    "T3",
    """SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY max(epoch(o_orderdate)::BIGINT * 1000000000 + o_orderkey) LIMIT 1""",
)
def page_to_check(t):
    """The page whose last check lies farthest back; the checks' times differ by the order's number."""
    at = (F.col("o_orderdate").cast("timestamp").cast("long") * 1_000_000_000 + F.col("o_orderkey")).alias("checked_at")
    checks = t("orders").select(F.col("o_custkey").alias("c_custkey"), at)
    pages = t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select("c_custkey")
    return quality.next_to_check(pages, checks, "c_custkey", 7).select("c_custkey")


@query(
    "U14",
    """SELECT CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END::BIGINT AS office_id, n_nationkey::INT AS table_id, 1 AS moved FROM nation
       UNION ALL SELECT r_regionkey, r_regionkey, 2 FROM region""",
)
def moved_tables(t):
    """A table moves to another office, but not the only one of an office."""
    tables = t("nation").select(F.col("n_regionkey").cast("long").alias("office_id"), F.col("n_nationkey").cast("int").alias("table_id"))
    alone = t("region").select(F.col("r_regionkey").cast("long").alias("office_id"), F.col("r_regionkey").cast("int").alias("table_id"))
    return writes.move_table(tables, 7, 99).withColumn("moved", F.lit(1)).unionByName(writes.move_table(alone, 3, 99).withColumn("moved", F.lit(2)))


@query("A15", "SELECT l_suppkey, count(*) AS n_rows, 2 * count(*) FILTER (WHERE l_quantity > 25) >= count(*) AS success FROM lineitem GROUP BY l_suppkey")
def parse_success(t):
    return quality.successful(t("lineitem"), "l_suppkey", linked=F.col("l_quantity") > 25)


@query(
    "I4 U7",
    """WITH o AS (SELECT o_custkey % 20 AS office_id, o_orderkey, o_custkey, o_orderdate FROM orders)
       SELECT office_id, o_orderkey AS term_id, strftime(o_orderdate, '%Y-%m-%d') AS term_start FROM o WHERE office_id % 4 = 0 OR o_orderkey % 3 > 0
       UNION ALL SELECT office_id, NULL, strftime(o_orderdate, '%Y-%m-%d') FROM o WHERE office_id % 4 > 0 AND o_orderkey % 3 = 0""",
)
def apply_delta_guard(t):
    """Offices whose table gave no rows keep all they have, placeholders included; in the others, placeholders give way."""
    k, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    link = F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), k.cast("string"))
    none = [F.lit(None).cast("string").alias("term_end"), F.lit(None).cast("int").alias("term_start_year"), F.lit(None).cast("int").alias("term_end_year")]
    office = (F.col("o_custkey") % 20).alias("office_id")
    stored = t("orders").select(office, k.alias("term_id"), F.when(k % 3 == 0, F.concat(F.lit("No link:1:"), k.cast("string"))).otherwise(link).alias("wiki_url"), day.alias("term_start"), *none)
    parsed = t("orders").filter("o_custkey % 20 % 4 > 0").select(office, k.alias("row_id"), link.alias("wiki_link"), day.alias("term_start"), *none, F.lit(False).alias("dead_link"))
    return diff.apply_diff(stored, parsed, diff.diff(stored, parsed)).select("office_id", "term_id", "term_start")


@query(
    "F26 I2",
    """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS change_type, o_orderkey AS term_id FROM orders""",
)
def diff_years(t):
    """Offices that give years only: a term has changed if its years have."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    text = F.lit(None).cast("string")
    link = F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), k.cast("string"))
    stored = t("orders").select(F.lit(1).alias("office_id"), k.alias("term_id"), link.alias("wiki_url"), text.alias("term_start"), text.alias("term_end"), y.alias("term_start_year"), (y + 4).alias("term_end_year"))
    parsed = t("orders").select(
        F.lit(1).alias("office_id"), k.alias("row_id"), link.alias("wiki_link"), text.alias("term_start"), text.alias("term_end"), y.alias("term_start_year"),
        (y + 4 + (k % 4 == 0).cast("int")).alias("term_end_year"), F.lit(False).alias("dead_link"),
    )
    return diff.diff(stored, parsed, years_only=True).select("change_type", "term_id")


@query(
    "I7 U2",
    """SELECT DISTINCT '/wiki/P_' || o_custkey AS holder FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 1""",
)
def skipped_holders(t):
    k = F.col("o_orderkey")
    changes = t("orders").select(F.when(k % 3 == 0, "unchanged").otherwise("changed").alias("change_type"), k.alias("row_id"))
    link = F.when(k % 5 == 0, "No link").otherwise(F.concat(F.lit("/wiki/P_"), _text("o_custkey"), F.when(k % 5 == 1, "?action=edit&redlink=1").otherwise("")))
    return diff.skipped_holders(changes, t("orders").select(k.alias("row_id"), link.alias("wiki_link"), F.lit(False).alias("dead_link")))


@query(
    "I11",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3 AS admitted FROM events""",
)
def admitted_jobs(t):
    jobs = t("events").select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("queued_at"))
    return diff.admitted_jobs(jobs, "user_id", depth=3).select(F.col("job_id").alias("event_id"), "place", "admitted")


@query("Q-b Q-e", "SELECT count(*) AS n, 50::BIGINT AS most, true AS full FROM orders")
def numbered_batches(t):
    """Batches of at most 50, all but the last of each bucket full."""
    numbered = quality.numbered_batches(t("orders").select("o_orderkey"), "o_orderkey", buckets=4, size=50)
    sizes = numbered.groupBy("bucket", "batch").agg(F.count("*").alias("n"))
    last = sizes.groupBy("bucket").agg(F.max("batch").alias("last"))
    return sizes.join(last, "bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.coalesce(F.every((F.col("n") == 50) | (F.col("batch") == F.col("last"))), F.lit(True)).alias("full"))


@query(
    "Q-e",
    """WITH g AS (SELECT o_orderpriority AS fn, o_orderstatus AS et, count(*) AS n FROM orders GROUP BY ALL)
       SELECT 'pf-' || substr(sha256(fn || '|' || et || '|u'), 1, 16) AS fingerprint, n FROM g WHERE et <> 'O'""",
)
def unreported_failures(t):
    f = t("orders").select(F.col("o_orderpriority").alias("function_name"), F.col("o_orderstatus").alias("error_type"), F.lit("u").alias("wiki_url"), F.lit("x").alias("snippet"))
    known = f.filter("error_type = 'O'").select(rules.fingerprint("pf", F.col("function_name"), F.col("error_type"), F.col("wiki_url")).alias("fingerprint")).distinct()
    return quality.grouped_failures(f, known).select("fingerprint", "n")


def _raw(df, headers, **known):
    return df.select(*[known.get(h.lower().replace(" ", "_"), F.lit(None).cast("string")).alias(h) for h in headers])


@query(
    "S8 S10 S11",
    """SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 ELSE 1 END::INT AS table_no, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::INT AS dynamic_parse, c_custkey % 4 > 0 AS ok,
       (SELECT count(*) FROM customer WHERE c_custkey % 4 > 0) AS imported, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS errors FROM customer""",
)
def office_rows(t):
    """Rows of an office file, typed, with what an import counts."""
    k = F.col("c_custkey")
    raw = _raw(
        t("customer"), files.OFFICE_HEADERS, country=F.lit(" X "), name=F.col("c_name"), url=F.when(k % 4 > 0, "/u").otherwise("  "), table_no=F.when(k % 3 == 0, (k % 9).cast("string")).otherwise("n/a"),
        dynamic_parse=F.when(k % 2 == 0, " Yes").otherwise("no"),
    )
    typed = files.offices(raw)
    # one row of counts
    return typed.join(F.broadcast(files.import_counts(typed))).select("name", "table_no", "dynamic_parse", "ok", "imported", "errors")


@query(
    "S9",
    """SELECT 'replaced' AS kind, n_regionkey::VARCHAR AS country, n_name AS name, '/new' AS link FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0
       UNION ALL SELECT 'added', n_regionkey::VARCHAR, n_name, CASE WHEN n_regionkey = 1 THEN '/old' ELSE '/new' END FROM nation WHERE n_regionkey = 1 OR (n_nationkey % 2 = 0 AND n_nationkey % 3 > 0)""",
)
def imported_parties(t):
    """A file that replaces all parties, and one whose new ones are added; rows without a name or a link are not imported."""
    k = F.col("n_nationkey")
    stored = t("nation").filter("n_regionkey = 1").select(_text("n_regionkey").alias("country"), F.col("n_name").alias("name"), F.lit("/old").alias("link"))
    named = {"party_name": F.when(k % 2 == 0, F.concat(F.lit(" "), "n_name")), "party_link": F.when(k % 3 > 0, " /new ").otherwise(" ")}
    typed = files.parties(_raw(t("nation"), files.PARTY_HEADERS, country=_text("n_regionkey"), **named))
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "country", "name", "link")
    return kind("replaced", files.import_parties(stored, typed, overwrite=True)).unionByName(kind("added", files.import_parties(stored, typed)))


@query(
    "S8 S9 S10",
    """SELECT CASE WHEN c_custkey % 5 = 0 THEN 'malformed line' WHEN c_custkey % 5 = 1 THEN 'malformed line' WHEN c_custkey % 7 = 0 THEN 'no Party name' WHEN c_custkey % 11 = 0 THEN 'no Party link' END AS reason,
       count(*) AS n FROM customer GROUP BY ALL""",
)
def file_rejects(t):
    """The lines of a file, written in the run's folder, by the reason why they are not imported; null: they are."""
    k, name = F.col("c_custkey"), F.col("c_name")
    quoted = F.concat(F.lit('"'), name, F.lit(', of ""X"""'))
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("US,"), name))
        .when(k % 5 == 1, F.concat(F.lit("US,"), name, F.lit(",/l,more")))
        .when(k % 7 == 0, "US, ,/l")
        .when(k % 11 == 0, F.concat(F.lit("US,"), quoted, F.lit(",")))
        .otherwise(F.concat(F.lit("US,"), quoted, F.lit(",/l")))
    )
    spark = t("customer").sparkSession
    folder = run_folder(spark, "parties")
    t("customer").select(line.alias("value")).write.text(folder)
    raw = files.read_lines(spark, folder, files.PARTY_HEADERS, header=False)
    return files.rejects(raw, *files.PARTY_HEADERS).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "S12 F27",
    """SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 9 = 0 THEN ['manifest entry must be a JSON object'] ELSE list_filter([
         CASE WHEN p_partkey % 4 = 0 THEN 'missing required keys: source_url, enabled' END,
         CASE p_partkey % 5 WHEN 0 THEN 'html_file must be a non-empty string' WHEN 1 THEN 'html_file must be a relative path' WHEN 2 THEN 'html_file does not exist' END,
         CASE p_partkey % 3 WHEN 0 THEN 'config_json must be a JSON object or array, got string' END,
         CASE p_partkey % 7 WHEN 0 THEN 'expected_json must be a JSON object or array, got void' WHEN 1 THEN 'expected_json must be a JSON object or array, got bigint' END], lambda e: e IS NOT NULL) END, '; ') AS errors FROM part""",
)
def manifest_errors(t):
    """One manifest for each part, with each of the checks' messages among them."""
    k = F.col("p_partkey")
    file = F.when(k % 5 == 0, F.lit(' ')).when(k % 5 == 1, "/tmp/x.html").when(k % 5 == 2, "a/none.html").otherwise("a/1.html")
    fields = [
        F.lit('"name":"t","test_type":"bio"'), F.concat(F.lit('"html_file":"'), file, F.lit('"')), F.when(k % 4 > 0, F.lit('"source_url":null,"enabled":1')),
        F.concat(F.lit('"config_json":'), F.when(k % 3 == 0, F.lit('"{}"')).otherwise("{}")), F.concat(F.lit('"expected_json":'), F.when(k % 7 == 0, "null").when(k % 7 == 1, "5").otherwise("[]")),
    ]
    entry = F.when(k % 9 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    texts = t("part").select("p_partkey", F.concat(F.lit("["), entry, F.lit("]")).alias("text"))
    existing = t("region").select(F.concat(F.lit("a/"), F.col("r_regionkey").cast("string"), F.lit(".html")).alias("path"))
    errors = files.manifest_errors(files.manifest_entries(texts, "text", "p_partkey"), "entry", existing, "path")
    return errors.select("p_partkey", F.array_join("errors", "; ").alias("errors"))


def _entries(t):
    k = F.col("p_partkey")
    return t("part").select(
        k.alias("id"), F.when(k % 5 > 0, F.concat(F.lit("t"), k.cast("string"))).alias("name"), F.when(k % 7 > 0, "bio").otherwise("?").alias("test_type"),
        F.when(k % 3 > 0, "a/b.html").otherwise("../b.html").alias("html_file"), F.lit(None).cast("string").alias("source_url"), F.lit("{}").alias("config_json"), F.lit("[]").alias("expected_json"), F.lit(1).alias("enabled"),
    )


_OK = "p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_partkey % 3 > 0"
_ENTRY = """'{"name":"t' || p_partkey || '","test_type":"bio","html_file":"a/b.html","config_json":"{}","expected_json":"[]","enabled":' || """


@query("S12", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'no name' WHEN p_partkey % 7 = 0 THEN 'unknown test_type' WHEN p_partkey % 3 = 0 THEN 'html_file is not a relative path' END AS problem FROM part")
def manifest_problems(t):
    return files.judged_manifest(_entries(t)).select("id", "problem")


@query(
    "S13",
    f"""SELECT 'imported' AS kind, 't' || p_partkey AS name, {_ENTRY} CASE WHEN {_OK} THEN 1 ELSE 0 END || '}}' AS entry FROM part WHERE ({_OK}) OR p_partkey % 2 = 0
        UNION ALL SELECT 'seeded', 't' || p_partkey, {_ENTRY} '1}}' FROM part WHERE {_OK}
        UNION ALL SELECT 'kept', 't' || p_partkey, {_ENTRY} '0}}' FROM part WHERE p_partkey % 2 = 0""",
)
def manifests(t):
    """Tests after an import that overwrites, after seeding an empty table and one that has rows, as they are exported."""
    entries = files.judged_manifest(_entries(t)).drop("id")
    as_stored = {"name": F.concat(F.lit("t"), _text("id")), "test_type": F.lit("bio"), "html_file": F.lit("a/b.html"), "enabled": F.lit(0)}
    stored = _entries(t).filter("id % 2 = 0").withColumns(as_stored).drop("id")
    kinds = {"imported": files.import_manifest(stored, entries, overwrite=True), "seeded": files.seed_manifest(stored.limit(0), entries), "kept": files.seed_manifest(stored, entries)}
    out = None
    for kind, df in kinds.items():
        one = files.export_manifest(df).select(F.lit(kind).alias("kind"), "name", "entry")
        out = one if out is None else out.unionByName(one)
    return out


@query("S16", "SELECT r_regionkey AS id, CASE WHEN r_regionkey < 2 THEN lower(r_name) ELSE r_name END AS name FROM region")
def seed_rows(t):
    """Reference rows that a table lacks are added; those it has stay as they are."""
    rows = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return files.seeded(rows.filter("id < 2").withColumn("name", F.lower("name")), rows.unionByName(rows), "id")


@query(
    "S5 S6 S20",
    """SELECT page_id, page_id % 3 <> 1 AS hit, CASE page_id % 3 WHEN 0 THEN sha256(html) WHEN 2 THEN sha256('old') END AS content FROM pages""",
)
def cached_pages(t):
    """A third of the pages was written to the cache today, a third 20 days ago; a third is older than 30 days and is fetched again."""
    now = F.lit("2024-05-01").cast(_TS)
    pages = files.cached(t("pages").select("page_id", "url", "html").withColumn("url", F.concat("url", F.lit("#"), _text("page_id"))), F.lit(1), F.lit(False))
    k = F.col("page_id") % 3
    old = pages.select("cache_key", F.lit("old").alias("html"), (now - F.make_interval(days=F.when(k == 1, 40).otherwise(20))).alias("fetched_at"))
    cache = files.live_cache(files.primed_cache(old, pages.filter(k == 0), now), now)
    return files.read_through(pages.select("page_id", "cache_key"), cache).select("page_id", "hit", F.sha2("html", 256).alias("content"))


@query(
    "U11",
    """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 4 = 1 THEN n_name || '*' ELSE n_name END AS name FROM nation WHERE n_nationkey % 4 <> 2
       UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region""",
)
def edited_references(t):
    """Reference rows created, updated and deleted."""
    stored = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    grown = writes.created(stored, t("region").select(F.col("r_name").alias("name")), "id")
    of_nation = F.col("id") <= 24
    edited = writes.set_where(grown, of_nation & (F.col("id") % 4 == 1), {"name": F.concat("name", F.lit("*"))})
    return writes.delete(edited, stored.filter("id % 4 = 2"), "id")


@query(
    "J5",
    """WITH f AS (SELECT p_partkey AS filter_id, p_partkey % 40 AS role_key, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 7 END AS c, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 END AS l, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 END AS b FROM part)
       SELECT c_custkey, (SELECT min(filter_id) FROM f WHERE role_key = c_custkey % 40 AND c IS NOT DISTINCT FROM CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END
         AND l IS NOT DISTINCT FROM CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AND b IS NOT DISTINCT FROM CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 END) AS filter_id FROM customer""",
)
def scoped_filters(t):
    """Filters found by a role and by the scope of three bridges, where none stands for all."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    filters = t("part").select(k.alias("filter_id"), (k % 40).alias("role_key"))
    bridge = lambda name, has, by: t("part").filter(has).select(k.alias("filter_id"), (k % by).alias(name))
    bridges = {"country_id": bridge("country_id", k % 3 > 0, 7), "level_id": bridge("level_id", k % 5 > 0, 4), "branch_id": bridge("branch_id", k % 2 == 0, 3)}
    wanted = t("customer").select("c_custkey", (c % 40).alias("role_key"), F.when(c % 4 > 0, c % 7).alias("country_id"), F.when(c % 3 > 0, c % 4).alias("level_id"), F.when(c % 2 == 0, c % 3).alias("branch_id"))
    return lookup.scoped_filters(wanted, filters, bridges, "filter_id", "role_key").select("c_custkey", "filter_id")


@query("P15", "SELECT event_id FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type = 'click'")
def unresolved_events(t):
    """Changes that are open, and those of a status among the resolved ones; a third have no mark."""
    k = F.col("event_id") % 3
    marked = t("events").withColumn("resolved", F.when(k == 0, 1).when(k == 1, 0))
    of_status = lookup.optional_filters(marked.filter("resolved = 1"), {"event_type": "click", "user_id": None})
    return marked.filter(lookup.unresolved()).select("event_id").union(of_status.select("event_id"))


@query(
    "I13 W7",
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_partkey) % 11 AS missing FROM lineitem GROUP BY ALL),
       b AS (SELECT l_suppkey, l_linenumber AS proposed, missing AS missing_after FROM c WHERE missing < 6 AND l_suppkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY missing, n_rows DESC, l_linenumber) = 1)
       SELECT s_suppkey AS l_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'no terms' WHEN proposed IS NULL THEN 'none better' WHEN s_suppkey % 2 = 0 THEN 'updated' ELSE 'proposed' END AS message,
         CASE WHEN proposed IS NOT NULL AND s_suppkey % 2 = 0 THEN proposed ELSE 9 END::INT AS table_no, proposed::INT AS proposed, CASE WHEN s_suppkey % 5 > 0 THEN 6 END::INT AS missing_before, missing_after
       FROM supplier LEFT JOIN b ON l_suppkey = s_suppkey""",
)
def table_proposals(t):
    k = F.col("l_suppkey")
    scores = t("lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("int").alias("table_no")).agg(F.count("*").alias("n_rows"), (F.count_distinct("l_partkey") % 11).alias("missing"))
    configs = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(9).alias("table_no"), (F.col("s_suppkey") % 5).alias("n_terms"), F.lit(6).alias("current_missing"))
    return ordered.table_proposals(configs, scores, "l_suppkey", "table_no", k % 2 == 0)


@query(
    "F30",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7200 >= 60 THEN (o_orderkey % 7200 // 60) || 'm ' ELSE '' END || (o_orderkey % 60) || 's' AS took,
       CASE o_orderkey % 3 WHEN 0 THEN 'office' ELSE substr('Mayor_of_' || o_orderkey || '_' || repeat('x', 70), 1, 80) END AS file,
       CASE o_orderkey % 2 WHEN 0 THEN 'None' ELSE '  /u' || o_orderkey || chr(10) || '    bad' || chr(10) || '  unknown' || chr(10) || '    unknown error' END AS errors FROM orders""",
)
def report_texts(t):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, " ??? ").otherwise(F.concat(F.lit(' "Mayor: of/ '), k.cast("string"), F.lit(" | "), F.lit("x" * 70), F.lit("?")))
    error = lambda url, message: F.struct(url.alias("url"), message.alias("message"))
    two = F.array(error(F.concat(F.lit("/u"), k.cast("string")), F.lit("bad")), error(F.lit(None).cast("string"), F.lit("")))
    errors = F.when(k % 2 == 1, two).otherwise(F.slice(two, 1, 0))
    return t("orders").select("o_orderkey", rules.minutes_text(k % 7200).alias("took"), rules.file_name(name).alias("file"), rules.error_lines(errors).alias("errors"))


@query("Q-c", _INDIVIDUALS + "SELECT individual_id, wiki_url FROM i WHERE wiki_url LIKE 'No link:%' ORDER BY individual_id LIMIT 50")
def eligible_people(t):
    return quality.eligible(_individuals(t)).select("individual_id", "wiki_url")


@query(
    "S21",
    """SELECT CASE WHEN o_custkey % 6 = 0 THEN 'https://example.org/P ' || o_custkey ELSE 'https://en.wikipedia.org/wiki/P_' || o_custkey END AS url, min(o_orderkey) AS ord, 'P_' || o_custkey AS file
       FROM orders WHERE o_orderkey % 9 > 0 GROUP BY o_custkey""",
)
def first_seen_links(t):
    """Links in several spellings, each page once; blank ones are left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    page = F.when(k % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), c)).when(k % 4 == 1, F.concat(F.lit(" https://en.wikipedia.org/P_"), c)).otherwise(F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), c, F.lit("/")))
    link = F.when(k % 9 == 0, "  ").when(F.col("o_custkey") % 6 == 0, F.concat(F.lit("https://example.org/P "), c)).otherwise(page)
    return files.first_seen(t("orders").select(link.alias("link"), "o_orderkey"), "link", "o_orderkey")


@query(
    "S18",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 + c_custkey % 2 END::INT AS n_tables, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 > 0 THEN 'a b|' || c_name || ';a b|2' ELSE '' END AS shown FROM customer""",
)
def raw_table_preview(t):
    """The first two data rows of the second table, where a page has one."""
    k = F.col("c_custkey")
    second = F.concat(F.lit("<table><tr><th>h<th>i<tr><td> a\nb <td>"), "c_name", F.lit("<tr><td>a\nb<td>2<tr><td>3<td>4</table>"))
    page = F.when(k % 5 > 0, F.concat(F.lit("<p>x</p><table><tr><td>1</table>"), F.when(k % 2 == 1, second).otherwise("")))
    # dealt before they are rendered: the table is small in bytes, so that few tasks would read it and parse all pages
    customers = t("customer").select("c_custkey", "c_name").repartition("c_custkey")
    shown = html.table_preview(customers.select("c_custkey", page.alias("html")), "c_custkey", table_no=2, rows=2)
    return shown.select("c_custkey", "n_tables", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("shown"))
