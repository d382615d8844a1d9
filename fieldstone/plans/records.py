"""Queries on scalar functions and rules, over texts rendered from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from .registry import query

def _day():
    return F.col("o_orderdate").cast("date")



def _long(day):
    return F.date_format(day, "MMMM d, yyyy")


@query(
    "F2 F5 F6",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'Invalid date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders",
)
def dates_single(t):
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, _long(_day()))
        .when(k == 1, F.date_format(_day(), "d MMMM yyyy"))
        .when(k == 2, F.concat(F.date_format(_day(), "MMM d, yyyy"), F.lit("[a]")))
        .when(k == 3, F.concat(F.lit("since "), F.date_format(_day(), "MMMM d yyyy"), F.lit(" (acting)")))
        .when(k == 4, F.concat(F.lit(" "), F.date_format(_day(), "yyyy-MM-dd"), F.lit(" ")))
        .otherwise(F.date_format(_day(), "yyyy"))
    )
    return t("orders").select("o_orderkey", dates.single_date(text).alias("parsed"))


@query(
    "F3 Q13",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS term_start,
       CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') WHEN 1 THEN 'present' ELSE 'Incumbent' END AS term_end FROM orders""",
)
def dates_ranges(t):
    k = F.col("o_orderkey") % 3
    text = (
        F.when(k == 0, F.concat(_long(_day()), F.lit("[1] – "), F.date_format(F.date_add(_day(), 400), "d MMMM yyyy")))
        .when(k == 1, F.concat(F.lit("In office "), _long(_day()), F.lit(" to present (acting)")))
        .otherwise(F.concat(_long(_day()), F.lit("-Incumbent [ t ]")))
    )
    return t("orders").select("o_orderkey", dates.date_range(text).alias("d")).select("o_orderkey", F.col("d.start").alias("term_start"), F.col("d.end").alias("term_end"))


@query(
    "F4",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE year(o_orderdate)::INT END AS start_year,
       CASE o_orderkey % 5 WHEN 0 THEN (year(o_orderdate) + o_orderkey % 7)::INT WHEN 2 THEN year(o_orderdate)::INT ELSE NULL END AS end_year FROM orders""",
)
def year_ranges(t):
    k, y = F.col("o_orderkey") % 5, F.year(_day())
    s = y.cast("string")
    text = (
        F.when(k == 0, F.concat(s, F.lit("[b]–"), (y + F.col("o_orderkey") % 7).cast("string")))
        .when(k == 1, F.concat(s, F.lit("–present")))
        .when(k == 2, F.concat(F.lit("elected "), s))
        .when(k == 3, F.concat(s, F.lit(" to incumbent")))
        .otherwise("no year")
    )
    return t("orders").select("o_orderkey", dates.year_range(text).alias("d")).select("o_orderkey", F.col("d.start").alias("start_year"), F.col("d.end").alias("end_year"))


@query(
    "F1 Q14",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 1 THEN '2020-13-45' END AS normal,
       o_orderkey % 4 > 1 AS imprecise FROM orders""",
)
def normalized_dates(t):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("  "), F.date_format(_day(), "yyyy-MM-dd"))).when(k == 1, "2020-13-45").when(k == 2, "Present")
    return t("orders").select("o_orderkey", dates.normalize_date(text).alias("d")).select("o_orderkey", F.col("d.date").alias("normal"), F.col("d.imprecise").alias("imprecise"))


@query("F7", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE year(o_orderdate)::INT END AS y FROM orders")
def years_of(t):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(_day(), "yyyy-MM-dd")).when(k == 1, _long(_day())).otherwise("soon")
    return t("orders").select("o_orderkey", dates.year_of(text).alias("y"))


@query("F29 P9 I8", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday_batch, (day(o_orderdate) % 30)::INT AS month_batch FROM orders")
def refresh_batches(t):
    return t("orders").select("o_orderkey", dates.weekday_batch(_day()).alias("weekday_batch"), dates.month_batch(_day()).alias("month_batch"))


def _page_url():
    k, name = F.col("c_custkey") % 5, F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))
    return (
        F.when(k == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/"), name))
        .when(k == 1, F.concat(F.lit("http://EN.wikipedia.org./"), name, F.lit("/")))
        .when(k == 2, F.concat(F.lit(" https://en.wikipedia.org/wiki/%28"), name, F.lit("%29+x?action=raw#top")))
        .when(k == 3, F.concat(F.lit("No link:7:"), name))
        .otherwise(F.concat(F.lit("https://example.org/w/index.php?title="), name, F.lit("&redlink=1")))
    )


_NAME = "replace(c_name, '#', '_')"


@query(
    "F9 F10 F11 Q12",
    f"""SELECT c_custkey,
       CASE c_custkey % 5 WHEN 0 THEN '/wiki/' || lower({_NAME}) WHEN 1 THEN '/wiki/' || lower({_NAME}) WHEN 2 THEN '/wiki/(' || lower({_NAME}) || ')+x'
            WHEN 3 THEN 'No link:7:' || {_NAME} ELSE 'https://example.org/w/index.php?title=' || {_NAME} || '&redlink=1' END AS canonical,
       CASE c_custkey % 5 WHEN 0 THEN 'https://en.wikipedia.org/wiki/' || {_NAME} WHEN 1 THEN 'http://EN.wikipedia.org/wiki/' || {_NAME}
            WHEN 2 THEN 'https://en.wikipedia.org/wiki/%28' || {_NAME} || '%29+x?action=raw#top' END AS normal,
       CASE c_custkey % 5 WHEN 0 THEN 'https://en.wikipedia.org/w/rest.php/v1/page/' || {_NAME} || '/html' WHEN 1 THEN 'http://EN.wikipedia.org/w/rest.php/v1/page/' || {_NAME} || '/html'
            WHEN 2 THEN 'https://en.wikipedia.org/w/rest.php/v1/page/(' || {_NAME} || ')+x/html' END AS rest
       FROM customer""",
)
def canonical_links(t):
    u = _page_url()
    return t("customer").select("c_custkey", urls.canonical_holder(u).alias("canonical"), urls.normalize_wiki_url(u).alias("normal"), urls.rest_html_url(u).alias("rest"))


@query(
    "F13 F16 F17",
    f"""SELECT c_custkey, c_custkey % 5 = 4 AS dead,
       CASE WHEN c_custkey % 5 > 2 THEN '' WHEN c_custkey % 5 = 2 THEN '/wiki/(' || lower({_NAME}) || ')+x' ELSE '/wiki/' || lower({_NAME}) END AS holder,
       'No link:' || c_nationkey || ':' || c_name AS placeholder FROM customer""",
)
def holder_keys(t):
    u = _page_url()
    return t("customer").select("c_custkey", urls.is_dead(u).alias("dead"), urls.holder_key(u).alias("holder"), urls.placeholder_key(F.col("c_nationkey"), F.col("c_name")).alias("placeholder"))


@query(
    "F12 F21 H6 H7",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/wiki/' || p_partkey WHEN 1 THEN '/wiki/' || p_partkey WHEN 2 THEN '' ELSE '/x/' || p_partkey END AS alt_path,
       p_partkey % 3 = 0 AS mirror, p_partkey % 3 = 2 AS person FROM part""",
)
def link_kinds(t):
    n = F.col("p_partkey").cast("string")
    k, m = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    alt = F.when(k == 0, n).when(k == 1, F.concat(F.lit("https://en.wikipedia.org/wiki/"), n)).when(k == 2, " None ").otherwise(F.concat(F.lit("/x/"), n))
    site = F.when(m == 0, F.concat(F.lit("https://de.wikiwand.com/"), n)).when(m == 1, F.concat(F.lit("https://notwikiwand.com/"), n)).otherwise("")
    person = F.when(m == 0, "https://en.wikipedia.org/wiki/112th_United_States_Congress").when(m == 1, "https://en.wikipedia.org/wiki/1998").otherwise(F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), n))
    return t("part").select("p_partkey", urls.alt_link_path(alt).alias("alt_path"), urls.is_mirror(site).alias("mirror"), urls.is_person_link(person).alias("person"))


@query(
    "F18 F19 S5",
    """SELECT doc_id, 'dq-' || substr(sha256('office_term|' || doc_id || '|general'), 1, 16) AS dq, sha256(coalesce(text, '')) AS hash,
       substr(sha256('u' || doc_id || '|1|0'), 1, 32) AS cache_key FROM documents""",
)
def fingerprints(t):
    return t("documents").select(
        "doc_id",
        rules.fingerprint("dq", F.lit("office_term"), F.col("doc_id"), F.lit("general")).alias("dq"),
        rules.content_hash(F.coalesce("text", F.lit(""))).alias("hash"),
        rules.cache_key(F.concat(F.lit(" u"), F.col("doc_id").cast("string")), F.lit(1), F.lit(0)).alias("cache_key"),
    )


@query(
    "F22",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'year_as_name' WHEN 1 THEN 'sql_in_name' WHEN 2 THEN 'long_name' WHEN 3 THEN 'sql_in_url,html_in_url' WHEN 4 THEN 'title_in_name' ELSE '' END AS reasons
       FROM customer""",
)
def suspicious_records(t):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, " 1999 ").when(k == 1, "Drop table").when(k == 2, F.repeat(F.lit("x"), 101)).when(k == 4, "The Senator of Rome").otherwise(F.col("c_name"))
    url = F.when(k == 3, "/wiki/select &lt;b").otherwise("/wiki/Senator_X")
    return t("customer").select("c_custkey", F.array_join(rules.suspicious(name, url), ",").alias("reasons"))


@query(
    "F23 Q-b",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'end_before_start' WHEN 1 THEN 'long_span,end_in_future' WHEN 2 THEN 'end_in_future,start_in_future' ELSE '' END AS problems,
       CASE WHEN o_orderkey % 5 < 3 THEN 'bad_dates' WHEN o_orderkey % 5 = 3 THEN 'party_resolution_failure' END AS failure,
       CASE WHEN o_orderkey % 5 = 4 THEN 'incomplete_individual' ELSE 'missing_wiki_url' END AS about FROM orders""",
)
def term_rules(t):
    k, y = F.col("o_orderkey") % 5, F.year(_day())
    a = F.when(k == 2, 2031).otherwise(y)
    b = F.when(k == 0, y - 1).when(k == 1, y + 90).when(k == 2, 2032).when(k == 3, 0).otherwise(y)
    party = F.when(k == 3, "Whig")
    url = F.when(k == 4, "/wiki/x").otherwise("No link:1:x")
    return t("orders").select(
        "o_orderkey",
        F.array_join(rules.bad_years(a, b), ",").alias("problems"),
        rules.first_failure(a, b, party, F.lit(None).cast("long")).alias("failure"),
        rules.check_type(url, F.lit("")).alias("about"),
    )


@query(
    "F24",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'missing_infobox,missing_refs,missing_reflist,missing_references_section,missing_categories' ELSE 'missing_refs,missing_categories' END AS errors,
       CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'unmatched_braces,missing_birth_date_template' END AS warnings FROM documents""",
)
def wikitext_rules(t):
    k = F.col("doc_id") % 3
    text = (
        F.when(k == 0, "{{Infobox officeholder}}<ref>x</ref>== References ==\n{{Reflist}}[[Category:A]]<nowiki>{{</nowiki>| birth_date = {{Birth date|1}}")
        .when(k == 1, "")
        .otherwise("{{infobox officeholder}}\n|birth_date = 1900\n==references==\n{{reflist}} {{")
    )
    return t("documents").select("doc_id", F.array_join(rules.wikitext_errors(text), ",").alias("errors"), F.array_join(rules.wikitext_warnings(text), ",").alias("warnings"))


@query(
    "F20 T8",
    """WITH l AS (SELECT c_nationkey, 'Customer ' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN ' (1990–?)' WHEN 1 THEN ' (?–1999)' ELSE '' END AS label FROM customer)
       SELECT c_nationkey, CASE WHEN count(*) <= 20 THEN string_agg(label, ', ' ORDER BY label) ELSE
              array_to_string(list_sort(list(label))[1:20], ', ') || ' … and ' || (count(*) - 20) || ' more' END AS labels FROM l GROUP BY c_nationkey""",
)
def missing_holder_labels(t):
    k = F.col("c_custkey") % 3
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/Customer_"), F.col("c_custkey").cast("string"))
    label = rules.holder_label(url, F.when(k == 0, "1990"), F.when(k == 1, "1999"))
    return rules.label_lists(t("customer").select("c_nationkey", label.alias("label")), "c_nationkey")


@query(
    "P20 Q20",
    """SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2) AS accepted, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS term_start,
       NULL::VARCHAR AS term_end, CASE WHEN o_orderkey % 6 IN (1, 2) THEN year(o_orderdate)::INT END AS start_year, o_orderkey % 6 = 0 AS end_imprecise FROM orders""",
)
def import_gate(t):
    k = F.col("o_orderkey") % 6
    day, year = F.when(k.isin(0, 3), F.date_format(_day(), "yyyy-MM-dd")).otherwise("Invalid date"), F.when(k.isin(1, 2, 4), F.year(_day()))
    link = F.when(k.isin(3, 4), "No link").otherwise("/wiki/x")
    g = rules.import_gate(link, day, F.lit("present"), year, F.lit(None).cast("int"), F.lit("n"), k == 2)
    return t("orders").select("o_orderkey", g.alias("g")).select("o_orderkey", "g.accepted", "g.term_start", "g.term_end", "g.start_year", "g.end_imprecise")


@query(
    "H20 S11 F15 F33 F27",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || 'th' WHEN 1 THEN 'at-large seat' ELSE 'No district' END AS district,
       (p_partkey % 3 = 0)::INT AS flagged, (p_partkey % 4 - 1)::INT AS idx, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END AS num,
       trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, (p_partkey % 2 * 2)::INT AS n_json FROM part""",
)
def cell_casts(t):
    k = F.col("p_partkey")
    d = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("th"))).when(k % 3 == 1, "at-large seat").otherwise("whole state")
    f = F.when(k % 3 == 0, " yes ").when(k % 3 == 1, "no")
    number = F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a")
    return t("part").select(
        "p_partkey",
        rules.district(d).alias("district"),
        rules.flag(f).alias("flagged"),
        rules.zero_based((k % 4).cast("int")).alias("idx"),
        rules.whole_number(number, 7).alias("num"),
        rules.slug(F.col("p_name")).alias("slug"),
        F.size(rules.json_list(F.when(k % 2 == 1, '["a","b"]').otherwise("oops"))).alias("n_json"),
    )


@query(
    "F30 F31 F28",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7200 >= 3600 THEN (o_orderkey % 7200 // 3600) || 'h ' ELSE '' END ||
       CASE WHEN o_orderkey % 7200 >= 60 THEN (o_orderkey % 3600 // 60) || 'm ' ELSE '' END || (o_orderkey % 60) || 's' AS took,
       3::INT AS changed, true AS imports, (o_orderkey % 2 = 0)::BOOLEAN AS setting FROM orders""",
)
def run_texts(t):
    patch = F.lit("--- a\n+++ b\n+import os\n-x = 1\n+x = 2\n y")
    d = rules.diff_counts(patch)
    on = F.when(F.col("o_orderkey") % 2 == 0, " True ").otherwise("off")
    return t("orders").select(
        "o_orderkey", rules.duration_text(F.col("o_orderkey") % 7200).alias("took"), d["changed"].alias("changed"), d["imports"].alias("imports"), rules.setting(on, "boolean", F.lit(False)).alias("setting")
    )


@query(
    "P19 P22",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'columns must differ' WHEN 1 THEN NULL ELSE 'columns must not be negative' END AS columns_problem,
       CASE p_partkey % 4 WHEN 0 THEN 'federal offices have no state' WHEN 1 THEN 'state offices need a state' WHEN 2 THEN NULL ELSE 'local offices need a state and a city' END AS level_problem FROM part""",
)
def config_rules(t):
    from ..operators.lookup import distinct_columns_problem, level_problem

    k = F.col("p_partkey")
    a, b = F.when(k % 3 == 2, -1).otherwise(2), F.when(k % 3 == 0, 2).otherwise(3)
    level = F.when(k % 4 == 0, "Federal").when(k % 4 == 1, "State").when(k % 4 == 2, "Federal").otherwise("Local")
    state, branch = F.when((k % 4).isin(0, 2, 3), 5), F.when(k % 4 == 2, "Legislative").otherwise("Executive")
    return t("part").select("p_partkey", distinct_columns_problem(a, b, F.lit(0)).alias("columns_problem"), level_problem(level, state, F.lit(None), branch).alias("level_problem"))
