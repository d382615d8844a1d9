"""Queries on filters, joins, aggregates, ordered logic, writes, differences and quality over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import diff, lookup, ordered, quality, writes
from .registry import query

def _day():
    return F.col("o_orderdate").cast("date")

_AS_OF = "1998-06-01"


@query(
    "J1 J2 P14",
    f"""SELECT o_orderkey, c_name, n_name, r_name, strftime(o_orderdate, '%Y-%m-%d') AS term_start FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
        WHERE o_orderkey % 4 <> 0 AND o_orderdate::DATE BETWEEN DATE '{_AS_OF}' - 90 AND DATE '{_AS_OF}'""",
)
def recent_term_starts(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(_day(), "yyyy")).otherwise(F.date_format(_day(), "yyyy-MM-dd"))
    terms = t("orders").select("o_orderkey", "o_custkey", text.alias("term_start"))
    star = lookup.recent(terms, "term_start", F.lit(_AS_OF).cast("date")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    star = star.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return star.select("o_orderkey", "c_name", "n_name", "r_name", "term_start")


@query(
    "P12 A3",
    """SELECT n_nationkey, n_name FROM nation WHERE (n_nationkey % 3 <> 0 OR n_regionkey = 1) AND (n_nationkey % 4 <> 0 OR n_nationkey % 8 = 0)""",
)
def scope_filter(t):
    n = t("nation")
    regions = n.filter("n_nationkey % 3 = 0").select("n_nationkey", F.col("n_regionkey").alias("level"))
    branches = n.filter("n_nationkey % 4 = 0").select("n_nationkey", (F.col("n_nationkey") % 8).alias("branch"))
    return lookup.in_scope(n, {"level": (regions, 1), "branch": (branches, 0)}, "n_nationkey").select("n_nationkey", "n_name")


@query(
    "A1 A2 A3 A4 J3",
    """SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_parts,
       (SELECT min(l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS first_order FROM supplier""",
)
def page_list_counts(t):
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"), F.min("l_orderkey").alias("first_order"))
    return t("supplier").join(counts, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "first_order")


@query(
    "P1 P3 T1",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%er#0%1%' AND contains(lower(c_name), '01') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 3""",
)
def filtered_page(t):
    rows = lookup.optional_filters(t("customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, {"c_name": "01", "c_mktsegment": None})
    rows = rows.filter(F.col("c_name").ilike("%er#0%1%"))
    return lookup.page_of(rows, [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 3).select("c_custkey", "c_name", "c_acctbal")


@query("P7 T7", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '11') OR contains(c_mktsegment, '11') ORDER BY c_custkey LIMIT 20")
def search_two_columns(t):
    return lookup.search(t("customer"), "11", "c_name", "c_mktsegment", key="c_custkey").select("c_custkey", "c_name")


@query(
    "P8 P9",
    """SELECT c_custkey, max(o_orderdate) AS checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
       HAVING (max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '2000-06-01' - INTERVAL 30 DAY) AND c_custkey % 30 = 7""",
)
def cooldown_batch(t):
    """The customers of a batch whose last order is old, or who have none."""
    return _cooldown(t, t("orders"))


def _cooldown(t, orders):
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("checked"))
    rows = lookup.batch(t("customer"), "c_custkey", 30, 7).join(last, "c_custkey", "left")
    return lookup.stale(rows, "checked", F.lit("2000-06-01").cast("timestamp_ntz"), 30).select("c_custkey", "checked")


@query("P5 P6 J6 J7 U2", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AND c_nationkey IN (1, 2, 3) AND c_name LIKE 'Customer#%'")
def people_without_terms(t):
    people = t("customer").filter(F.col("c_nationkey").isin(1, 2, 3) & F.col("c_name").startswith("Customer#"))
    return people.join(t("orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J9 H19", """WITH names AS (SELECT DISTINCT substr(p_name, 1, 5) AS name FROM part)
    SELECT p_partkey, (SELECT min(name) FROM names WHERE contains(lower(p_type || ' ' || p_name), lower(name))) AS name FROM part""")
def names_in_texts(t):
    """The first of the names of all parts, cut short, that a part's text holds."""
    text = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    parts = t("part").select("p_partkey", F.lit("x").alias("scope"), text.alias("key"))
    names = t("part").select(F.lit("x").alias("scope"), F.substring("p_name", 1, 5).alias("name"))
    found = lookup.first_name_in(parts.select("scope", "key").distinct(), names, "scope", "key", "name")
    return parts.join(found, ["scope", "key"], "left").select("p_partkey", "name")


@query(
    "P13 J4 J13",
    """SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       WHERE l_returnflag = 'R' AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'""",
)
def enabled_units(t):
    on = lambda c, v: (F.col(c) == v).cast("int").alias("enabled")
    tables = t("lineitem").select(F.col("l_orderkey").alias("office_id"), "l_linenumber", on("l_returnflag", "R"))
    offices = t("orders").select(F.col("o_orderkey").alias("office_id"), F.col("o_custkey").alias("page_id"), on("o_orderstatus", "F"))
    pages = t("customer").select(F.col("c_custkey").alias("page_id"), on("c_mktsegment", "BUILDING"))
    return lookup.enabled_units(tables, offices, pages).select(F.col("office_id").alias("l_orderkey"), "l_linenumber", F.col("page_id").alias("o_custkey"))


@query(
    "J9 H19 Q24",
    """WITH p(name) AS (VALUES ('BRASS'), ('ANODIZED'), ('STEEL'), ('PLATED'), ('TIN'))
       SELECT p_partkey, coalesce((SELECT min(name) FROM p WHERE contains(lower(p_type), lower(name))), 'No party') AS party FROM part""",
)
def party_contains(t):
    from ..operators.extract import resolve_parties

    parts = t("part").select("p_partkey", F.col("p_type").alias("party_text"))
    parties = parts.sparkSession.createDataFrame([("x", n) for n in ("BRASS", "ANODIZED", "STEEL", "PLATED", "TIN")], "country string, name string")
    return resolve_parties(parts, parties, F.lit("x"), "p_partkey").select("p_partkey", "party")


@query(
    "J8 J16",
    """WITH l AS (SELECT n_regionkey, n_nationkey, n_name AS k FROM nation UNION ALL SELECT n_regionkey, n_nationkey, '/wiki/' || n_name FROM nation),
       c AS (SELECT c_custkey, n_regionkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '/wiki/' || n_name END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT c_custkey, min(n_nationkey) AS party_id FROM c LEFT JOIN l ON c.n_regionkey = l.n_regionkey AND v = k GROUP BY c_custkey""",
)
def party_ids(t):
    n = t("nation").withColumn("link", F.concat(F.lit("/wiki/"), "n_name"))
    c = t("customer").join(n.select("n_nationkey", "n_regionkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", "n_regionkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit(" /wiki/"), "n_name")).alias("v"))
    return lookup.by_either_key(rows, n, "v", "n_regionkey", "n_nationkey", ("n_name", "link"), "party_id").select("c_custkey", "party_id")


@query(
    "J5",
    """SELECT a.p_partkey, count(*) AS n FROM (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS s FROM part) a
       JOIN (SELECT n_nationkey, CASE WHEN n_regionkey % 3 > 0 THEN n_regionkey % 3 END AS s FROM nation) b ON a.s IS NOT DISTINCT FROM b.s GROUP BY a.p_partkey""",
)
def null_safe_scope(t):
    key = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 3).alias("s")
    counts = t("nation").groupBy(key("n_regionkey")).count()
    a = t("part").select("p_partkey", key("p_size"))
    return a.join(counts, a["s"].eqNullSafe(counts["s"])).select("p_partkey", F.col("count").alias("n"))


@query(
    "J11 J10",
    """WITH r AS (SELECT o_custkey, o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) + o_orderkey % 3 END AS y FROM orders WHERE o_orderkey % 2 = 0),
       s AS (SELECT o_custkey, o_orderkey AS term_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate) END AS sy FROM orders WHERE o_orderkey % 2 = 1),
       j AS (SELECT row_id, term_id, row_number() OVER (PARTITION BY row_id ORDER BY abs(y - coalesce(sy, 0)) ASC NULLS FIRST, term_id) AS n FROM r LEFT JOIN s USING (o_custkey))
       SELECT row_id, term_id FROM j WHERE n = 1""",
)
def nearest_match(t):
    y, k = F.year(_day()), F.col("o_orderkey")
    rows = t("orders").filter(k % 2 == 0).select("o_custkey", k.alias("row_id"), F.when(k % 7 != 0, y + k % 3).alias("row_year"))
    stored = t("orders").filter(k % 2 == 1).select("o_custkey", k.alias("term_id"), F.when(k % 5 != 0, y).alias("stored_year"))
    return lookup.nearest(rows, stored, "o_custkey", "row_id", "row_year", "term_id", "stored_year").select("row_id", "term_id")


@query(
    "J15",
    """SELECT c.c_custkey, min(p.c_custkey) AS placeholder_id FROM customer c LEFT JOIN customer p ON c.c_nationkey = p.c_nationkey AND lower(p.c_mktsegment) = lower(c.c_mktsegment) AND p.c_custkey % 10 = 0 GROUP BY c.c_custkey""",
)
def placeholders_by_name(t):
    c = t("customer")
    holes = c.filter("c_custkey % 10 = 0").select(F.concat(F.lit("No link:"), F.col("c_nationkey").cast("string"), F.lit(": "), "c_mktsegment").alias("wiki_url"), F.col("c_custkey").alias("individual_id"))
    rows = c.select("c_custkey", F.col("c_nationkey").cast("long").alias("office_id"), F.lower("c_mktsegment").alias("name"))
    return lookup.placeholders_like(holes, rows, "office_id", "name").select("c_custkey", "placeholder_id")


@query("A5 A8", "SELECT l_suppkey, l_returnflag, count(*) AS n, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t):
    return t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses")).filter("n > 1")


@query(
    "A6 F25",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR 2078 - min(year(o_orderdate)) > 80 THEN 0 ELSE 1 END::INT AS is_living, min(year(o_orderdate))::INT AS first_year
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def living_flag(t):
    people = t("customer").select("c_custkey", F.lit(1).alias("is_living"), F.when(F.col("c_custkey") % 9 == 0, "1999-01-01").alias("death_date"))
    k = F.col("o_orderkey") % 2 == 0
    terms = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(k, F.year(_day())).alias("term_start_year"), F.when(~k, F.date_format(_day(), "yyyy-MM-dd")).alias("term_start"))
    return quality.living(people, terms, "c_custkey", F.lit(2078)).select("c_custkey", "is_living", "first_year")


@query(
    "W1 A18 Q16",
    """WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS s FROM orders),
       f AS (SELECT *, CASE WHEN lag(s + 30) OVER w IS NULL OR s - lag(s + 30) OVER w > 60 THEN 1 ELSE 0 END AS n FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY s, o_orderkey)),
       i AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS island FROM f)
       SELECT o_custkey, island::BIGINT AS island, min(s)::INT AS s, max(s + 30)::INT AS e, count(*) AS n_rows, min_by(o_orderkey, (s, o_orderkey)) AS first_order FROM i GROUP BY o_custkey, island""",
)
def gaps_islands_days(t):
    s = F.unix_date(_day())
    rows = t("orders").select("o_custkey", "o_orderkey", s.alias("s"), (s + 30).alias("e"), F.col("o_orderkey").alias("first_order"))
    runs = ordered.islands(rows, "o_custkey", start=F.col("s"), end=F.col("e"), order=F.col("o_orderkey"), gap=60)
    return ordered.merged(runs, "o_custkey", start="s", end="e", order="o_orderkey", carried=("first_order",))


@query(
    "W2",
    """WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events)
       SELECT user_id, event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM v""",
)
def carry_forward(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("v"))
    return ordered.carry_forward(rows, "v", "user_id", order="event_id")


@query(
    "W3",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45
       UNION ALL SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity <= 45) WHERE n = 1""",
)
def dedupe_first(t):
    keys = [F.col(c) for c in ("l_suppkey", "l_returnflag", "l_linenumber")]
    return ordered.first_of_key(t("lineitem"), *keys, order=[F.col("l_orderkey"), F.col("l_linenumber")], comparable=F.col("l_quantity") <= 45).select("l_orderkey", "l_linenumber")


@query("A7", "SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(coalesce(text, ''))) AS keeper_id FROM documents")
def keep_least_id(t):
    return ordered.keeper(t("documents").select("doc_id", "text"), F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256), "doc_id").select("doc_id", "keeper_id")


@query("W5", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(t):
    return ordered.latest(t("events"), "user_id", order=F.struct("ts", "event_id"), columns=("event_id", "event_type"))


@query(
    "W7 A17 Q9",
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_partkey) % 11 AS missing FROM lineitem GROUP BY ALL),
       b AS (SELECT l_suppkey, l_linenumber AS table_no, missing, n_rows, row_number() OVER (PARTITION BY l_suppkey ORDER BY missing, n_rows DESC, l_linenumber) AS n FROM c WHERE missing < 6)
       SELECT l_suppkey, table_no, missing, n_rows FROM b WHERE n = 1""",
)
def table_shift_pick(t):
    scores = t("lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("table_no")).agg(F.count("*").alias("n_rows"), (F.count_distinct("l_partkey") % 11).alias("missing"))
    return ordered.best_candidate(scores.withColumn("current_missing", F.lit(6)), "l_suppkey", candidate="table_no")


@query(
    "A17 I13",
    """SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 3 = 0) AS missing FROM customer GROUP BY c_nationkey""",
)
def missing_holders(t):
    stored = t("customer").select("c_nationkey", F.col("c_name").alias("holder"), "c_custkey")
    return ordered.missing_holders(stored, stored.filter("c_custkey % 3 <> 0"), "c_nationkey", holder="holder")


@query(
    "W7 A17 I5 I13",
    """WITH p AS (SELECT l_suppkey, l_linenumber AS table_no, 'P_' || l_partkey AS h, 'P_' || (l_partkey % 50) AS c FROM lineitem),
       s AS (SELECT l_suppkey, 'P_' || l_partkey AS h, 'P_' || (l_partkey % 50) AS c FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 2),
       n AS (SELECT l_suppkey, count(DISTINCT h) AS n_stored, count(DISTINCT c) AS n_coarse FROM s GROUP BY ALL),
       t AS (SELECT l_suppkey, table_no, count(*) AS n_rows FROM p GROUP BY ALL),
       e AS (SELECT l_suppkey, table_no, count(*) AS had FROM (SELECT DISTINCT l_suppkey, table_no, h FROM p SEMI JOIN s USING (l_suppkey, h)) GROUP BY ALL),
       y AS (SELECT l_suppkey, table_no, count(*) AS had_c FROM (SELECT DISTINCT l_suppkey, table_no, c FROM p SEMI JOIN s USING (l_suppkey, c)) GROUP BY ALL),
       x AS (SELECT l_suppkey, table_no, n_rows, n_stored, n_stored - coalesce(had, 0) AS m, n_coarse - coalesce(had_c, 0) AS mc FROM t JOIN n USING (l_suppkey) LEFT JOIN e USING (l_suppkey, table_no) LEFT JOIN y USING (l_suppkey, table_no)),
       own AS (SELECT s_suppkey AS l_suppkey, 1 + s_suppkey % 9 AS current, n.n_stored, coalesce(m, n.n_stored) AS missing_before, coalesce(mc, n.n_stored) AS coarse_before
               FROM supplier JOIN n ON n.l_suppkey = s_suppkey LEFT JOIN x ON x.l_suppkey = s_suppkey AND table_no = 1 + s_suppkey % 9),
       a AS (SELECT * FROM own WHERE missing_before > 0.4 * n_stored),
       r AS (SELECT l_suppkey, table_no, m, row_number() OVER (PARTITION BY l_suppkey ORDER BY m, mc, CASE WHEN m = 0 AND mc = 0 THEN 0 ELSE -n_rows END, table_no) AS k
             FROM a JOIN (SELECT * EXCLUDE n_stored FROM x) x USING (l_suppkey) WHERE table_no <> current AND (m < missing_before OR (m = missing_before AND mc < coarse_before)))
       SELECT l_suppkey, current::INT AS current, missing_before, table_no AS found, m AS missing_after FROM a LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (l_suppkey)""",
)
def shifted_tables(t):
    """Offices whose table lacks over 40 % of their holders, and the table of their page that lacks fewest."""
    keys = {"h": F.concat(F.lit("P_"), F.col("l_partkey").cast("string")), "c": F.concat(F.lit("P_"), (F.col("l_partkey") % 50).cast("string"))}
    parsed = t("lineitem").select("l_suppkey", F.col("l_linenumber").alias("table_no"), *(v.alias(k) for k, v in keys.items()))
    stored = t("lineitem").filter("l_returnflag = 'R' OR l_linenumber = 2").select("l_suppkey", *(v.alias(k) for k, v in keys.items()))
    current = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), (1 + F.col("s_suppkey") % 9).cast("int").alias("table_no"))
    return ordered.shifted_tables(ordered.table_scores(stored, parsed, "l_suppkey", "table_no", "h", "c"), current, "l_suppkey", "table_no")


@query(
    "W8",
    """WITH r AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, bool_or(bool_or(l_linenumber = 1)) OVER (PARTITION BY l_orderkey) AS moved FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT l_orderkey, CASE WHEN moved AND l_linenumber < 3 THEN 3 - l_linenumber ELSE l_linenumber END::INT AS l_linenumber, p FROM r""",
)
def renumbered_tables(t):
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    moves = rows.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit(2).alias("new_number"))
    return ordered.renumbered(rows, moves, "l_orderkey", number="l_linenumber")


@query(
    "U4 U5 Q6",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 100 ELSE c_nationkey END::INT AS c_nationkey FROM customer
       UNION ALL SELECT c_custkey + 1000000, c_name || '!', NULL FROM customer WHERE c_custkey % 50 = 0""",
)
def upsert_people(t):
    stored = t("customer").select("c_custkey", "c_name", "c_nationkey")
    new = stored.filter("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, F.col("c_nationkey") + 100).alias("c_nationkey"))
    more = stored.filter("c_custkey % 50 = 0").select(F.col("c_custkey") + 1_000_000, F.concat("c_name", F.lit("!")), F.lit(None).cast("int"))
    return writes.upsert(stored, new.union(more), "c_custkey", keep_old_where_null=True)


@query(
    "U3 Q1",
    """WITH s AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT END AS y, min(o_orderkey) AS v FROM orders GROUP BY ALL)
       SELECT k, y, CASE WHEN k % 5 = 0 THEN -v ELSE v END AS v FROM s""",
)
def upsert_terms(t):
    k = F.col("o_orderkey")
    stored = t("orders").groupBy(F.col("o_custkey").alias("k"), F.when(k % 2 == 0, F.year(_day())).alias("y")).agg(F.min(k).alias("v"))
    return writes.upsert(stored, stored.filter("k % 5 = 0").withColumn("v", -F.col("v")), "k", "y")


@query(
    "U6 U7 U9 U10",
    """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS name FROM nation WHERE NOT (n_nationkey < 10 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0))
       UNION ALL SELECT 100, 'NEW'""",
)
def guarded_writes(t):
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    used = t("supplier").filter("s_suppkey % 5 = 0").select(F.col("s_nationkey").cast("long").alias("nation_id"))
    left, _ = writes.delete_unreferenced(n, n.filter("id < 10"), "id", {"nation_id": used})
    marked = writes.set_where(left, F.col("id") % 2 == 0, {"name": F.lit("even")})
    new = n.sparkSession.createDataFrame([(100, "NEW"), (100, "NEW"), (11, "OLD")], "id long, name string")
    return writes.insert_ignore(marked, new, "id")


@query(
    "U8 W4",
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 ELSE o_custkey END AS individual_id FROM orders""",
)
def superseded_people(t):
    people = t("customer").select(F.col("c_custkey").alias("individual_id"))
    moves = people.filter("individual_id % 10 = 1").select((F.col("individual_id") - 1).alias("placeholder_id"), "individual_id")
    terms = t("orders").select("o_orderkey", F.col("o_custkey").alias("individual_id"))
    return writes.superseded(terms, people, moves)[0].select("o_orderkey", "individual_id")


@query(
    "U1 P15 P16 P17 T1",
    """WITH u AS (SELECT 'event' AS kind, event_id::VARCHAR AS subject, event_type AS action, ts FROM events
         UNION ALL SELECT 'label', doc_id::VARCHAR, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END, NULL FROM labels
         UNION ALL SELECT 'order', coalesce(o_orderpriority, 'unknown'), o_orderstatus, o_orderdate FROM orders
         UNION ALL SELECT 'page', url, 'landed', NULL FROM pages)
       SELECT kind, subject, action, ts FROM u WHERE action IN ('F', 'toxic', 'landed', 'click')""",
)
def union_log(t):
    none = F.lit(None).cast("timestamp_ntz")
    parts = [
        t("events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("subject"), F.col("event_type").alias("action"), F.col("ts")),
        t("labels").select(F.lit("label").alias("kind"), F.col("doc_id").cast("string").alias("subject"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("action"), none.alias("ts")),
        t("orders").select(F.lit("order").alias("kind"), F.coalesce("o_orderpriority", F.lit("unknown")).alias("subject"), F.col("o_orderstatus").alias("action"), F.col("o_orderdate").alias("ts")),
        t("pages").select(F.lit("page").alias("kind"), F.col("url").alias("subject"), F.lit("landed").alias("action"), none.alias("ts")),
    ]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log.filter(F.col("action").isin("F", "toxic", "landed", "click"))


@query(
    "U1 A2",
    """SELECT kind, count(*) AS n FROM (SELECT 'event' AS kind FROM events UNION ALL SELECT 'label' FROM labels UNION ALL SELECT 'order' FROM orders) GROUP BY kind""",
)
def union_count(t):
    tags = [t(name).select(F.lit(kind).alias("kind")) for name, kind in (("events", "event"), ("labels", "label"), ("orders", "order"))]
    return tags[0].union(tags[1]).union(tags[2]).groupBy("kind").agg(F.count("*").alias("n"))


def _stored(t):
    k, day = F.col("o_orderkey"), F.date_format(_day(), "yyyy-MM-dd")
    url = F.when(k % 11 == 0, F.concat(F.lit("No link:1:"), k.cast("string"))).otherwise(F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), F.col("o_custkey").cast("string")))
    no_year = F.lit(None).cast("int")
    return t("orders").filter("o_orderkey % 4 <> 3").select(
        (F.col("o_custkey") % 100).alias("office_id"), k.alias("term_id"), url.alias("wiki_url"), day.alias("term_start"), F.when(k % 3 != 0, F.date_format(F.date_add(_day(), 700), "yyyy-MM-dd")).alias("term_end"),
        no_year.alias("term_start_year"), no_year.alias("term_end_year"),
    )


def _parsed(t):
    k, day = F.col("o_orderkey"), F.date_format(_day(), "yyyy-MM-dd")
    no_year = F.lit(None).cast("int")
    rows = t("orders").filter("o_orderkey % 5 <> 4")
    end = F.when(k % 13 == 5, "Invalid date").when((k % 3 != 0) | (k % 7 == 0), F.date_format(F.date_add(_day(), 700), "yyyy-MM-dd")).otherwise("present")
    return rows.select(
        (F.col("o_custkey") % 100).alias("office_id"), k.alias("row_id"), F.concat(F.lit("https://en.wikipedia.org/wiki/p_"), F.col("o_custkey").cast("string")).alias("wiki_link"), day.alias("term_start"), end.alias("term_end"),
        no_year.alias("term_start_year"), no_year.alias("term_end_year"), (k % 17 == 0).alias("dead_link"),
    )


_DIFF = """
WITH s AS (SELECT o_custkey % 100 AS office_id, o_orderkey AS term_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'p' || o_custkey END AS h, o_orderdate AS d,
       CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 700 DAY, '%Y-%m-%d') END AS e FROM orders WHERE o_orderkey % 4 <> 3),
p AS (SELECT o_custkey % 100 AS office_id, o_orderkey AS row_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'p' || o_custkey END AS h, o_orderdate AS d,
       CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0 THEN strftime(o_orderdate + INTERVAL 700 DAY, '%Y-%m-%d') END AS e FROM orders WHERE o_orderkey % 5 <> 4 AND o_orderkey % 13 <> 5),
m AS (SELECT p.office_id, row_id, term_id, s.d AS sd, s.e AS se, p.d, p.e, row_number() OVER (PARTITION BY row_id ORDER BY abs(year(p.d) - year(s.d)), term_id) AS n
      FROM p LEFT JOIN s ON p.office_id = s.office_id AND p.h = s.h AND s.h <> ''),
b AS (SELECT *, CASE WHEN term_id IS NULL THEN 'new' WHEN (se IS NULL AND e IS NOT NULL) OR d::DATE <> sd::DATE OR e IS DISTINCT FROM se THEN 'changed' ELSE 'unchanged' END AS change_type FROM m WHERE n = 1),
c AS (SELECT change_type, office_id, term_id, row_id FROM b UNION ALL
      SELECT CASE WHEN h = '' THEN 'placeholder' ELSE 'vanished_real' END, office_id, term_id, NULL FROM s WHERE term_id NOT IN (SELECT term_id FROM b WHERE term_id IS NOT NULL))
"""


@query("I2 F26 J10 J11", _DIFF + "SELECT change_type, office_id, term_id, row_id FROM c")
def diff_buckets(t):
    return diff.diff(_stored(t), _parsed(t)).select("change_type", "office_id", "term_id", "row_id")


@query(
    "I3 I4 U7 U13",
    _DIFF
    + """SELECT office_id, term_id, strftime(d, '%Y-%m-%d') AS term_start FROM s WHERE term_id NOT IN (SELECT term_id FROM c WHERE change_type IN ('changed', 'placeholder'))
         UNION ALL SELECT office_id, NULL, strftime(d, '%Y-%m-%d') FROM p WHERE row_id IN (SELECT row_id FROM c WHERE change_type IN ('new', 'changed'))""",
)
def apply_delta(t):
    stored, parsed = _stored(t), _parsed(t)
    return diff.apply_diff(stored, parsed, diff.diff(stored, parsed)).select("office_id", "term_id", "term_start")


@query("I5", _DIFF + "SELECT office_id FROM c WHERE change_type IN ('changed', 'unchanged', 'vanished_real') GROUP BY office_id HAVING count(DISTINCT term_id) FILTER (WHERE change_type = 'vanished_real') > 0.1 * count(DISTINCT term_id)")
def shifted_offices(t):
    return diff.shifted_offices(diff.diff(_stored(t), _parsed(t)), 0.1).select("office_id")


@query("I1 O1", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def changed_pages(t):
    pages = t("pages")
    state = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "old").otherwise(rules.content_hash(F.col("html"))).alias("html_hash"))
    return diff.changed_documents(pages, state, "page_id").select("page_id")


@query("I9 J7", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 7 = 3")
def unseen_people(t):
    return diff.unseen(t("orders").select("o_custkey"), t("customer").filter("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(
    "I6 A9",
    """WITH r AS (SELECT l_suppkey % 50 AS k, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 6) AS fill_rate FROM lineitem GROUP BY 1)
       SELECT k, fill_rate, CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS last_rate FROM r WHERE k % 5 <> 0 AND CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.5 END - fill_rate > 0.3""",
)
def fill_rate_drops(t):
    now = diff.fill_rate(t("lineitem").withColumn("k", F.col("l_suppkey") % 50), "k", linked=F.col("l_quantity") > 25).withColumn("fill_rate", F.round("fill_rate", 6))
    state = now.select("k", F.when(F.col("k") % 5 != 0, F.when(F.col("k") % 2 == 0, 0.9).otherwise(0.5)).alias("fill_rate"))
    return diff.fill_rate_drops(now, state, "k")


@query(
    "I11",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'queued for more than 12 h' WHEN event_id % 2 = 0 THEN 'running for more than 24 h' ELSE 'running for more than 8 h' END AS reason FROM events
       WHERE event_id % 4 <> 3 AND date_diff('second', ts, (SELECT max(ts) FROM events)) > 3600 * CASE WHEN event_id % 3 = 0 THEN 12 WHEN event_id % 2 = 0 THEN 24 ELSE 8 END""",
)
def expired_jobs(t):
    k = F.col("event_id")
    e = t("events").withColumn("as_of", F.lit(None).cast("timestamp"))
    last = t("events").agg(F.max("ts").cast("timestamp").alias("last"))  # one row
    status = F.when(k % 4 == 3, "done").when(k % 3 == 0, "queued").otherwise("running")
    jobs = e.select("event_id", status.alias("status"), F.when(k % 2 == 0, "full").otherwise("delta").alias("mode"), F.col("ts").cast("timestamp").alias("queued_at"), F.lit(None).cast("timestamp").alias("started_at"))
    return diff.expired_jobs(jobs.join(F.broadcast(last)), F.col("last")).select("event_id", "reason")


@query(
    "A10 A11",
    """WITH v AS (SELECT user_id, event_type, CASE WHEN count(*) FILTER (WHERE value > 50) > count(*) FILTER (WHERE value <= 50) THEN 1 WHEN count(*) % 4 = 0 THEN NULL ELSE 0 END AS ok FROM events GROUP BY ALL)
       SELECT user_id, CASE WHEN count(ok) < 2 THEN 'insufficient_quorum' WHEN min(ok) = 1 THEN 'valid' WHEN max(ok) = 0 THEN 'invalid' ELSE 'disagreement' END AS verdict, count(ok) AS n_available,
       coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE ok = 0), '') AS concerns FROM v GROUP BY user_id""",
)
def vote_verdict(t):
    more = F.count_if(F.col("value") > 50) > F.count_if(F.col("value") <= 50)
    votes = t("events").groupBy("user_id", F.col("event_type").alias("provider")).agg(F.when(more, True).when(F.count("*") % 4 != 0, False).alias("is_valid"))
    votes = votes.withColumn("concerns", F.when(~F.col("is_valid"), F.array("provider")))
    return quality.verdicts(votes, "user_id").select("user_id", "verdict", "n_available", F.array_join("concerns", ",").alias("concerns"))


@query(
    "Q-a",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'passed' WHEN c_custkey % 4 = 0 THEN 'skipped' WHEN c_custkey % 4 = 1 THEN 'needs_review' ELSE 'allowed' END AS result FROM customer""",
)
def suspect_gate(t):
    k = F.col("c_custkey")
    records = t("customer").select("c_custkey", F.when(k % 3 == 0, "1999").otherwise("Ann").alias("full_name"), F.lit("/wiki/x").alias("wiki_url"))
    both = records.filter("c_custkey % 4 < 3").select("c_custkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("provider"))
    valid = F.when(k % 4 == 0, False).when(k % 4 == 1, F.col("provider") == "a").otherwise(True)
    votes = both.select("c_custkey", "provider", valid.alias("is_valid"), F.array().cast("array<string>").alias("concerns"))
    return quality.gate(records, votes, "c_custkey").select("c_custkey", "result")


@query(
    "Q-b Q-c",
    """SELECT o_orderkey AS record_id, 'bad_dates' AS check_type FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""",
)
def new_findings(t):
    k = F.col("o_orderkey")
    records = t("orders").select(
        F.lit("office_term").alias("record_type"), k.alias("record_id"), F.year(_day()).alias("term_start_year"), F.when(k % 3 == 0, 1900).otherwise(2005).alias("term_end_year"),
        F.lit(None).cast("string").alias("party_text"), F.lit(None).cast("long").alias("party_id"), F.lit("/wiki/x").alias("wiki_url"), F.lit("Ann").alias("full_name"),
    )
    known = records.filter("record_id % 2 = 1").select(rules.fingerprint("dq", F.lit("office_term"), F.col("record_id"), F.lit("general")).alias("fingerprint"))
    return quality.new_findings(records, known).select("record_id", "check_type")


@query(
    "Q-e A12 A13",
    """WITH f AS (SELECT o_orderpriority AS fn, o_orderstatus AS et, (o_custkey % 20)::VARCHAR AS u, left(o_orderpriority || o_orderkey, 3 + o_orderkey % 5) AS snippet FROM orders),
       g AS (SELECT 'pf-' || substr(sha256(fn || '|' || et || '|' || u), 1, 16) AS fingerprint, count(*) AS n, min_by(snippet, (length(snippet), snippet)) AS representative FROM f GROUP BY ALL)
       SELECT fingerprint, sum(n)::BIGINT AS n, min(representative) AS representative FROM g GROUP BY fingerprint""",
)
def failure_groups(t):
    k = F.col("o_orderkey")
    f = t("orders").select(
        F.col("o_orderpriority").alias("function_name"), F.col("o_orderstatus").alias("error_type"), (F.col("o_custkey") % 20).cast("string").alias("wiki_url"),
        F.left(F.concat("o_orderpriority", k.cast("string")), (3 + k % 5).cast("int")).alias("snippet"),
    )
    return quality.grouped_failures(f, f.limit(0).select(F.lit("").alias("fingerprint"))).select("fingerprint", "n", "representative")


@query(
    "A16",
    """SELECT s_suppkey, count(*) FILTER (WHERE l_linenumber % 3 > 0) AS n_sources, s_suppkey % 4 <> 0 AND count(*) FILTER (WHERE l_linenumber % 3 > 0) >= 2 AND coalesce(bool_or(l_linenumber % 3 > 0 AND l_returnflag = 'R'), false) AS is_notable
       FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def notability(t):
    return _notability(t("lineitem"), t("supplier"))


def _notability(lines, suppliers):
    n = F.col("l_linenumber")
    sources = lines.select(
        F.col("l_suppkey").alias("s_suppkey"), F.when(n % 3 == 0, "https://en.wikipedia.org/wiki/x").otherwise("https://court.gov/x").alias("source_url"), F.when(F.col("l_returnflag") == "R", "Government").otherwise("news").alias("source_type")
    )
    people = suppliers.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, "1999").otherwise(" ").alias("term_dates"))
    return quality.notable(sources, people, "s_suppkey").select("s_suppkey", "n_sources", "is_notable")


@query(
    "Q-d",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'fetch_failed' WHEN event_id % 7 = 1 THEN 'no_data' WHEN event_id % 7 = 2 THEN 'skipped_quorum' WHEN event_id % 7 = 3 THEN 'ok'
       WHEN event_id % 7 = 4 THEN 'manual_review' WHEN event_id % 7 = 5 THEN 'reparse_ok' ELSE 'gh_issue' END AS state FROM events""",
)
def page_states(t):
    k = F.col("event_id") % 7
    verdict = F.when(k == 2, "insufficient_quorum").when(k == 3, "valid").when(k == 4, "disagreement").otherwise("invalid")
    return t("events").select("event_id", quality.page_state(k != 0, k != 1, verdict, F.when(k == 5, "valid").otherwise("invalid")).alias("state"))


@query(
    "A14",
    """SELECT count(DISTINCT l_suppkey) AS offices, count(*) FILTER (WHERE l_returnflag = 'R') AS unchanged, count(*) AS terms, count(DISTINCT l_partkey) AS links,
       count(*) FILTER (WHERE l_linenumber < 3) AS bio_ok, count(*) FILTER (WHERE l_linenumber = 3) AS bio_failed, count(*) FILTER (WHERE l_linenumber > 4) AS bio_skipped FROM lineitem""",
)
def run_counters(t):
    n = F.col("l_linenumber")
    biography = F.when(n < 3, "ok").when(n == 3, "failed").when(n > 4, "skipped")
    rows = t("lineitem").select(F.col("l_suppkey").alias("office_id"), F.when(F.col("l_returnflag") == "R", "unchanged").otherwise("new").alias("change_type"), F.col("l_partkey").alias("wiki_url"), biography.alias("biography"))
    return quality.run_counters(rows)


@query(
    "Q-f",
    "SELECT 'suspect_flag' AS kind, c_name AS subject FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'report', s_name FROM supplier WHERE s_suppkey % 2 = 0",
)
def open_items(t):
    flags = t("customer").select(F.when(F.col("c_custkey") % 5 == 0, "needs_review").otherwise("passed").alias("result"), F.col("c_name").alias("subject"))
    return quality.open_items(flags, t("supplier").select((F.col("s_suppkey") % 2 == 1).alias("resolved"), F.col("s_name").alias("subject")))


@query("T4", "SELECT o_orderpriority, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS next_job FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def next_queued(t):
    return t("orders").filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_job"))
