"""Queries on HTML, over pages rendered from the relational tables, and on nested exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import extract as ex
from ..operators import infobox
from ..session import run_folder
from ..sources import files, html, snapshots
from .registry import query

def _day():
    return F.col("o_orderdate").cast("date")



def _html(rows, *keys, header, row, order):
    """A page for each key: a small first table, then a table of the rows.

    Rows are dealt over a number of tasks that adaptive execution keeps: they are small in bytes, so that it would leave few tasks to render and parse all pages.
    """
    spark = rows.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lists = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order), row.alias("tr")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["tr"]), "\n")
    return lists.select(*keys, F.concat(F.lit(f"<p>x</p><table><tr><td>stub</table><table class=t><tr>{header}</tr>"), body, F.lit("</table>")).alias("html"))


def _td(*parts):
    return F.concat(*[F.concat(F.lit("<td>"), p if not isinstance(p, str) else F.lit(p), F.lit("</td>")) for p in parts])


def _nations(t):
    n = t("nation")
    row = F.concat(F.lit("<tr>"), _td(F.col("n_nationkey").cast("string"), F.concat(F.lit("<a href='/wiki/"), "n_name", F.lit("'>"), "n_name", F.lit("</a>"))), F.lit("</tr>"))
    return _html(n, "n_regionkey", header="<th>Id<th>Name", row=row, order="n_nationkey")


@query("H1 H2 H3 S1 S4", "SELECT n_regionkey, 2::INT AS table_no, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_index, n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def html_rows(t):
    rows = html.table_rows(_nations(t), "n_regionkey").filter("table_no = 2 AND row_index > 0")
    return rows.select("n_regionkey", "table_no", "row_index", ex.cell(F.lit(0))["text"].alias("id"), ex.cell(F.lit(1))["text"].alias("name"))


@query("S19", "SELECT r_regionkey AS n_regionkey, i::INT AS col_index, ['Id', 'Name'][i + 1] AS text FROM region, range(2) r(i)")
def html_header(t):
    return html.header_cells(html.table_rows(_nations(t), "n_regionkey"), "n_regionkey").filter("table_no = 2").select("n_regionkey", "col_index", "text")


@query("H29", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_index, 1::INT AS col_index FROM nation")
def html_link_map(t):
    return html.link_map(html.table_rows(_nations(t), "n_regionkey"), "n_regionkey").select("n_regionkey", "row_index", "col_index")


@query("S17 S18", "SELECT r_regionkey AS n_regionkey, 2::INT AS n_tables, k::INT AS table_no, CASE WHEN k = 1 THEN 1 ELSE least(3, 1 + (SELECT count(*) FROM nation n WHERE n.n_regionkey = r_regionkey)) END::INT AS shown FROM region, range(1, 3) t(k)")
def html_preview(t):
    return html.all_tables_preview(_nations(t), "n_regionkey", rows=3).select("n_regionkey", "n_tables", "table_no", F.size("rows").alias("shown"))


def _terms_page(t, right_to_left=False, merged=False, district_last=False):
    o = t("orders").withColumn("g", F.col("o_custkey"))
    k = F.col("o_orderkey")
    person = F.concat(F.lit("<a href='/wiki/File:x.png'>pic</a><a href='/wiki/P_"), k.cast("string"), F.lit("'>P "), k.cast("string"), F.lit("</a>"))
    start = F.when(k % 2 == 0, F.date_format(_day(), "MMMM d, yyyy")).otherwise(F.date_format(_day(), "d MMMM yyyy"))
    end = F.when(k % 3 == 0, "Incumbent[a]").otherwise(F.date_format(F.date_add(_day(), 365), "MMMM d, yyyy"))
    district = F.when(k % 4 == 0, F.concat((k % 10 + 4).cast("string"), F.lit("th"))).otherwise("whole")
    cells = [district, person, start, end] if not merged else [district, person, F.concat(start, F.lit(" – "), end)]
    if district_last:
        cells = ["note", person, start, end, district]
    row = F.concat(F.lit("<tr>"), _td(*(reversed(cells) if right_to_left else cells)), F.lit("</tr>"))
    return _html(o, "g", header="<th>a<th>b<th>c<th>d", row=row, order="o_orderkey")


_TERMS = """SELECT o_custkey AS g, 'https://en.wikipedia.org/wiki/P_' || o_orderkey AS wiki_link, 'pic' AS name, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 10 + 4) || 'th' ELSE 'No district' END AS district,
       strftime(o_orderdate, '%Y-%m-%d') AS term_start, CASE WHEN o_orderkey % 3 = 0 THEN 'Incumbent' ELSE strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') END AS term_end FROM orders"""


def _out(df):
    return df.select("g", "wiki_link", F.col("name_from_table").alias("name"), "district", "term_start", "term_end")


@query("H6 H8 H12 H15 H20 H21", _TERMS)
def html_terms(t):
    config = ex.Config(table_no=2, table_rows=4, district_column=0, link_column=1, term_start_column=2, term_end_column=3, ignore_non_links=True)
    return _out(ex.extract(html.table_rows(_terms_page(t), "g"), config, "g"))


_FREE_FORMS = ("d MMM yyyy", "MM/dd/yyyy", "MMMM yyyy", "EEEE, d MMM yyyy")


@query(
    "H12 F2 F8",
    """SELECT o_custkey AS g, 'https://en.wikipedia.org/wiki/P_' || o_orderkey AS wiki_link,
       CASE WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS term_start,
       strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') AS term_end FROM orders""",
)
def html_terms_free_form(t):
    o, k = t("orders").withColumn("g", F.col("o_custkey")), F.col("o_orderkey")
    start = F.coalesce(*[F.when(k % 4 == i, F.date_format(_day(), form)) for i, form in enumerate(_FREE_FORMS)])
    person = F.concat(F.lit("<a href='/wiki/P_"), k.cast("string"), F.lit("'>P</a>"))
    row = F.concat(F.lit("<tr>"), _td(person, start, F.date_format(F.date_add(_day(), 365), "d MMM yyyy")), F.lit("</tr>"))
    rows = html.table_rows(_html(o, "g", header="<th>a<th>b<th>c", row=row, order="o_orderkey"), "g")
    return ex.extract(rows, ex.Config(table_no=2, table_rows=3), "g").select("g", "wiki_link", "term_start", "term_end")


@query("H11 Q18", _TERMS)
def html_terms_right_to_left(t):
    config = ex.Config(table_no=2, table_rows=4, district_column=0, link_column=1, term_start_column=2, term_end_column=3, read_right_to_left=True)
    return _out(ex.extract(html.table_rows(_terms_page(t, right_to_left=True), "g"), config, "g"))


@query("H9 H10", _TERMS)
def html_terms_dynamic(t):
    """The config counts from the holder's column as if it were the first; a note stands before it, and the district comes last."""
    config = ex.Config(table_no=2, table_rows=5, link_column=0, term_start_column=1, term_end_column=2, district_column=3, dynamic_parse=True)
    return _out(ex.extract(html.table_rows(_terms_page(t, district_last=True), "g"), config, "g"))


@query("H15 F3", _TERMS)
def html_terms_merged(t):
    config = ex.Config(table_no=2, table_rows=3, district_column=0, link_column=1, term_start_column=2, term_end_column=2, term_dates_merged=True)
    return _out(ex.extract(html.table_rows(_terms_page(t, merged=True), "g"), config, "g"))


@query(
    "H14 H16 W2",
    """SELECT o_custkey AS g, 'https://en.wikipedia.org/wiki/P_' || min(o_orderkey) OVER (PARTITION BY o_custkey) AS wiki_link, strftime(o_orderdate, '%Y-%m-%d') AS term_start,
       strftime(o_orderdate + INTERVAL 100 DAY, '%Y-%m-%d') AS term_end, '7th' AS district FROM orders""",
)
def html_rowspan(t):
    return _rowspan(t("orders"))


def _rowspan(o):
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lead_key"))
    o = o.join(first, "o_custkey").withColumn("g", F.col("o_custkey"))
    a, b = F.date_format(_day(), "MMMM d, yyyy"), F.date_format(F.date_add(_day(), 100), "MMMM d, yyyy")
    whole = _td(F.concat(F.lit("<a href='./P_"), F.col("o_orderkey").cast("string"), F.lit("'>P</a>")), "7th", a, b)
    short = _td(F.concat(a, F.lit(" – "), b))
    row = F.concat(F.lit("<tr>"), F.when(F.col("o_orderkey") == F.col("lead_key"), whole).otherwise(short), F.lit("</tr>"))
    # a row of one cell is too short for any config, so the short rows carry a note beside their dates
    row = F.regexp_replace(row, "</td></tr>$", "</td><td>note</td></tr>")
    pages = _html(o, "g", header="<th>a", row=row, order="o_orderkey")
    config = ex.Config(table_no=2, link_column=0, district_column=1, term_start_column=2, term_end_column=3, parse_rowspan=True)
    return ex.extract(html.table_rows(pages, "g"), config, "g").select("g", "wiki_link", "term_start", "term_end", "district")


@query("H18", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS term_start FROM orders")
def html_sort_values(t):
    return _sort_values(t("orders"))


def _sort_values(o):
    row = F.concat(F.lit("<tr>"), _td(F.concat(F.lit("<a href='/wiki/P'>P</a>")), F.concat(F.lit("<span data-sort-value='000"), F.date_format(_day(), "yyyy-MM-dd"), F.lit("-0000'>spring</span>")), "present"), F.lit("</tr>"))
    pages = _html(o, "o_orderkey", header="<th>a", row=F.regexp_replace(row, "'000", "'"), order="o_custkey")
    rows = ex.extract(html.table_rows(pages, "o_orderkey"), ex.Config(table_no=2, table_rows=3), "o_orderkey")
    return rows.select("o_orderkey", "term_start")


@query(
    "H19",
    """SELECT o_custkey AS g, 'https://en.wikipedia.org/wiki/P_' || o_orderkey AS wiki_link,
       CASE o_orderkey % 4 WHEN 0 THEN 'Red' WHEN 1 THEN 'Blue' WHEN 2 THEN 'Blue' ELSE 'No party' END AS party FROM orders""",
)
def party_links(t):
    o, k = t("orders").withColumn("g", F.col("o_custkey")), F.col("o_orderkey")
    party = (
        F.when(k % 4 == 0, "<a href='/wiki/Seat'>a</a> <a href='/wiki/Red_Party'>R</a> <a href='/wiki/Blue_Party'>B</a>")
        .when(k % 4 == 1, "<a href='/wiki/Blue_Party'>Red</a>")
        .when(k % 4 == 2, "<a href='/wiki/Other'>Blue</a> (acting)")
        .otherwise("R")
    )
    person = F.concat(F.lit("<a href='/wiki/P_"), k.cast("string"), F.lit("'>P</a>"))
    row = F.concat(F.lit("<tr>"), _td(person, party, "May 1, 1990", "present"), F.lit("</tr>"))
    rows = html.table_rows(_html(o, "g", header="<th>a<th>b<th>c<th>d", row=row, order="o_orderkey"), "g")
    config = ex.Config(table_no=2, table_rows=4, party_column=1, term_start_column=2, term_end_column=3, party_link=True)
    names = F.explode(F.array(F.lit("Red"), F.lit("Blue"))).alias("name")
    parties = t("region").filter("r_regionkey = 0").select(F.lit("x").alias("country"), names).withColumn("link", F.concat(F.lit("https://en.wikipedia.org/wiki/"), "name", F.lit("_Party")))
    return ex.resolve_parties(ex.extract(rows, config, "g"), parties, F.lit("x"), "g").select("g", "wiki_link", "party")


@query("H30 Q19", "SELECT r_regionkey AS n_regionkey, 'ok' AS a, 'table not found' AS b, 'column out of range' AS c FROM region")
def config_check(t):
    tables = _nations(t).select("n_regionkey", html.html_tables(F.col("html")).alias("tables"))
    kinds = {"a": ex.Config(table_no=2, term_start_column=-1, term_end_column=1), "b": ex.Config(table_no=5), "c": ex.Config(table_no=2, term_end_column=7)}
    out = None
    for name, config in kinds.items():
        one = ex.check_config(tables, config, "n_regionkey").select("n_regionkey", F.col("message").alias(name))
        out = one if out is None else out.join(one, "n_regionkey")
    return out


def _people(t):
    k = F.col("c_custkey")
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("d"))
    c = t("customer").join(o, "c_custkey")
    box = F.concat(
        F.lit("<table class='infobox vcard'><tr><th class='infobox-above'>"), "c_name", F.lit("[1]</th></tr><tr><td><a href='/wiki/Mayor_of_"), F.col("c_nationkey").cast("string"), F.lit("'>Mayor of x</a></td></tr><tr><td>"),
        F.when(k % 3 == 0, "<b>nothing</b></td></tr><tr><td>").otherwise(""), F.lit("In office<br>"), F.date_format("d", "MMMM d, yyyy"), F.lit(" – "), F.date_format(F.date_add("d", 90), "MMMM d, yyyy"),
        F.lit("</td></tr><tr><th>Born</th><td>"), F.date_format("d", "d MMMM yyyy"), F.lit(" (in town)</td></tr></table><p>x</p>"),
    )
    para = F.concat(F.lit("<p><b>"), "c_name", F.lit("</b> ("), F.lit("x) "), F.date_format("d", "MMMM d, yyyy"), F.lit(" – "), F.date_format(F.date_add("d", 90), "MMMM d, yyyy"), F.lit("</p>"))
    page = html.html_page(F.when(k % 2 == 0, box).otherwise(para))
    return c.select("c_custkey", "c_nationkey", page.alias("page"), F.concat(F.lit("https://en.wikipedia.org/wiki/P_"), k.cast("string")).alias("url"))


_FIRST = "(SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_nationkey) AS c_nationkey, min(o_orderdate) AS d FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"


@query(
    "H22 H23 H24",
    f"""SELECT c_custkey, c_name AS full_name, strftime(d, '%Y-%m-%d') AS birth_date,
        CASE WHEN c_custkey % 2 = 1 THEN strftime(d + INTERVAL 90 DAY, '%Y-%m-%d') END AS death_date, 'P_' || c_custkey AS page_path FROM {_FIRST}""",
)
def biographies(t):
    return _biographies(_people(t))


def _biographies(people):
    people = people.withColumn("b", infobox.biography(F.col("page"), F.col("url")))
    return people.select("c_custkey", "b.full_name", "b.birth_date", "b.death_date", "b.page_path")


@query(
    "H25 H26 H27 H28 W6",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN strftime(d, '%Y-%m-%d') ELSE 'YYYY-00-00' END AS term_start,
        CASE WHEN c_custkey % 2 = 0 THEN strftime(d + INTERVAL 90 DAY, '%Y-%m-%d') ELSE 'YYYY-00-00' END AS term_end FROM {_FIRST}""",
)
def infobox_terms(t):
    return _infobox_terms(t)


def _infobox_terms(t):
    people = _people(t)
    offices = people.select("c_custkey", F.concat(F.lit("/wiki/List_of_Mayors_of_"), F.col("c_nationkey").cast("string")).alias("office_path"))
    own = people.select("c_custkey", F.concat(F.lit("/wiki/Mayor_of_"), F.col("c_nationkey").cast("string")).alias("office_path"))
    terms = infobox.infobox_terms(people, offices.union(own), "c_custkey", role='"mayor" -"deputy mayor"')
    # the office's row is followed by the dates, in one row or two
    return terms.select("c_custkey", "term_start", "term_end")


#: Layouts of the pages of `unit_terms`: the bits of the unit's number.
_RIGHT_TO_LEFT, _MERGED, _YEARS, _FILTERED, _DYNAMIC, _LINKS_ONLY, _LAYOUTS, _UNITS = 1, 2, 4, 8, 16, 32, 64, 80


def _unit_pages(t):
    """A page of a customer's orders in the layout of its unit; units from _LAYOUTS on have rowspans."""
    o, k, u = t("orders").withColumn("g", F.col("o_custkey")), F.col("o_orderkey"), F.col("o_custkey") % _UNITS
    has = lambda bit: (u < _LAYOUTS) & (u.bitwiseAND(bit) > 0)
    dynamic = has(_DYNAMIC) & ~has(_RIGHT_TO_LEFT)
    name = F.concat(F.lit("P "), k.cast("string"))
    person = F.when(k % 7 == 0, name).otherwise(F.concat(F.lit("<a href='/wiki/P_"), k.cast("string"), F.lit("'>"), name, F.lit("</a>")))
    year = F.year(_day())
    start = F.when(has(_YEARS), year.cast("string")).otherwise(F.date_format(_day(), "MMMM d, yyyy"))
    end = F.when(has(_YEARS), (year + 4).cast("string")).otherwise(F.date_format(F.date_add(_day(), 365), "MMMM d, yyyy"))
    span = F.concat(start, F.lit(" – "), end)
    district = F.when(k % 4 == 0, F.concat((k % 10 + 4).cast("string"), F.lit("th"))).otherwise("whole")
    kind = F.when(k % 3 == 0, "Circuit  Judge").otherwise("Clerk")
    when = F.when(has(_MERGED), F.array(span)).otherwise(F.array(start, end))
    cells = F.when(dynamic, F.concat(F.array(F.lit("note"), person), when, F.array(district, kind))).otherwise(F.concat(F.array(district, person), when, F.array(kind)))
    cells = F.when(has(_RIGHT_TO_LEFT), F.reverse(cells)).otherwise(cells)
    short = F.array(span, F.when(k % 5 == 0, "9th").otherwise("note"))
    cells = F.when(u < _LAYOUTS, cells).when(k % 3 == 0, F.array(person, district, start, end)).otherwise(short)
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    return _html(o, "g", header="<th>a<th>b", row=row, order="o_orderkey")


def _unit_configs(t):
    """A row for each customer: the fields of its unit's config; what a layout does not need is null."""
    u = F.col("c_custkey") % _UNITS
    has = lambda bit: (u < _LAYOUTS) & (u.bitwiseAND(bit) > 0)
    dynamic, merged, rowspan = has(_DYNAMIC) & ~has(_RIGHT_TO_LEFT), has(_MERGED), u >= _LAYOUTS
    first = F.when(rowspan | dynamic, 0).otherwise(1)
    cells = F.when(dynamic, 6).otherwise(5) - F.when(merged, 1).otherwise(0)
    start = F.when(rowspan, 2).otherwise(first + 1)
    end = start + F.when(merged, 0).otherwise(1)
    return t("customer").select(
        F.col("c_custkey").alias("g"),
        u.alias("unit"),
        F.lit(2).alias("table_no"),
        F.when(~rowspan, cells).alias("table_rows"),
        first.alias("link_column"),
        start.alias("term_start_column"),
        end.alias("term_end_column"),
        F.when(rowspan, 1).when(dynamic, end + 1).otherwise(0).alias("district_column"),
        F.when(has(_FILTERED), F.when(has(_RIGHT_TO_LEFT), 0).otherwise(cells - 1)).alias("filter_column"),
        F.when(has(_FILTERED), " circuit judge").alias("filter_criteria"),
        F.when(dynamic, True).alias("dynamic_parse"),
        has(_RIGHT_TO_LEFT).alias("read_right_to_left"),
        rowspan.alias("parse_rowspan"),
        has(_YEARS).alias("years_only"),
        merged.alias("term_dates_merged"),
        (has(_LINKS_ONLY) | (rowspan & (u % 2 == 1))).alias("ignore_non_links"),
    )


@query(
    "H5 H8 H9 H10 H11 H12 H13 H14 H15 H16 H17 H20 J13",
    f"""WITH o AS (SELECT o_custkey AS g, (o_custkey % {_UNITS})::INT AS unit, o_orderkey AS k, o_orderdate::DATE AS d, (o_custkey % {_UNITS}) < {_LAYOUTS} AS plain FROM orders),
        marked AS (SELECT *, k % 7 <> 0 AS linked, CASE WHEN k % 4 = 0 THEN (k % 10 + 4) || 'th' ELSE 'No district' END AS own, plain AND unit & {_YEARS} > 0 AS years,
                   NOT plain AND k % 3 = 0 AND k % 7 <> 0 AS begins, NOT plain AND k % 3 <> 0 AS short FROM o),
        carried AS (SELECT *, max(CASE WHEN begins THEN k END) OVER w AS lead_key FROM marked WINDOW w AS (PARTITION BY g ORDER BY k ROWS UNBOUNDED PRECEDING)),
        placed AS (SELECT *, last_value(CASE WHEN begins THEN own WHEN short AND lead_key IS NOT NULL AND k % 5 = 0 THEN '9th' END IGNORE NULLS) OVER (PARTITION BY g ORDER BY k ROWS UNBOUNDED PRECEDING) AS kept FROM carried)
        SELECT g, unit, CASE WHEN NOT plain THEN 'https://en.wikipedia.org/wiki/P_' || lead_key WHEN linked THEN 'https://en.wikipedia.org/wiki/P_' || k ELSE 'No link' END AS wiki_link,
               CASE WHEN plain THEN own ELSE kept END AS district,
               CASE WHEN NOT years THEN strftime(d, '%Y-%m-%d') END AS term_start, CASE WHEN NOT years THEN strftime(d + INTERVAL 365 DAY, '%Y-%m-%d') END AS term_end,
               CASE WHEN years THEN year(d)::INT END AS term_start_year, CASE WHEN years THEN year(d)::INT + 4 END AS term_end_year
        FROM placed
        WHERE CASE WHEN plain THEN (unit & {_FILTERED} = 0 OR k % 3 = 0) AND (linked OR (unit & {_LINKS_ONLY} = 0 AND NOT (unit & {_DYNAMIC} > 0 AND unit & {_RIGHT_TO_LEFT} = 0)))
              ELSE begins OR (short AND lead_key IS NOT NULL) END""",
)
def unit_terms(t):
    """Eighty configs, every mode among them, over all pages in one plan."""
    units = _unit_configs(t)
    terms = ex.extract_units(ex.unit_rows(_unit_pages(t), units, "g"), units, "g", "unit")
    return terms.select("g", "unit", "wiki_link", "district", "term_start", "term_end", "term_start_year", "term_end_year")


_ROLES = (None, '"mayor"', '"deputy mayor"', '-"mayor of"', 'judge "mayor"', '"mayor', '"mayor of" -"deputy mayor"', 'mayor -judge', '"" "mayor"', "Mayor, of X!")


@query(
    "H25 H27 H28",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 IN (0, 1, 4, 6, 9) THEN strftime(d, '%Y-%m-%d') ELSE 'YYYY-00-00' END AS term_start,
        CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 IN (0, 1, 4, 6, 9) THEN strftime(d + INTERVAL 90 DAY, '%Y-%m-%d') ELSE 'YYYY-00-00' END AS term_end,
        CASE c_custkey % 10 WHEN 5 THEN 'unbalanced quote in role query' WHEN 7 THEN 'an exclusion needs a quoted phrase' WHEN 8 THEN 'empty quoted part in role query' END AS role_error FROM {_FIRST}""",
)
def infobox_roles(t):
    """Each office has a role query of its own, some of them malformed."""
    people = _people(t)
    role = F.get(F.array(*map(F.lit, _ROLES)), (F.col("c_custkey") % len(_ROLES)).cast("int"))
    offices = people.select("c_custkey", F.concat(F.lit("/wiki/Mayor_of_"), F.col("c_nationkey").cast("string")).alias("office_path"), role.alias("role"))
    return infobox.infobox_terms(people, offices, "c_custkey").select("c_custkey", "term_start", "term_end", "role_error")


@query("S21", "SELECT url, min(page_id) AS ord FROM (SELECT page_id, url FROM pages) GROUP BY url")
def member_pages(t):
    links = t("pages").select("url", F.col("page_id").alias("ord"))
    return files.member_pages(links.union(links), t("pages").select("url").distinct(), F.col("url")).select("url", "ord")


@query(
    "S14 A12",
    """SELECT n_regionkey AS page_id, '{"page_id":' || n_regionkey || ',"url":"' || r_name || '","offices":[' || string_agg('{"office_id":' || n_nationkey || ',"name":"' || n_name || '","alt_links":' ||
       CASE WHEN n_nationkey % 2 = 0 THEN '["/a","/b"]' ELSE '[]' END || ',"tables":[{"table_no":1},{"table_no":2}]}', ',' ORDER BY n_nationkey) || ']}' AS tree
       FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name""",
)
def export_tree(t):
    pages = t("region").select(F.col("r_regionkey").alias("page_id"), F.col("r_name").alias("url"))
    n = t("nation")
    offices = n.select(F.col("n_nationkey").alias("office_id"), F.col("n_regionkey").alias("page_id"), F.col("n_name").alias("name"))
    links = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("office_id"), F.explode(F.array(F.lit("/b"), F.lit("/a"))).alias("link_path"))
    tables = n.select(F.col("n_nationkey").alias("office_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("table_no"))
    return files.export_tree(pages, offices, links, tables)


@query(
    "S4",
    r"""WITH bare AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs') AS html FROM pages),
       found AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*>', 0)) AS tag, unnest(range(len(regexp_extract_all(html, '<a\s[^>]*>', 0)))) AS pos FROM bare)
       SELECT page_id, pos::INT AS pos, replace(regexp_extract(tag, 'href="([^"]*)"', 1), '&amp;', '&') AS href FROM found""",
)
def page_links(t):
    """All links of the raw pages, in their order."""
    return html.page_links(t("pages"), "page_id").select("page_id", "pos", "href")


@query(
    "H1 H2 H3 H4 S17 S18",
    """SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_index, CASE WHEN o_orderkey % 5 > 0 THEN 2 END::INT AS n_cells,
       CASE WHEN o_orderkey % 5 = 0 THEN 'ValueError: a row of 6 cells' END AS error FROM orders QUALIFY row_index <= 4""",
)
def lateral_rows(t):
    """The first rows of one table of each page by a table function; a row that is too wide costs no other."""
    o = t("orders").withColumn("g", F.col("o_custkey"))
    row = F.concat(F.lit("<tr>"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("<td>x" * 6)).otherwise(_td(F.col("o_orderkey").cast("string"), "y")), F.lit("</tr>"))
    pages = _html(o, "g", header="<th>a<th>b", row=row, order="o_orderkey").withColumn("wanted", F.lit(2))
    rows = html.lateral_rows(pages, "g", table_no=F.col("wanted"), max_rows=4, max_cells=5).filter("row_index > 0")
    return rows.select("g", "row_index", F.when(F.col("cells").isNotNull(), F.size("cells")).alias("n_cells"), "error")


@query(
    "S4",
    """WITH o AS (SELECT o_custkey AS g, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS i FROM orders)
       SELECT g, CASE WHEN g % 3 = 0 THEN 'e1' ELSE 'e0' END AS etag, i AS row_index, o_orderkey || CASE WHEN g % 3 = 0 THEN ' new' ELSE '' END AS first_cell FROM o""",
)
def landed_rows(t):
    """One table of each page's newest landed snapshot: a third of the pages have landed again, with other rows."""

    def landing(orders, etag, at, suffix):
        row = F.concat(F.lit("<tr>"), _td(F.concat(F.col("o_orderkey").cast("string"), F.lit(suffix))), F.lit("</tr>"))
        pages = _html(orders.withColumn("g", F.col("o_custkey")), "g", header="<th>a", row=row, order="o_orderkey")
        return pages.select(F.col("g").alias("page_id"), "html", F.lit(etag).alias("etag"), F.lit(at).cast("timestamp").alias("fetched_at"))

    orders = t("orders")
    spark = orders.sparkSession
    folder = run_folder(spark, "snapshots")
    snapshots.land(landing(orders, "e0", "2024-01-01", ""), folder, 0)
    snapshots.land(landing(orders.filter("o_custkey % 3 = 0"), "e1", "2024-01-02", " new"), folder, 1)
    spark.dataSource.register(snapshots.PageSnapshots)
    rows = spark.read.format("page_snapshots").option("table_no", 2).load(folder).filter("table_no = 2 AND row_index > 0")
    return rows.select(F.col("page_id").alias("g"), "etag", "row_index", F.get("cells", 0).alias("first_cell"))


def _small_terms(t, *cells, header="<th>a<th>b<th>c"):
    o = t("orders").withColumn("g", F.col("o_custkey"))
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    return html.table_rows(_html(o, "g", header=header, row=row, order="o_orderkey"), "g")


def _person():
    return F.concat(F.lit("<a href='/wiki/P_"), F.col("o_orderkey").cast("string"), F.lit("'>P</a>"))


_WIKI = "'https://en.wikipedia.org/wiki/P_' || o_orderkey AS wiki_link"


@query("H5", f"SELECT o_custkey AS g, {_WIKI} FROM orders WHERE o_orderkey % 3 = 0")
def html_terms_filtered(t):
    """Rows of the kind asked for, whatever its case and spaces; rows without the cell go too."""
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, _td("The  <b>CIRCUIT</b>\n Judge (acting)")).when(k == 1, _td("Clerk")).otherwise("")
    rows = _small_terms(t, _td(_person(), "May 1, 1990", "present"), kind)
    config = ex.Config(table_no=2, table_rows=3, filter_column=3, filter_criteria=" circuit judge ")
    return ex.extract(rows, config, "g").select("g", "wiki_link")


@query("H13", f"SELECT o_custkey AS g, {_WIKI} FROM orders WHERE o_orderkey % 3 <> 0")
def html_terms_short_rows(t):
    """Rows with fewer cells than the config asks for, such as headings within the table, are left out."""
    short = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<td colspan=3>"), _person(), F.lit(" heads a part</td><td>x</td>"))).otherwise(_td(_person(), "May 1, 1990", "present"))
    return ex.extract(_small_terms(t, short), ex.Config(table_no=2, table_rows=3), "g").select("g", "wiki_link")


@query(
    "H17",
    f"""SELECT o_custkey AS g, {_WIKI}, strftime(o_orderdate, '%Y-%m-%d') AS term_start, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS term_end FROM orders""",
)
def html_terms_misplaced(t):
    """The range stands in the column of the config for two rows of three, else in another one."""
    span = F.concat(F.date_format(_day(), "MMMM d, yyyy"), F.lit(" – "), F.date_format(F.date_add(_day(), 90), "MMMM d, yyyy"))
    moved = F.col("o_orderkey") % 3 == 0
    rows = _small_terms(t, _td(_person(), F.when(moved, "see note").otherwise(span), F.when(moved, span).otherwise("note")))
    config = ex.Config(table_no=2, table_rows=3, term_start_column=1, term_end_column=1, term_dates_merged=True)
    return ex.extract(rows, config, "g").select("g", "wiki_link", "term_start", "term_end")


@query(
    "H15 F4",
    f"""SELECT o_custkey AS g, {_WIKI}, year(o_orderdate)::INT AS term_start_year, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT + 4 END AS term_end_year FROM orders""",
)
def html_terms_years(t):
    end = F.when(F.col("o_orderkey") % 2 == 0, (F.year(_day()) + 4).cast("string")).otherwise("present")
    rows = _small_terms(t, _td(_person(), F.concat(F.year(_day()).cast("string"), F.lit(" – "), end)))
    config = ex.Config(table_no=2, table_rows=2, term_start_column=1, term_end_column=1, term_dates_merged=True, years_only=True)
    return ex.extract(rows, config, "g").select("g", "wiki_link", "term_start_year", "term_end_year")


@query("H4", f"SELECT o_custkey AS g, {_WIKI} FROM orders")
def html_terms_broken(t):
    """Markup that the parser does not know costs neither its row nor its page."""
    odd = F.when(F.col("o_orderkey") % 2 == 0, "<![x[y]]><!foo bar><? x >").otherwise("&#xZZ; </zz><td")
    rows = _small_terms(t, _td(_person(), "May 1, 1990", F.concat(F.lit("present"), odd)))
    return ex.extract(rows, ex.Config(table_no=2, table_rows=3), "g").select("g", "wiki_link")


@query(
    "H31",
    """SELECT n_regionkey, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_index, c::INT AS col_index,
       CASE WHEN c = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS text, CASE WHEN c = 0 THEN 0 ELSE 1 END::INT AS n_links FROM nation, range(2) r(c)""",
)
def full_table(t):
    return html.full_table(html.table_rows(_nations(t), "n_regionkey"), "n_regionkey", table_no=2)


@query(
    "P21",
    """SELECT g, row_index, wiki_link FROM (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_index, o_orderkey, 'https://en.wikipedia.org/wiki/P_' || o_orderkey AS wiki_link FROM orders)
       WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY row_index) <= 2""",
)
def preview_rows(t):
    """The first two rows of each page that an import would take."""
    start = F.when(F.col("o_orderkey") % 2 == 0, "May 1, 1990").otherwise("soon")
    rows = ex.extract(_small_terms(t, _td(_person(), start, "present")), ex.Config(table_no=2, table_rows=3), "g")
    return ex.preview(rows, "g", most=2).select("g", "row_index", "wiki_link")


@query(
    "F14",
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '/wiki/' || n_name WHEN 1 THEN '/wiki/' || n_name WHEN 2 THEN '/wiki/w/' || n_name WHEN 3 THEN '/wiki/' || n_name ELSE '' END AS path FROM nation""",
)
def infobox_paths(t):
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    href = (
        F.when(k == 0, F.concat(F.lit(" ./"), name, F.lit("#Term")))
        .when(k == 1, F.concat(F.lit("https://en.wikipedia.org/wiki/"), name, F.lit("?action=raw")))
        .when(k == 2, F.concat(F.lit("/w/"), name))
        .when(k == 3, name)
        .otherwise("#top")
    )
    return t("nation").select("n_nationkey", urls.infobox_path(href).alias("path"))


@query(
    "S15",
    """SELECT n_regionkey, 'table_no=2' || chr(10) || 'rows=' || count(*) || chr(10) || string_agg(i || ': ' || n_nationkey || ' | ' || n_name, chr(10) ORDER BY i) AS report
       FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey""",
)
def debug_export(t):
    rows = html.full_table(html.table_rows(_nations(t), "n_regionkey"), "n_regionkey", table_no=2)
    return files.debug_report(rows, {"table_no": 2}, "n_regionkey").select("n_regionkey", "report")
