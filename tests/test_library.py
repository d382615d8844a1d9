"""Truth tables and small cases of the library's functions, sources and operators."""

import json
import random
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstone.functions import dates, rules, urls
from fieldstone.operators import diff, extract, infobox, lookup, ordered, quality, writes
from fieldstone.sources import files, html
from fieldstone.streaming import landing


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normalize_date(spark):
    none = [None, "", "   ", "present", "Present", "PRESENT", "n/a", "N/A", "incumbent", "invalid date", "Jan 1 2000", "01/01/2000", "2000/01/01", "2000-1-1", "20000101", "2000"]
    good = ["2000-01-01", "1985-12-31", "  2022-06-15  "]
    got = [r[0] for r in values(spark, none + good, dates.normalize_date(F.col("v")))]
    assert [(r["date"], r["imprecise"]) for r in got] == [(None, True)] * len(none) + [(g.strip(), False) for g in good]


def test_format_date(spark):
    cases = {
        "January 5, 2010": "2010-01-05",
        "was Sep 5, 2010 here": "2010-09-05",
        "Sept 5, 2010": "2010-09-05",
        "18 June 1798": "1798-06-18",
        "(2001-02-03)": "Invalid date",  # the free parser refuses parentheses
        "1999": "Invalid date",
        "": "Invalid date",
        "March 1990": "1990-03-01",
        "February 31, 2000": "Invalid date",
        "no date": "Invalid date",
    }
    assert [r[0] for r in values(spark, cases, dates.format_date(F.col("v"), free_form=True))] == list(cases.values())


def test_date_range(spark):
    cases = {
        "May 1, 1990 – present": ("1990-05-01", "present"),
        "In office May 1 1990 – 3 June 1991[2]": ("1990-05-01", "1991-06-03"),
        "May 1, 1990 (acting) to Incumbent": ("1990-05-01", "Incumbent"),
        "no range": ("Invalid date", "Invalid date"),
    }
    got = [tuple(r[0]) for r in values(spark, cases, dates.date_range(F.col("v")))]
    assert got == list(cases.values())
    assert [tuple(r[0]) for r in values(spark, cases, dates.date_range(F.col("v"), free_form=True))] == got


def test_year_range(spark):
    cases = {"1966–1974": (1966, 1974), "2009–present": (2009, None), "1990": (1990, 1990), "x": (None, None), "1990[a] to 1995": (1990, 1995), "–1990": (None, 1990)}
    assert [tuple(r[0]) for r in values(spark, cases, dates.year_range(F.col("v")))] == list(cases.values())


def test_real_date(spark):
    assert [r[0] for r in values(spark, ["1891", "2020-13-45", "2020-02-29", None], dates.real_date(F.col("v")))] == [None, None, date(2020, 2, 29), None]


def test_links(spark):
    cases = ["https://en.wikipedia.org./Ann", "http://en.wikipedia.org/wiki/Ann%20B?x=1#y", "No link:4:Ann", "", "https://example.org/a", "https://en.wikipedia.org/wiki/%E0%A4%A"]
    got = [r[0] for r in values(spark, cases, urls.canonical_holder(F.col("v")))]
    assert got == ["/wiki/ann", "/wiki/ann_b", "No link:4:Ann", "", "https://example.org/a", "/wiki/%e0%a4%a"]


def test_suspicious(spark):
    df = spark.createDataFrame([("1999", "/wiki/x"), ("Ann", "/wiki/a&amp;b"), ("Governor Ann", "x"), ("Ann", None), ("x" * 101, "drop where")], "n string, u string")
    got = [r[0] for r in df.select(rules.suspicious(F.col("n"), F.col("u"))).collect()]
    assert got == [["year_as_name"], ["html_in_url"], ["title_in_name"], [], ["sql_in_url", "long_name"]]


def test_slug_variants(spark):
    got = [set(r[0]) for r in values(spark, ["/wiki/List_of_governors_of_Ohio", "/wiki/Mayor_of_X", "/wiki/Y"], infobox.slug_variants(F.col("v")))]
    assert {"governors_of_ohio", "ohio_governor"} <= got[0] and "x_mayor" in got[1] and got[2] == {"/wiki/y", "y"}


TABLE = """<table><tr><th>Name<th>Start<th>End</tr>
<tr><td><a href="/wiki/Ann">Ann</a><td data-sort-value="1990-05-01">spring<td>present
<tr><td><a href="/wiki/File:x">p</a><a href="./Bob#cite">B</a><a href="./Bob">Bob</a></td><td>May 1, 1990</td><td>June 2, 1991</td></tr>
<tr><td><table><tr><td>inner</td></tr></table></td><td>x</td><td>y</td></tr></table>"""


def test_tables(spark):
    pages = spark.createDataFrame([(1, TABLE), (2, None), (3, "<p>none")], "id int, html string")
    rows = html.table_rows(pages, "id").orderBy("table_no", "row_index").collect()
    assert [(r["table_no"], r["row_index"], len(r["cells"])) for r in rows] == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 4, 1), (2, 0, 1)]
    terms = extract.extract(html.table_rows(pages, "id"), extract.Config(table_rows=3), "id").orderBy("row_index").collect()
    assert [(t["wiki_link"].rsplit("/", 1)[-1], t["term_start"], t["term_end"]) for t in terms][:2] == [("Ann", "1990-05-01", "present"), ("Bob", "1990-05-01", "1991-06-02")]
    assert [t["wiki_link"] for t in terms][2] == "No link"


FREE = {"5 Sep 2010": "2010-09-05", "Sept 5, 2010": "2010-09-05", "March 1990": "1990-03-01", "01/02/1990": "1990-01-02", "spring": "Invalid date"}


@pytest.mark.parametrize("kind", ["single", "merged", "recovered", "short"])
def test_free_form_dates_in_tables(spark, kind):
    person = "<td><a href='/wiki/Ann'>Ann</a>"
    row = {
        "single": "<tr>{p}<td>{d}<td>{d}",
        "merged": "<tr>{p}<td>{d} – {d}",
        "recovered": "<tr>{p}<td>see<td>{d} – {d}",
        "short": "<tr>{p}<td>May 1, 1980<td>May 2, 1980<tr><td>{d} – {d}<td>note",
    }[kind]
    pages = spark.createDataFrame([(d, f"<table><tr><th>a{row.format(p=person, d=d)}</table>") for d in FREE], "d string, html string")
    config = extract.Config(table_rows=2, term_end_column=2 if kind in ("single", "short") else 1, term_dates_merged=kind in ("merged", "recovered"), parse_rowspan=kind == "short")
    last = extract.extract(html.table_rows(pages, "d"), config, "d").filter("row_index = 2" if kind == "short" else "row_index = 1")
    assert {r["d"]: (r["term_start"], r["term_end"]) for r in last.collect() if r["d"] != "spring"} == {d: (v, v) for d, v in FREE.items() if d != "spring"}
    assert [r["term_start"] for r in last.filter("d = 'spring'").collect()] == ["Invalid date"]


def test_free_form_dates_on_person_pages(spark):
    box = "<table class='infobox vcard'><tr><td><a href='/wiki/Mayor_of_X'>Mayor</a></td></tr><tr><td>{d} – {d}</td></tr><tr><th>Born</th><td>{d}</td></tr></table>"
    dated = [d for d in FREE if d != "spring"]
    rows = spark.createDataFrame([(d, box.format(d=d)) for d in dated], "k string, html string")
    people = rows.select("k", html.html_page(F.col("html")).alias("page"))
    born = people.select("k", infobox.biography(F.col("page"), F.lit("https://x/wiki/Ann"))["birth_date"].alias("b"))
    assert {r["k"]: r["b"] for r in born.collect()} == {d: FREE[d] for d in dated}
    terms = infobox.infobox_terms(people, people.select("k", F.lit("/wiki/Mayor_of_X").alias("office_path")), "k")
    assert {r["k"]: (r["term_start"], r["term_end"]) for r in terms.collect()} == {d: (FREE[d], FREE[d]) for d in dated}


def test_infobox_placeholder(spark):
    box = "<table class='infobox vcard'><tr><td><a href='/wiki/{o}'>Mayor</a></td></tr><tr><td>{d}</td></tr></table>"
    texts = {1: box.format(o="Mayor_of_X", d="May 1, 1990 – May 2, 1991"), 2: box.format(o="Judge", d="May 1, 1990"), 3: "<p>none</p>", 4: box.format(o="Mayor_of_X", d="long ago"), 5: None}
    people = spark.createDataFrame(list(texts.items()), "k int, html string").select("k", html.html_page(F.col("html")).alias("page"))
    terms = infobox.infobox_terms(people, people.select("k", F.lit("/wiki/Mayor_of_X").alias("office_path")), "k")
    got = {r["k"]: (r["term_start"], r["term_end"]) for r in terms.collect()}
    assert got == {1: ("1990-05-01", "1991-05-02")} | {k: ("YYYY-00-00", "YYYY-00-00") for k in (2, 3, 4, 5)}


def test_find_date_in_infobox(spark):
    box = "<table class='infobox vcard'><tr><td><a href='/wiki/Mayor_of_X'>Mayor</a></td></tr><tr><td>May 1, 1990 – May 2, 1991</td></tr></table>"
    table = "<table><tr><th>a<tr><td><a href='/wiki/Ann'>Ann</a><td>1990<td>1991<tr><td><a href='/wiki/Bob'>Bob</a><td>1992<td>1993<tr><td>Cy<td>May 3, 1994<td>present</table>"
    rows = html.table_rows(spark.createDataFrame([(1, table)], "id int, html string"), "id")
    people = spark.createDataFrame([("https://en.wikipedia.org/wiki/Ann", box), ("https://en.wikipedia.org/wiki/Bob", "<p>x")], "wiki_link string, html string")
    people = people.select("wiki_link", html.html_page(F.col("html")).alias("page"))
    offices = spark.createDataFrame([(1, "/wiki/Mayor_of_X")], "id int, office_path string")
    out = extract.extract(rows, extract.Config(table_rows=3, find_date_in_infobox=True), "id", people=people, offices=offices)
    got = [tuple(r) for r in out.orderBy("row_index").select("name_from_table", "term_start", "term_end", "term_start_year", "term_end_year").collect()]
    assert got == [("Ann", "1990-05-01", "1991-05-02", None, None), ("Bob", None, None, 1992, 1993), ("Cy", "1994-05-03", "present", None, None)]


def test_party_links(spark):
    cells = {"Ann": "<a href='/wiki/Democratic_Party'>Dem.</a>", "Bob": "<a href='/wiki/Seat'>x</a><a href='/wiki/Whig_Party'>W</a>", "Cy": "a Whig", "Di": "R"}
    table = "<table><tr><th>a" + "".join(f"<tr><td><a href='/wiki/{n}'>{n}</a><td>{c}<td>May 1, 1990<td>present" for n, c in cells.items()) + "</table>"
    config = extract.Config(table_rows=4, party_column=1, term_start_column=2, term_end_column=3, party_link=True)
    terms = extract.extract(html.table_rows(spark.createDataFrame([(1, table)], "id int, html string"), "id"), config, "id")
    parties = spark.createDataFrame([("US", f"{p}", f"https://en.wikipedia.org/wiki/{p}_Party") for p in ("Democratic", "Whig")], "country string, name string, link string")
    got = extract.resolve_parties(terms, parties, F.lit("US"), "id")
    assert {r["name_from_table"]: r["party"] for r in got.collect()} == {"Ann": "Democratic", "Bob": "Whig", "Cy": "Whig", "Di": "No party"}


def test_islands_against_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        s = None if rng.random() < 0.1 else rng.randrange(200)
        e = None if rng.random() < 0.1 else (s or 0) + rng.randrange(20)
        rows.append((k, rng.randrange(12), s, e))
    want, last = {}, {}
    for k, g, s, e in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[3] is None, r[3] or 0, r[0])):
        before, island = last.get(g, (None, 0))
        if before is None or s is None or s - before > 1:
            island += 1
        want[k], last[g] = island, (e, island)
    df = spark.createDataFrame(rows, "k int, g int, s int, e int")
    got = ordered.islands(df, "g", start=F.col("s"), end=F.col("e"), order=F.col("k"))
    assert {r["k"]: r["island"] for r in got.collect()} == want


def test_diff_buckets(spark):
    schema = "office_id int, {} long, {} string, term_start string, term_end string, term_start_year int, term_end_year int"
    wiki = "https://en.wikipedia.org/wiki/"
    stored = spark.createDataFrame(
        [(1, 1, wiki + "A", "1990-01-01", None, None, None), (1, 2, wiki + "B", "1990-01-01", "1991-01-01", None, None), (1, 3, "No link:1:x", None, None, 1990, None), (1, 4, wiki + "D", None, None, 1990, 1991)],
        schema.format("term_id", "wiki_url"),
    )
    parsed = spark.createDataFrame(
        [(1, 10, wiki + "a", "1990-01-01", "1995-01-01", None, None), (1, 11, wiki + "B", "1990-01-01", "1991-01-01", None, None), (1, 12, wiki + "C", "1990-01-01", "present", None, None), (1, 13, wiki + "E", "Invalid date", "", None, None)],
        schema.format("row_id", "wiki_link"),
    ).withColumn("dead_link", F.lit(False))
    changes = diff.diff(stored, parsed)
    got = {(r["change_type"], r["term_id"], r["row_id"]) for r in changes.collect()}
    assert got == {("changed", 1, 10), ("unchanged", 2, 11), ("new", None, 12), ("placeholder", 3, None), ("vanished_real", 4, None)}
    assert diff.apply_diff(stored, parsed, changes).count() == 4
    assert {r["change_type"] for r in diff.diff(stored, parsed.limit(0)).collect()} == {"placeholder", "vanished_real"}
    assert diff.apply_diff(stored, parsed.limit(0), diff.diff(stored, parsed.limit(0))).count() == 4


def test_votes(spark):
    rows = [(1, "a", True), (1, "b", True), (2, "a", False), (2, "b", False), (3, "a", True), (3, "b", False), (4, "a", True), (4, "b", None)]
    df = spark.createDataFrame(rows, "s int, provider string, is_valid boolean").withColumn("concerns", F.array(F.lit("c")))
    got = {r["s"]: (r["verdict"], r["concerns"]) for r in quality.verdicts(df, "s").collect()}
    assert got == {1: ("valid", ["c"]), 2: ("invalid", ["c"]), 3: ("disagreement", ["c"]), 4: ("insufficient_quorum", ["c"])}


def test_notable_without_sources(spark):
    sources = spark.createDataFrame([(1, "https://court.gov/a", "Government"), (1, "https://court.gov/b", "news")], "k int, source_url string, source_type string")
    people = spark.createDataFrame([(1, "1999"), (2, "1999")], "k int, term_dates string")
    got = quality.notable(sources, people, "k").select("k", "n_sources", "is_notable")
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (2, 0, False)]


def test_upsert_twice_is_once(spark):
    stored = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k int, y int, v string")
    new = spark.createDataFrame([(1, None, "A"), (3, 1, "c")], "k int, y int, v string")
    once = writes.upsert(stored, new, "k", "y")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, None, "A"), (2, 5, "b"), (3, 1, "c")], key=str)
    assert sorted(map(tuple, writes.upsert(once, new, "k", "y").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert writes.upsert(stored, new, "k", "y", faithful=True).count() == 4


def test_guarded_delete(spark):
    t = spark.range(5).withColumnRenamed("id", "k")
    left, refused = writes.delete_unreferenced(t, t.filter("k < 3"), "k", {"fk": spark.createDataFrame([(1,)], "fk long")})
    assert sorted(r["k"] for r in left.collect()) == [1, 3, 4] and [r["k"] for r in refused.collect()] == [1]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        writes.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_office_file(spark, tmp_path):
    path = tmp_path / "offices.csv"
    names = list(files.OFFICE_HEADERS)
    good = {"Country": "US", "Name": "Mayor", "URL": "https://x", "Table No": "2", "Link Column": "oops", "Dynamic Parse": "yes"}
    path.write_text("\n".join([",".join(names), ",".join(good.get(n, "") for n in names), ",".join("" for _ in names[:-1]) + ",x"]))
    typed = files.offices(files.read_csv(spark, str(path), files.OFFICE_HEADERS))
    row = typed.filter("ok").first()
    assert (row["table_no"], row["link_column"], row["dynamic_parse"], row["parse_rowspan"]) == (2, 1, 1, 0)
    assert tuple(files.import_counts(typed).first()) == (1, 1)


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    entry = {"name": "a", "test_type": "bio", "html_file": "x/a.html", "enabled": 1}
    path.write_text(json.dumps([entry, {**entry, "name": "b", "html_file": "../a"}, {**entry, "name": "c", "test_type": "?"}]))
    m = files.read_manifest(spark, str(path))
    assert {r["name"]: r["problem"] for r in m.collect()} == {"a": None, "b": "html_file is not a relative path", "c": "unknown test_type"}
    stored = m.filter("name = 'a'").drop("problem").withColumn("source_url", F.lit("kept"))
    assert files.import_manifest(stored, m).filter("source_url = 'kept'").count() == 1
    assert files.import_manifest(stored, m, overwrite=True).filter("source_url = 'kept'").count() == 0


def test_in_scope_and_search(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    bridge = spark.createDataFrame([(1, 7), (2, 8), (2, 7)], "k int, level int")
    assert sorted(r["k"] for r in lookup.in_scope(items, {"level": (bridge, 8)}, "k").collect()) == [2, 3]
    assert sorted(r["k"] for r in lookup.in_scope(items, {"level": (bridge, None)}, "k").collect()) == [3]
    assert lookup.search(items.withColumn("n", F.lit("ab")), "a", "n", key="k").count() == 0


def test_biography_paragraph(spark):
    page = spark.createDataFrame([("<p><b>Ann B</b> May 1, 1990 – June 2, 1991",)], "html string")
    b = page.select(infobox.biography(html.html_page(F.col("html")), F.lit("https://x/wiki/Ann")).alias("b")).first()["b"]
    assert tuple(b) == ("Ann B", None, "Invalid date", "1991-06-02", "Ann") or b["death_date"] == "1991-06-02"


def test_landing_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "u", "old", "2024-01-01"), (1, "u", "new", "2024-01-02"), (2, "v", "x", "2024-01-01")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "page_id long, url string, html string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).write.mode("append").parquet(folder)
    run = landing.run_incrementally(landing.landed_pages(spark, folder), str(tmp_path / "cp"), lambda df, n: df.write.mode("append").parquet(out))
    run.awaitTermination(120)
    assert {(r["page_id"], r["html"]) for r in spark.read.parquet(out).collect()} == {(1, "new"), (2, "x")}


def test_special_words_are_not_left_to_the_free_form_parser(spark):
    """A text is judged once: what is settled is not sent to Python."""
    cases = {"May 1, 1990 – present": [None, None], "1 May 1990 to Spring 1991": [None, "Spring 1991"], "in office May 1, 1990 - Incumbent[a]": [None, None]}
    assert [r[0] for r in values(spark, cases, dates.loose_ranges(F.col("v")))] == list(cases.values())
    assert [r[0] for r in values(spark, ["n/a", "5/1/1990"], dates.loose_singles(F.col("v")))] == [[None], ["5/1/1990"]]
    years = ["May 1, 0000", "February 30, 1990", "31\tDecember  1999", "Sep\n7,\t2001"]
    assert [r[0] for r in values(spark, years, dates.format_date(F.col("v")))] == ["0000-05-01", dates.INVALID, "1999-12-31", "2001-09-07"]


def test_free_forms_parse_each_text_of_a_batch_once(monkeypatch):
    asked = []
    monkeypatch.setattr(dates, "_parsed", lambda text: (asked.append(text), "1990-05-01" if text.startswith("1 May") else None)[1])
    rows = pa.array([["spring", None], None, [], ["spring", "1 May 1990", "1 May 1990"], ["soon", "spring"]], pa.list_(pa.string()))
    assert dates._free_forms.func(rows).to_pylist() == [[], [], [], [("1 May 1990", "1990-05-01")], []]
    assert sorted(asked) == ["1 May 1990", "soon", "spring"]
    assert dates._free_forms.func(rows[:3]).to_pylist() == [[], [], []] and dates._free_forms.func(rows[1:1]).to_pylist() == []
