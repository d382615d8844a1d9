"""Configs and role queries as rows, rowspans, nearest match in one line, holder sets as bitmaps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldstone.operators import extract, infobox, lookup, ordered
from fieldstone.sources import html


def table(spark, *rows, page=1):
    text = "<table><tr><th>a" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) for r in rows) + "</table>"
    return html.table_rows(spark.createDataFrame([(page, text)], "page int, html string"), "page")


def link(name):
    return f"<a href='/wiki/{name}'>{name}</a>"


def out(df, *columns):
    return [tuple(r) for r in df.orderBy("row_index").select(*columns).collect()]


SPAN = {"table_rows": 4, "link_column": 0, "district_column": 1, "term_start_column": 2, "term_end_column": 3, "parse_rowspan": True}


@pytest.mark.parametrize("as_rows", [False, True])
def test_rowspan_goes_on_the_last_row_that_gave_a_term(spark, as_rows):
    """A file, an ignored link and a party's link stand between Ann and her second term."""
    rows = table(
        spark,
        ("May 1, 1980 – May 2, 1981", "note"),  # nothing to go on
        (link("Ann"), "1st", "May 1, 1990", "May 1, 1991"),
        ("<a href='/wiki/File:x.png'>x</a>", "2nd", "May 1, 1991", "May 1, 1992"),
        (link("Whig_Party"), "3rd", "May 1, 1991", "May 1, 1992"),
        ("no link", "4th", "May 1, 1991", "May 1, 1992"),
        ("May 1, 1993 – May 1, 1994", "note"),
        ("May 1, 1995 – May 1, 1996", "9th"),
        ("May 1, 1997", "May 1, 1998", "note"),
        (link("Bob"), "whole", "May 1, 1999", "present"),
        ("note", "nothing"),
    )
    if as_rows:
        units = spark.createDataFrame([(1, 5)], "page int, unit int").withColumns({k: F.lit(v) for k, v in {**SPAN, "ignore_non_links": True}.items()})
        got = extract.extract_units(rows, units, "page", "unit")
    else:
        got = extract.extract(rows, extract.Config(**SPAN, ignore_non_links=True), "page")
    wiki = "https://en.wikipedia.org/wiki/"
    assert [r for r in out(got, "wiki_link", "district", "term_start", "term_end", "continued")] == [
        (wiki + "Ann", "1st", "1990-05-01", "1991-05-01", False),
        (wiki + "Ann", "1st", "1993-05-01", "1994-05-01", True),
        (wiki + "Ann", "9th", "1995-05-01", "1996-05-01", True),
        (wiki + "Ann", "9th", "1997-05-01", "1998-05-01", True),
        (wiki + "Bob", "No district", "1999-05-01", "present", False),
        (wiki + "Bob", "No district", "Invalid date", "Invalid date", True),
    ]


def test_party_goes_on_under_a_rowspan(spark):
    rows = table(
        spark,
        (link("Ann"), "1st", "May 1, 1990", "May 1, 1991", "Whig"),
        ("May 1, 1993 – May 1, 1994", "note"),
        ("May 1, 1995 – May 1, 1996", "a Tory"),
        ("May 1, 1997 – May 1, 1998", "note"),
        (link("Bob"), "1st", "May 1, 1990", "May 1, 1991", "none"),
        ("May 1, 1993 – May 1, 1994", "note"),
    )
    parties = spark.createDataFrame([("US", "Tory", None), ("US", "Whig", None)], "country string, name string, link string")
    terms = extract.extract(rows, extract.Config(**SPAN, party_column=4), "page")
    assert [r[0] for r in out(extract.resolve_parties(terms, parties, F.lit("US"), "page"), "party")] == ["Whig", "Whig", "Tory", "Tory", "No party", "No party"]
    ignored = extract.extract(rows, extract.Config(**SPAN, party_column=4, party_ignore=True, district_at_large=True), "page")
    assert {r for r in out(extract.resolve_parties(ignored, parties, F.lit("US"), "page"), "party", "district")} == {(None, "At-Large")}


def test_units_with_odd_fields(spark):
    """Null and missing fields have their defaults; columns out of range give nothing; a page may have many units, a unit no table."""
    rows = table(spark, (link("Ann"), "May 1, 1990", "May 1, 1991", "Judge"), (link("Bob"), "May 1, 1992", "present", "Clerk"), ("Cy", "x", "y", "Judge"))
    units = spark.createDataFrame(
        [(1, 10, 1, 3, 3, "judge", 0), (1, 11, None, None, None, None, None), (1, 12, 1, 3, 90, "judge", 0), (1, 13, 7, 3, None, None, None), (1, 14, 1, 3, -1, "x", 50), (2, 15, 1, 3, None, None, None)],
        "page int, unit int, table_no int, table_rows int, filter_column int, filter_criteria string, link_column int",
    ).withColumn("unknown_field", F.lit(1))
    got = extract.extract_units(rows, units, "page", "unit").select("unit", "name_from_table", "wiki_link", "term_start").collect()
    wiki = "https://en.wikipedia.org/wiki/"
    assert sorted(tuple(r) for r in got if r["unit"] in (10, 11)) == [
        (10, "Ann", wiki + "Ann", "1990-05-01"), (10, "Cy", "No link", "Invalid date"),
        (11, "Ann", wiki + "Ann", "1990-05-01"), (11, "Bob", wiki + "Bob", "1992-05-01"), (11, "Cy", "No link", "Invalid date"),
    ]
    assert {r["unit"] for r in got} == {10, 11, 14} and {(r["name_from_table"], r["wiki_link"]) for r in got if r["unit"] == 14} == {(None, "No link")}
    assert extract.extract_units(rows, units.filter("false"), "page", "unit").count() == 0


def test_units_scan_once(spark, sf_dir):
    from fieldstone.plans import QUERIES

    plan = QUERIES["unit_terms"].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"html_tables|run\(html|PythonUDF|ArrowEvalPython", plan)) <= 4 and "Union" not in plan


def plain_role(raw):
    """(includes, excludes) or an error."""
    words = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    text, includes, excludes, error = (raw or "").strip(), [], [], None
    for sign, quoted in re.findall('(-?)"([^"]*)"', text):
        if not words(quoted):
            return "empty quoted part in role query"
        (excludes if sign else includes).append(words(quoted))
    rest = re.sub('-?"[^"]*"', " ", text).strip()
    if '"' in rest:
        return "unbalanced quote in role query"
    if re.search(r"(^|\s)-", rest):
        return "an exclusion needs a quoted phrase"
    return includes + [words(rest)] * bool(words(rest)), excludes


def test_role_queries_as_rows(spark):
    rng = random.Random(2)
    parts = ['"judge"', '-"chief judge"', "mayor", '"', '""', "-x", '-"a"', " ", '"The  Judge!"', "é", '-"deputy"', "of"]
    roles = [None, "", *(" ".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(150))]
    texts = ["A Judge of x", "Chief  Judge", "judges", None, "", "Mayor", "the judge, deputy of a", "é!"]
    rows = [(i, r, t) for i, (r, t) in enumerate((r, t) for r in roles for t in texts)]
    df = spark.createDataFrame(rows, "i int, role string, t string").withColumn("q", infobox.role_query(F.col("role")))
    for r in df.select("role", "t", "q", infobox.role_matches(F.col("t"), F.col("q")).alias("ok")).collect():
        want = plain_role(r["role"])
        if isinstance(want, str):
            assert (r["q"]["error"], r["ok"]) == (want, False), r
            continue
        assert (r["q"]["includes"], r["q"]["excludes"], r["q"]["error"]) == (*want, None), r
        hay = f" {' '.join(re.findall('[a-z0-9]+', (r['t'] or '').lower()))} "
        has = lambda ps: any(f" {p} " in hay for p in ps)  # noqa: B023, E731
        assert r["ok"] == ((not want[0] and not want[1]) or ((not want[0] or has(want[0])) and not has(want[1]) and hay.strip() != "")), r


def test_one_bad_role_for_all_is_raised(spark):
    pages = spark.createDataFrame([(1,)], "k int").withColumn("page", html.html_page(F.lit("<p>x")))
    with pytest.raises(ValueError, match="unbalanced"):
        infobox.infobox_terms(pages, spark.createDataFrame([(1, "/wiki/A")], "k int, office_path string"), "k", role='"x')


def plain_nearest(rows, stored):
    found = {}
    for key, row, year in rows:
        own = [(i, y or 0) for k, i, y in stored if k == key]
        found[row] = min(own, key=lambda s: (abs(year - s[1]) if year else 0, s[0]))[0] if own and key is not None else None
    return found


def test_nearest(spark):
    rng = random.Random(6)
    year = lambda: rng.choice([None, 0, *range(1900, 1960)])
    rows = [(rng.choice([None, *range(6)]), i, year()) for i in range(400)]
    stored = [(rng.choice([None, *range(5)]), 1000 + i, year()) for i in range(150)]
    got = lookup.nearest(spark.createDataFrame(rows, "k int, row_id int, y int"), spark.createDataFrame(stored, "k int, term_id int, sy int"), "k", "row_id", "y", "term_id", "sy")
    assert got.columns == ["k", "row_id", "y", "term_id", "sy"]
    assert {r["row_id"]: r["term_id"] for r in got.collect()} == plain_nearest(rows, stored)


def test_nearest_of_a_hot_key(spark):
    """100,000 terms and as many rows of one holder: their pairs would be ten thousand million."""
    n = 100_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("row_id"), (1000 + F.col("id") % 997).alias("y"))
    stored = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("term_id"), (1000 + F.col("id") % 500).alias("sy"))
    got = lookup.nearest(rows, stored, "k", "row_id", "y", "term_id", "sy").agg(F.count("*"), F.sum(F.abs(F.col("y") - F.col("sy"))), F.max("term_id")).first()
    assert tuple(got) == (n, sum(max(0, i % 997 - 499) for i in range(n)), 499)


def test_holder_sets(spark):
    rng = random.Random(9)
    stored = [(rng.randrange(4), rng.choice(["", None, *(f"h{i}" for i in range(60))])) for _ in range(300)]
    parsed = [(rng.randrange(5), rng.randrange(4), rng.choice(["", None, *(f"h{i}" for i in range(80))])) for _ in range(400)]
    coarse = lambda h: h and h[:2]
    got = ordered.table_scores(
        spark.createDataFrame([(k, h, coarse(h)) for k, h in stored], "k int, h string, c string"), spark.createDataFrame([(k, t, h, coarse(h)) for k, t, h in parsed], "k int, t int, h string, c string"), "k", "t", "h", "c"
    )
    assert {tuple(r) for r in got.collect()} == {
        (k, t, sum(p[:2] == (k, t) for p in parsed), len(own), len(own - had), len({coarse(h) for h in own} - {coarse(h) for h in had}))
        for k, t in {p[:2] for p in parsed}
        for own in [{h for j, h in stored if j == k and h}]
        for had in [{h for j, u, h in parsed if (j, u) == (k, t) and h}]
    }


def test_many_holders_of_one_key(spark):
    """More holders than one bitmap has places, in every part."""
    n = 3_000_000
    stored = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("h"), (F.col("id") % 7).cast("string").alias("c"))
    parsed = stored.filter("h % 3 > 0").withColumn("t", F.lit(2))
    assert [tuple(r) for r in ordered.table_scores(stored, parsed, "k", "t", "h", "c").collect()] == [(1, 2, n - n // 3, n, n // 3, 0)]


def test_shifted_tables(spark):
    scores = spark.createDataFrame(
        [(1, 1, 9, 10, 5, 5), (1, 2, 9, 10, 4, 6), (1, 3, 9, 10, 4, 5), (2, 1, 9, 10, 4, 0), (3, 2, 1, 10, 0, 0), (3, 3, 9, 10, 0, 0), (4, 1, 9, 10, 6, 3), (4, 2, 5, 10, 6, 3), (5, 1, 9, 10, 6, 3), (5, 2, 5, 10, 6, 2), (5, 3, 6, 10, 6, 2)],
        "k int, t int, n_rows int, n_stored int, missing int, missing_coarse int",
    )
    got = ordered.shifted_tables(scores, spark.createDataFrame([(k, 1) for k in range(1, 6)], "k int, t int"), "k", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 5, 3, 4), (3, 1, 10, 2, 0), (4, 1, 6, None, None), (5, 1, 6, 3, 6)]


def test_the_column_of_a_link_is_computed_once_a_row(spark):
    """The filters after the shift of columns had each computed it anew."""
    rows = table(spark, ("note", link("Ann"), "May 1, 1990", "present"))
    config = extract.Config(table_rows=4, link_column=0, term_start_column=1, term_end_column=2, dynamic_parse=True)
    df = extract.extract(rows, config, "page")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    # three stand in the expression, as nullif writes its argument twice; there had been twelve
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 3
    assert out(df, "wiki_link", "term_start", "term_end") == [("https://en.wikipedia.org/wiki/Ann", "1990-05-01", "present")]


def test_parties_are_found_without_reading_the_rows_again(spark, sf_dir, monkeypatch):
    """party_links parsed its pages four times, once for each side of its joins; those remain for more parties than a block of names holds."""
    from fieldstone.operators import lookup
    from fieldstone.plans import QUERIES

    run = QUERIES["party_links"].run
    whole = run(spark, sf_dir)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 2
    monkeypatch.setattr(lookup, "NAMES_BLOCK", 10)
    assert sorted(map(tuple, run(spark, sf_dir).collect())) == sorted(map(tuple, whole.collect()))
