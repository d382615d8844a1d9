"""CSV and JSON sources with bad rows counted, manifests, nested exports, cached pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, urls

# Fixed value: the headers of an office file.
OFFICE_HEADERS = (
    "Country", "Level", "Branch", "Department", "Name", "State", "URL", "Table No", "Table Rows", "Link Column", "Party Column",
    "Term Start Column", "Term End Column", "District", "Dynamic Parse", "Read columns right to left", "Find Date", "Parse Rowspan",
    "Consolidate Rowspan Terms", "Rep Link", "Party Link", "Notes", "Alt Link",
)
PARTY_HEADERS = ("Country", "Party name", "Party link")
MANIFEST = "name string, test_type string, html_file string, source_url string, config_json string, expected_json string, enabled int"
TEST_TYPES = ("table_config", "infobox", "bio")


#: What a CSV reader can't fit into its columns.
CORRUPT = "_corrupt"
# Fixed value: the keys of a manifest's entries.
MANIFEST_KEYS = ("name", "test_type", "html_file", "source_url", "config_json", "expected_json", "enabled")


def read_lines(spark: SparkSession, path: str, headers: tuple[str, ...], header: bool = True) -> DataFrame:
    """A CSV file, all columns as text, and CORRUPT: the line if it has too few or too many cells or an open quote, else null."""
    schema = ", ".join(f"`{h}` string" for h in (*headers, CORRUPT))
    return spark.read.csv(path, header=header, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)


def rejects(raw: DataFrame, *required: str) -> DataFrame:
    """The lines of read_lines with `reason`: why a line is not imported; null for those that are."""
    lacking = [F.when(F.trim(F.coalesce(F.col(f"`{h}`"), F.lit(""))) == "", F.lit(f"no {h}")) for h in required]
    return raw.withColumn("reason", F.coalesce(F.when(F.col(CORRUPT).isNotNull(), "malformed line"), *lacking))


def manifest_entries(texts: DataFrame, text: str, *carried: str) -> DataFrame:
    """The carried columns, index and entry (variant): the elements of manifests; one row with a null entry if a text is no JSON array."""
    parsed = texts.select(*carried, F.try_parse_json(text).alias("_v"))
    is_list = F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY"))
    whole = F.when(is_list, F.try_variant_get("_v", "$", "array<variant>"))
    return parsed.select(*carried, F.posexplode(F.coalesce(whole, F.array(F.lit(None).cast("variant")))).alias("index", "entry"))


def manifest_errors(entries: DataFrame, entry: str, existing: DataFrame, path: str) -> DataFrame:
    """`errors` of manifest entries (variant): all that is wrong with each, none if it is valid.

    existing: the relative paths of the files there are, such as those of a listing (`listed_files`).
    """
    v = F.col(entry)
    of = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    kind = lambda key: F.coalesce(F.regexp_extract(F.schema_of_variant(of(key)), r"^\w+", 0), F.lit("VOID"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    missing = F.filter(F.array(*[F.when(of(k).isNull(), F.lit(k)) for k in MANIFEST_KEYS]), lambda k: k.isNotNull())
    file = F.when(kind("html_file") == "STRING", F.trim(F.try_variant_get(v, "$.html_file", "string")))
    known = existing.select(F.col(path).alias("_file")).distinct().withColumn("_there", F.lit(True))
    typed = [F.when(~kind(k).isin("OBJECT", "ARRAY"), F.concat(F.lit(f"{k} must be a JSON object or array, got "), F.lower(kind(k)))) for k in ("config_json", "expected_json")]
    no_file = (
        F.when(F.coalesce("_file", F.lit("")) == "", "html_file must be a non-empty string")
        .when(F.startswith("_file", F.lit("/")), "html_file must be a relative path")
        .when(F.col("_there").isNull(), "html_file does not exist")
    )
    lacks = F.when(F.size(missing) > 0, F.concat(F.lit("missing required keys: "), F.array_join(missing, ", ")))
    found = F.filter(F.array(lacks, no_file, *typed), lambda e: e.isNotNull())
    judged = entries.withColumn("_file", file).join(known, "_file", "left")
    return judged.withColumn("errors", F.when(is_object, found).otherwise(F.array(F.lit("manifest entry must be a JSON object")))).drop("_file", "_there")


def listed_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path: the files below a folder that fit a pattern, relative to it; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    bare = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    local = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return found.select(F.substring(local, F.length(bare) + 2, F.length(local)).alias("path"))


def read_csv(spark: SparkSession, path: str, headers: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header row, all columns as text."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{h}` string" for h in headers), enforceSchema=False, multiLine=True)


def offices(raw: DataFrame) -> DataFrame:
    """Office rows as typed columns, with `ok`: whether the row can be imported."""
    c = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))
    number = {"Table No": 1, "Table Rows": 4, "Link Column": 1, "Party Column": 0, "Term Start Column": 4, "Term End Column": 5, "District": 0}
    flags = ("Dynamic Parse", "Read columns right to left", "Find Date", "Parse Rowspan", "Consolidate Rowspan Terms", "Rep Link", "Party Link")
    texts = ("Country", "Level", "Branch", "Department", "Name", "State", "URL", "Notes", "Alt Link")
    typed = raw.select(
        *[c(h).alias(rules_name(h)) for h in texts],
        *[rules.whole_number(c(h), d).alias(rules_name(h)) for h, d in number.items()],
        *[rules.flag(c(h)).alias(rules_name(h)) for h in flags],
    )
    return typed.withColumn("ok", (F.col("country") != "") & (F.col("name") != "") & (F.col("url") != ""))


def rules_name(header: str) -> str:
    return header.lower().replace(" ", "_")


def parties(raw: DataFrame) -> DataFrame:
    c = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))
    typed = raw.select(c("Country").alias("country"), c("Party name").alias("name"), c("Party link").alias("link"))
    return typed.withColumn("ok", (F.col("country") != "") & (F.col("name") != "") & (F.col("link") != ""))


def import_counts(typed: DataFrame) -> DataFrame:
    """(imported, errors)."""
    return typed.agg(F.count_if("ok").alias("imported"), F.count_if(~F.col("ok")).alias("errors"))


def import_parties(stored: DataFrame, typed: DataFrame, overwrite: bool = False) -> DataFrame:
    """Stored parties (country, name, link) after an import of the rows that are ok; with overwrite all stored ones go first."""
    fresh = typed.filter("ok").drop("ok").dropDuplicates(["country", "name"])
    if overwrite:
        return fresh.select(*stored.columns)
    return stored.unionByName(fresh.join(stored, ["country", "name"], "left_anti"))


def seeded(stored: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """A reference table with the seed rows whose key it lacks."""
    return stored.unionByName(rows.dropDuplicates(list(key)).join(stored, list(key), "left_anti"))


def judged_manifest(raw: DataFrame) -> DataFrame:
    """Manifest entries with `problem`, which says why an entry is not valid."""
    relative = ~F.col("html_file").rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)")
    problem = (
        F.when(F.coalesce("name", F.lit("")) == "", "no name")
        .when(~F.coalesce(F.col("test_type").isin(*TEST_TYPES), F.lit(False)), "unknown test_type")
        .when(~F.coalesce(relative, F.lit(False)), "html_file is not a relative path")
    )
    return raw.withColumn("problem", problem)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Golden tests out of a JSON file, judged."""
    return judged_manifest(spark.read.json(path, schema=MANIFEST, multiLine=True))


def export_manifest(stored: DataFrame) -> DataFrame:
    """A JSON text for each stored test, as a manifest holds it."""
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
    return stored.select("name", F.to_json(F.struct(*names)).alias("entry"))


def seed_manifest(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries if nothing is stored, else what is stored."""
    some = stored.agg((F.count("*") > 0).alias("_some"))
    valid = entries.filter("problem IS NULL").drop("problem").dropDuplicates(["name"])
    # one row, so the product is as large as the entries
    return stored.unionByName(valid.join(F.broadcast(some), ~F.col("_some")).select(*stored.columns))


def import_manifest(stored: DataFrame, entries: DataFrame, overwrite: bool = False) -> DataFrame:
    """Stored tests after an import: new names are added; with overwrite, entries replace those of their name."""
    valid = entries.filter("problem IS NULL").drop("problem").dropDuplicates(["name"])
    if overwrite:
        return stored.join(valid, "name", "left_anti").unionByName(valid)
    return stored.unionByName(valid.join(stored, "name", "left_anti").select(*stored.columns))


def export_tree(pages: DataFrame, offices_: DataFrame, links: DataFrame, tables: DataFrame) -> DataFrame:
    """page -> offices -> (alt_links, tables) as one JSON text for each page; arrays in the order of ids."""
    link_lists = links.groupBy("office_id").agg(F.sort_array(F.collect_list("link_path")).alias("alt_links"))
    table_lists = tables.groupBy("office_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in tables.columns if c != "office_id"]))).alias("tables"))
    none = F.array()
    full = offices_.join(link_lists, "office_id", "left").join(table_lists, "office_id", "left")
    full = full.withColumn("alt_links", F.coalesce("alt_links", none.cast("array<string>")))
    office = F.struct("office_id", "name", "alt_links", "tables")
    grouped = full.groupBy("page_id").agg(F.sort_array(F.collect_list(office)).alias("offices"))
    return pages.join(grouped, "page_id", "left").select("page_id", F.to_json(F.struct(*pages.columns, "offices")).alias("tree"))


def cached(pages: DataFrame, table_no: Column, full_page: Column) -> DataFrame:
    """Rows of a page cache, keyed by link, table and mode."""
    return pages.withColumn("cache_key", rules.cache_key(F.col("url"), table_no, full_page))


def live_cache(cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """What age leaves in the cache."""
    return cache.filter(F.col("fetched_at") >= as_of - F.make_interval(days=F.lit(days)))


def member_pages(links: DataFrame, pages: DataFrame, url: Column) -> DataFrame:
    """The pages of the distinct links, each with the place where its link is met first."""
    firsts = links.select(url.alias("url"), "ord").filter("url IS NOT NULL").groupBy("url").agg(F.min("ord").alias("ord"))
    return firsts.join(pages, "url", "left")


def first_seen(links: DataFrame, url: str, order: str) -> DataFrame:
    """The distinct links by their normalized form (the link itself where there is none), each with the place it is met first and a file name.

    Blank links are left out.  Returns url (normalized), ord and file.
    """
    trimmed = F.trim(F.col(url))
    normal = F.coalesce(urls.normalize_wiki_url(trimmed), trimmed)
    last = F.regexp_replace(F.element_at(F.split("url", "/"), -1), "[^a-zA-Z0-9._-]+", "_")
    firsts = links.filter(trimmed != "").select(normal.alias("url"), F.col(order).alias("ord")).groupBy("url").agg(F.min("ord").alias("ord"))
    return firsts.withColumn("file", F.coalesce(F.nullif(last, F.lit("")), F.concat(F.lit("member_"), F.col("ord").cast("string"))))


def primed_cache(cache: DataFrame, pages: DataFrame, fetched_at: Column) -> DataFrame:
    """The cache (cache_key, html, fetched_at) after pages with a cache_key were written to it; what was there before gives way."""
    fresh = pages.select("cache_key", "html", fetched_at.alias("fetched_at"))
    return cache.join(fresh, "cache_key", "left_anti").unionByName(fresh)


def read_through(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (cache_key, ...) with the html of the cache, and `hit`; misses are to be fetched."""
    held = cache.select("cache_key", "html", F.lit(True).alias("hit"))
    return wanted.join(held, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def with_source(reports: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Reports that end with the page's raw HTML (pages: keys, html); a page without HTML has an empty one."""
    whole = F.concat("report", F.lit("\nhtml=\n"), F.coalesce("html", F.lit("")))
    return reports.join(pages.select(*keys, "html"), [*keys], "left").withColumn("report", whole).drop("html")


def write_texts(texts: DataFrame, folder: str, key: str, text: str) -> None:
    """Each text as a file of its own below folder/key=..., written by the tasks; keys have to be distinct, null texts are empty."""
    rows = texts.select(F.coalesce(text, F.lit("")).alias("value"), key)
    # a task has the rows of a key together, so a key is one file
    rows.repartition(key).write.partitionBy(key).option("lineSep", "\x00").mode("overwrite").text(folder)


def read_texts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, text) of a folder that write_texts has written."""
    return spark.read.text(folder, wholetext=True).select(key, F.rtrim("value", F.lit("\x00")).alias("text"))


def write_snapshot(pages: DataFrame, folder: str) -> DataFrame:
    """The HTML of pages (page_id, url, html) as files below folder/html, and folder/index: page_id, url, ord, file, sha256, n_chars; returns the index.

    Members are the distinct normalized links, each by the page that has it first.
    """
    firsts = first_seen(pages, "url", "page_id")
    members = firsts.join(pages.select(F.col("page_id").alias("ord"), "html").dropDuplicates(["ord"]), "ord").withColumn("page_id", F.col("ord"))
    write_texts(members, f"{folder}/html", "page_id", "html")
    html = F.coalesce("html", F.lit(""))
    index = members.select("page_id", "url", "ord", "file", F.sha2(html, 256).alias("sha256"), F.length(html).alias("n_chars"))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def debug_report(rows: DataFrame, config: dict[str, object], *keys: str) -> DataFrame:
    """`report`: for each page the config, the number of rows and the rows (row_index, col_index, text) as lines of text."""
    lines = rows.groupBy(*keys, "row_index").agg(F.sort_array(F.collect_list(F.struct("col_index", "text"))).alias("cells"))
    line = F.concat(F.col("row_index").cast("string"), F.lit(": "), F.array_join(F.transform("cells", lambda c: c["text"]), " | "))
    pages = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_index", line.alias("line")))).alias("lines"))
    head = [F.lit(f"{name}={value}") for name, value in config.items()]
    text = F.concat(F.array(*head, F.concat(F.lit("rows="), F.size("lines").cast("string"))), F.transform("lines", lambda x: x["line"]))
    return pages.select(*keys, F.array_join(text, "\n").alias("report"))
