"""Canonical forms of links to encyclopedia pages and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import once

# Fixed values that results depend on.
WIKI_HOST = "wikipedia.org"
WIKI_BASE = "https://en.wikipedia.org"
NO_LINK = "No link"
MIRROR_DOMAINS = ("wikipedia.org", "en.m.wikipedia.org", "wikimedia.org", "wikidata.org", "wikiwand.com", "dbpedia.org", "wiki2.org")
IGNORED_LINKS = (
    r"/wiki/\d{1,3}(th|st|nd|rd)_United_States_Congress",
    r"/wiki/[^/]*_(\d{1,2}(th|st|nd|rd)|at-large)_congressional_district",
    r"/wiki/\d{4}_[\w\d]+_elections_in_[\w\d]+",
    r"/wiki/\d{4}_[\w\d]+_election",
    r"/wiki/(19|20)\d{2}(_\d)?$",
)

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Fixed value: links to parties are not links to persons.
PARTY_PAGE = r"(?U)/wiki/[\w%]+_Party(?:_\([^)]*\))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, k)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _normal(url: Column) -> Column:
    """struct(scheme, host, path, rest) of a link to the encyclopedia, its host clean and its path under /wiki/; else null."""

    def judged(u: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(F.lower(_part(u, 1)), F.lit("")), F.lit("https")).alias("scheme"),
            F.rtrim(F.regexp_replace(_part(u, 2), r"\.+$", "")).alias("host"),
            F.regexp_replace(F.trim(_part(u, 3)), "/+$", "").alias("path"),
            F.concat(_part(u, 4), _part(u, 5)).alias("rest"),
        )

    def placed(p: Column) -> Column:
        parts = _segments(p["path"])
        path = F.when(F.size(parts) == 1, F.concat(F.lit("/wiki/"), F.get(parts, 0))).otherwise(p["path"])
        return F.when(F.instr(p["host"], WIKI_HOST) > 0, F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), path.alias("path"), p["rest"].alias("rest")))

    return once(once(url, judged), placed)


def normalize_wiki_url(url: Column) -> Column:
    """The link with a clean host and a /wiki/ path; null if it is not to the encyclopedia."""
    return once(_normal(url), lambda n: F.concat(n["scheme"], F.lit("://"), n["host"], n["path"], n["rest"]))


def unquoted(text: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus; malformed escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _title(path: Column) -> Column:
    """The decoded title of a path /wiki/<title>; null for other paths."""
    parts = _segments(path)
    return F.when((F.size(parts) >= 2) & (F.lower(F.get(parts, 0)) == "wiki"), unquoted(F.get(parts, 1)))


def canonical_holder(url: Column) -> Column:
    """A key under which links to the same page are equal: /wiki/<title in lower case>."""

    def keyed(x: Column) -> Column:
        key = F.concat(F.lit("/wiki/"), F.lower(F.trim(F.replace(x["title"], F.lit(" "), F.lit("_")))))
        other = F.concat(F.lit("https://"), F.lower(x["n"]["host"]), x["n"]["path"])
        return F.when(x["bare"].startswith("No link:") | x["n"].isNull(), x["bare"]).otherwise(F.coalesce(key, other))

    def titled(bare: Column) -> Column:
        return once(_normal(bare), lambda n: once(F.struct(bare.alias("bare"), n.alias("n"), _title(n["path"]).alias("title")), keyed))

    return once(F.trim(F.coalesce(url, F.lit(""))), titled)


def rest_html_url(url: Column) -> Column:
    """The address of a page's HTML; null if the link is to no page."""

    def address(n: Column) -> Column:
        return F.concat(n["scheme"], F.lit("://"), n["host"], F.lit("/w/rest.php/v1/page/"), F.nullif(_title(n["path"]), F.lit("")), F.lit("/html"))

    return once(_normal(url), address)


def page_path(url: Column) -> Column:
    """The last segment of a link's path."""
    return F.trim(F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1))


def alt_link_path(link: Column) -> Column:
    """A stored alternative link as a path; 'none' and blanks as an empty text."""
    bare = F.trim(F.coalesce(link, F.lit("")))
    return (
        F.when((bare == "") | (F.lower(bare) == "none"), "")
        .when(bare.rlike("^https?://"), _part(bare, 3))
        .when(bare.startswith("/"), bare)
        .otherwise(F.concat(F.lit("/wiki/"), bare))
    )


def infobox_path(href: Column) -> Column:
    """The path of a link inside an infobox."""
    bare = F.regexp_replace(F.trim(F.coalesce(href, F.lit(""))), r"[?#].*$", "")
    bare = once(bare, lambda b: F.when(b.rlike("^https?://"), _part(b, 3)).otherwise(F.regexp_replace(b, r"^\./", "")))

    def placed(b: Column) -> Column:
        return F.when(b == "", "").when(b.startswith("/wiki/"), b).when(b.startswith("/"), F.concat(F.lit("/wiki"), b)).otherwise(F.concat(F.lit("/wiki/"), b))

    return once(bare, placed)


def is_dead(url: Column) -> Column:
    return F.instr(F.lower(F.coalesce(url, F.lit(""))), "redlink=1") > 0


def is_ignored(path: Column) -> Column:
    return path.rlike("(?U)" + "|".join(IGNORED_LINKS))


def is_person_link(link: Column) -> Column:
    """Whether a row's link can be a person's page."""
    bare = F.trim(F.coalesce(link, F.lit("")))
    return (
        bare.startswith(f"{WIKI_BASE}/wiki/")
        & ~is_ignored(bare)
        & ~bare.rlike(PARTY_PAGE)
        & (F.instr(bare, "/wiki/File:") == 0)
        & (F.instr(bare, "/wiki/Special:") == 0)
    )


def holder_key(url: Column) -> Column:
    """The canonical link of a holder; blank for dead links, placeholders and none."""
    return once(F.trim(F.coalesce(url, F.lit(""))), lambda u: F.when(is_dead(u) | u.startswith("No link") | (u == ""), "").otherwise(canonical_holder(u)))


def placeholder_key(office_id: Column, name: Column) -> Column:
    return F.concat(F.lit("No link:"), office_id.cast("string"), F.lit(":"), F.trim(name))


def is_mirror(url: Column) -> Column:
    """Whether a link is to a mirror of the encyclopedia (the host itself or below it)."""
    host = F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    out = F.lit(False)
    for d in MIRROR_DOMAINS:
        out = out | (host == d) | host.endswith("." + d)
    return out
