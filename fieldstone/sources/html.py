"""Tables, cells, links, infoboxes and first paragraphs out of HTML.

`html_tables` and `html_page` are Arrow UDFs around one pass of the standard
library's parser; everything after them is Column expressions over nested arrays.
A cell or row that is not closed ends where the next one of its table begins.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.functions import arrow_udf

LINK = "struct<href:string,text:string>"
CELL = f"struct<text:string,text_sp:string,links:array<{LINK}>,sort_values:array<string>,is_header:boolean>"
TABLES = f"array<struct<table_no:int,rows:array<struct<row_index:int,cells:array<{CELL}>>>>>"
BOX_ROW = f"struct<label:string,value:string,text:string,links:array<{LINK}>>"
PAGE = f"struct<has_infobox:boolean,name:string,nickname:string,rows:array<{BOX_ROW}>,bold:string,paragraph:string>"

_ARROW_LINKS = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
_ARROW_CELL = pa.struct([("text", pa.string()), ("text_sp", pa.string()), ("links", _ARROW_LINKS), ("sort_values", pa.list_(pa.string())), ("is_header", pa.bool_())])
_ARROW_TABLES = pa.list_(pa.struct([("table_no", pa.int32()), ("rows", pa.list_(pa.struct([("row_index", pa.int32()), ("cells", pa.list_(_ARROW_CELL))])))]))
_ARROW_BOX = pa.struct([("label", pa.string()), ("value", pa.string()), ("text", pa.string()), ("links", _ARROW_LINKS)])
_ARROW_PAGE = pa.struct([("has_infobox", pa.bool_()), ("name", pa.string()), ("nickname", pa.string()), ("rows", pa.list_(_ARROW_BOX)), ("bold", pa.string()), ("paragraph", pa.string())])

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MARKED = ("span", "td", "th", "div")
_CLOSES = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "p": ("p",)}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self, *tags: str):
        """Nodes of these tags below this one, in document order."""
        todo = [x for x in reversed(self.children) if not isinstance(x, str)]
        while todo:
            x = todo.pop()
            if x.tag in tags:
                yield x
            if x.children:
                todo += [y for y in reversed(x.children) if not isinstance(y, str)]

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo.extend(reversed(x.children) if x.tag not in ("script", "style") else ())
            else:
                yield x

    def text(self, between: str = "") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


#: A tag without any oddity, and the text after it: HTMLParser takes all of these the same way.
_PLAIN = re.compile(
    r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)(?:((?:[ \t\r\n\f]+[a-zA-Z][-_:a-zA-Z0-9]*(?:="[^"]*"|='[^']*'|=[-_.:#%a-zA-Z0-9]+)?)*)[ \t\r\n\f]*|[ \t\r\n\f]*(/)))>([^<]*)"""
)
_ATTR = re.compile(r"""([a-zA-Z][-_:a-zA-Z0-9]*)(?:="([^"]*)"|='([^']*)'|=([-_.:#%a-zA-Z0-9]+))?""")
_ATTRS = r"""(?:[ \t\r\n\f]++[a-zA-Z][-_:a-zA-Z0-9]*+(?:="[^"]*+"|='[^']*+'|=[-_.:#%a-zA-Z0-9]++)?+)*+[ \t\r\n\f]*+"""
#: Elements whose content is no markup, by this version of HTMLParser or another.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
_OF_TABLES = ("table", "tbody", "thead", "tfoot", "tr", "td", "th")


def _other(*names: str) -> str:
    """A name that is none of these."""
    return f"(?!(?:{'|'.join(names)})(?![a-z0-9]))[a-z][a-z0-9]*+"


#: What HTMLParser drops up to the first bracket, whatever its version: declarations, unknown sections, instructions, and a comment of words alone.
_DROPPED = r"!(?:[a-zA-Z][^<>]*+|\[(?!(?i:temp|cdata|ignore|include|rcdata|if|else|endif))[^<>]*+|--[^-<>]++--)|\?[^<>]*+"
#: A tag that lost its bracket before the next one: an element of a name that nothing asks for.
_RUN_ON = "[a-z][a-z0-9]*+</[a-z][a-z0-9]*+"
#: In a cell: links that hold text alone, and what leaves the order of texts, links and marks as it is written, closed or not, as no such element ends the cell.
_INLINE = f"(?:<(?:a{_ATTRS}>[^<]*+</a|{_other('a', *_OF_TABLES, *sorted(_RAW))}{_ATTRS}|br[ \\t\\r\\n\\f]*+/|/{_other(*_OF_TABLES)}|{_DROPPED}|{_RUN_ON})>[^<]*+)*+"
#: A row of cells with text and such elements; a cell or a row may be closed by what follows it.
_FLAT_ROW = re.compile(
    f"<tr{_ATTRS}>[^<]*+((?:<(?:td{_ATTRS}>[^<]*+{_INLINE}(?:</td>[^<]*+)?+|th{_ATTRS}>[^<]*+{_INLINE}(?:</th>[^<]*+)?+))*+)(?:</tr>[^<]*+|(?=<tr>|</table>))"
)
_FLAT_CELL = re.compile(f"<t([dh])({_ATTRS})>([^<]*+)({_INLINE})")
_FLAT_PART = re.compile(f"""<(?:([a-z][a-z0-9]*+)(?: href=(?:'([^'&]++)'|"([^"&]++)")|({_ATTRS}))/?|/[a-z0-9]++|{_DROPPED}|{_RUN_ON})>([^<]*+)(?:</[a-z0-9]++>([^<]*+))?""")
#: Outside of all tables, elements make no difference to them.
_OUTSIDE = re.compile(f"(?:[^<]*+<(?:{_other('table', *sorted(_RAW))}{_ATTRS}|br[ \\t\\r\\n\\f]*+/|/[a-z][a-z0-9]*+)>)*+[^<]*+")
_TABLE = re.compile(f"<table{_ATTRS}>[^<]*+")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.opened: list[Node] = []

    def build(self, html: str) -> Node:
        """The tree of a whole page: plain tags by one pattern, each odd construct by HTMLParser."""
        self.rawdata, n = html, len(html)
        i = self._data(0)
        while i < n:
            if (k := self._whole(i)) > 0:
                i = k
                continue
            m = _PLAIN.match(html, i)
            if m is not None:
                ended, tag, attrs, empty, text = m.groups()
                if ended is not None:
                    self.handle_endtag(ended.lower())
                elif (tag := tag.lower()) in _RAW or (empty and tag not in _VOID):
                    m = None
                else:
                    self._open(tag, _attributes(attrs) if attrs else {})
            if m is not None:
                if text:
                    self.handle_data(unescape(text) if "&" in text else text)
                i = m.end()
                continue
            k = self._odd(i)
            if k < 0 or self.cdata_elem is not None:
                # not closed, or no markup follows: the rest is HTMLParser's
                self.rawdata = ""
                self.feed(html[max(i, k) :])
                self.close()
                break
            i = self._data(k)
        # a tree without cycles goes as soon as it is not used, and not when the collector looks at all that a batch holds
        for node in self.opened:
            node.parent = None
        return self.root

    def _whole(self, i: int) -> int:
        """Takes what need not be read tag by tag at i; its end, or -1."""
        return -1

    def _data(self, i: int) -> int:
        """Takes the text from i up to the next tag."""
        j = self.rawdata.find("<", i)
        j = len(self.rawdata) if j < 0 else j
        if i < j:
            self.handle_data(unescape(self.rawdata[i:j]))
        return j

    def _odd(self, i: int) -> int:
        """Takes one construct at i; its end, or -1."""
        html = self.rawdata
        if html[i + 1 : i + 2].isascii() and html[i + 1 : i + 2].isalpha():
            return self.parse_starttag(i)
        if html.startswith("</", i):
            return self.parse_endtag(i)
        if html.startswith("<!--", i):
            return self.parse_comment(i)
        if html.startswith("<?", i):
            return self.parse_pi(i)
        return self.parse_html_declaration(i) if html.startswith("<!", i) else -1

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        at = self.at
        if tag in _CLOSES:
            ends, x = _CLOSES[tag], at
            while x.parent is not None and x.tag != "table":
                if x.tag in ends:
                    at = x.parent
                x = x.parent
        node = Node(tag, attrs, at)
        at.children.append(node)
        self.opened.append(node)
        self.at = at if tag in _VOID else node

    def handle_starttag(self, tag, attrs):
        self._open(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            if x.tag == "table":
                return
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def parse_marked_section(self, i, report=1):
        """A marked section that the parser does not know ends at its bracket, as a comment would; the page goes on."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        self.at.children.append(data)


class _FlatRow:
    """A row that _FLAT_ROW takes, as the markup of its cells, which are read when they are asked for."""

    __slots__ = ("markup",)
    tag, children = "tr", ()

    def __init__(self, markup: str):
        self.markup = markup

    def cells(self):
        found = []
        for kind, attrs, text, inner in _FLAT_CELL.findall(self.markup):
            text = (unescape(text) if "&" in text else text).strip()
            marks = _mark(attrs) if attrs else ()
            if not inner:
                found.append((text, text, (), marks, kind == "h"))
                continue
            strings, links, marks = [text] if text else [], [], [*marks]
            for tag, href, quoted, attrs, text, after in _FLAT_PART.findall(inner):
                if text and (text := _stripped(text)):
                    strings.append(text)
                if after and (after := _stripped(after)):
                    strings.append(after)
                if tag == "a":
                    if attrs:
                        if (href := _attributes(attrs).get("href")) is not None:
                            links.append((href, text))
                    elif href or quoted:
                        links.append((href or quoted, text))
                elif attrs and tag in _MARKED:
                    marks += _mark(attrs)
            found.append((strings[0], strings[0], links, marks, kind == "h") if len(strings) == 1 else ("".join(strings), " ".join(strings), links, marks, kind == "h"))
        return found


class _FlatTable:
    """A table of such rows alone."""

    __slots__ = ("rows",)
    tag, children = "table", ()

    def __init__(self, rows: list[_FlatRow]):
        self.rows = rows

    def all(self, *tags: str):
        return iter(self.rows if "tr" in tags else ())


class _TableBuilder(_Builder):
    """A tree for reading tables: plain rows of tables that stand in no other table stay markup, and what stands outside of tables is skipped."""

    def _whole(self, i: int) -> int:
        html, at = self.rawdata, self.at
        if at is not self.root:
            return self._flat_row(i) if html.startswith("<tr", i) else -1
        k = _OUTSIDE.match(html, i).end()
        if (m := _TABLE.match(html, k)) is None:
            return k if k > i else -1
        self._open("table", {})
        rows, k = [], m.end()
        while (m := _FLAT_ROW.match(html, k)) is not None:
            rows.append(_FlatRow(m[1]))
            k = m.end()
        if html.startswith("</table>", k):
            at.children[-1], self.at = _FlatTable(rows), at
            return k + 8
        self.at.children += rows
        return k

    def _flat_row(self, i: int) -> int:
        """Takes a plain row at i whole; its end, or -1 if it has to be read tag by tag."""
        at = self.at
        if at.tag in ("tbody", "thead", "tfoot"):
            at = at.parent
        if at.tag != "table" or (m := _FLAT_ROW.match(self.rawdata, i)) is None:
            return -1
        while (at := at.parent) is not None:
            if at.tag == "table":
                return -1
        self.at.children.append(_FlatRow(m[1]))
        return m.end()


def _stripped(text: str) -> str:
    return (unescape(text) if "&" in text else text).strip()


def _mark(attrs: str) -> list[str]:
    if "sort" not in attrs.lower():
        return []
    return [value] if (value := _attributes(attrs).get("data-sort-value")) is not None else []


def _attributes(text: str) -> dict[str, str]:
    """Of a plain tag."""
    found = ((name.lower(), a or b or c) for name, a, b, c in _ATTR.findall(text))
    return {name: unescape(value) if "&" in value else value for name, value in found}


def parse(html: str) -> Node:
    return _Builder().build(html)


def _tables(html: str):
    """The tables of a page in document order, for _cells."""
    return _TableBuilder().build(html).all("table")


def _links(node: Node) -> list[tuple[str, str]]:
    """(href, text)"""
    return [(a.attrs["href"], a.text()) for a in node.all("a") if "href" in a.attrs]


def _cell(node: Node) -> tuple[str, str, list[tuple[str, str]], list[str], bool]:
    """text, text_sp, links, sort_values, is_header"""
    strings, links, children = [], [], node.children
    marks = [node.attrs["data-sort-value"]] if "data-sort-value" in node.attrs else []
    if len(children) == 1 and isinstance(children[0], str):
        text = children[0].strip()
        return text, text, links, marks, node.tag == "th"
    todo = children[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x := x.strip():
                strings.append(x)
            continue
        if x.tag == "a" and "href" in x.attrs:
            links.append((x.attrs["href"], x.text()))
        elif x.tag in _MARKED and "data-sort-value" in x.attrs:
            marks.append(x.attrs["data-sort-value"])
        if x.tag not in ("script", "style"):
            todo.extend(reversed(x.children))
    return "".join(strings), " ".join(strings), links, marks, node.tag == "th"


def _cells(tr: Node | _FlatRow):
    """What _cell gives, for each cell of a row of _tables."""
    return tr.cells() if isinstance(tr, _FlatRow) else map(_cell, tr.all("td", "th"))


class _Tables:
    """The tables of a batch of pages as columns, and where the parts of each whole end."""

    def __init__(self):
        self.pages, self.tables, self.rows = [0], [0], [0]
        self.missing, self.table_no, self.row_index = [], [], []
        self.text, self.text_sp, self.is_header = [], [], []
        self.links, self.href, self.link_text = [0], [], []
        self.marks, self.mark = [0], []

    def add(self, html: str | None, max_rows: int | None, only: int | None = None) -> None:
        texts, texts_sp, headers, links_to, marks_to = self.text.append, self.text_sp.append, self.is_header.append, self.links.append, self.marks.append
        self.missing.append(html is None)
        for k, table in enumerate(_tables(html) if html is not None else (), 1):
            if only is not None and k != only:
                continue
            for i, tr in enumerate(table.all("tr")):
                if max_rows is not None and i > max_rows:
                    break
                for text, text_sp, links, marks, is_header in _cells(tr):
                    texts(text)
                    texts_sp(text_sp)
                    headers(is_header)
                    for href, of in links:
                        self.href.append(href)
                        self.link_text.append(of)
                    links_to(len(self.href))
                    if marks:
                        self.mark += marks
                    marks_to(len(self.mark))
                self.row_index.append(i)
                self.rows.append(len(self.text))
            self.table_no.append(k)
            self.tables.append(len(self.row_index))
        self.pages.append(len(self.table_no))

    def column(self) -> pa.Array:
        texts = lambda values: pa.array(values, pa.string())
        ends = lambda values: pa.array(values, pa.int32())
        struct = lambda kind, *columns: pa.StructArray.from_arrays(columns, fields=list(kind))
        links = pa.ListArray.from_arrays(ends(self.links), struct(_ARROW_LINKS.value_type, texts(self.href), texts(self.link_text)))
        marks = pa.ListArray.from_arrays(ends(self.marks), texts(self.mark))
        cells = struct(_ARROW_CELL, texts(self.text), texts(self.text_sp), links, marks, pa.array(self.is_header, pa.bool_()))
        table = _ARROW_TABLES.value_type
        rows = struct(table.field("rows").type.value_type, ends(self.row_index), pa.ListArray.from_arrays(ends(self.rows), cells))
        tables = struct(table, ends(self.table_no), pa.ListArray.from_arrays(ends(self.tables), rows))
        return pa.ListArray.from_arrays(ends(self.pages), tables, mask=pa.array(self.missing, pa.bool_()))


def _page(html: str) -> dict:
    root = parse(html)
    box = next((t for t in root.all("table") if t.attrs.get("class") in ("infobox vcard", "infobox biography vcard")), None)
    p = next(root.all("p"), None)
    out = {"has_infobox": box is not None, "name": None, "nickname": None, "rows": [], "bold": None, "paragraph": None}
    if box is not None:
        above = next((x for x in box.all("th") if x.has_class("infobox-above")), None)
        nick = next((x for x in box.all("div") if x.has_class("nickname")), None)
        out["name"], out["nickname"] = above and above.text(), nick and nick.text()
        for tr in box.all("tr"):
            th, td = next(tr.all("th"), None), next(tr.all("td"), None)
            out["rows"].append({"label": th and th.text(" "), "value": td and td.text(" "), "text": tr.text(" "), "links": [{"href": href, "text": text} for href, text in _links(tr)]})
    if p is not None:
        bold = next(p.all("b"), None)
        out["bold"], out["paragraph"] = bold and bold.text(), p.text(" ")
    return out


def html_tables(html: Column, max_rows: int | None = None, only: Column | None = None) -> Column:
    """All tables of a page in document order, nested ones included; max_rows data rows of each at most.

    only: the number of the one table whose rows are built; null for all.
    """

    @arrow_udf(TABLES)
    def run(pages: pa.Array, wanted: pa.Array) -> pa.Array:
        out = _Tables()
        for h, k in zip(pages.to_pylist(), wanted.to_pylist(), strict=True):
            out.add(h, max_rows, k)
        return out.column()

    return run(html, F.lit(None).cast("int") if only is None else only.cast("int"))


#: Cells of a row beyond which it is an error.
MOST_CELLS = 10_000


class _TableRows:
    def eval(self, html: str | None, table_no: int | None, max_rows: int | None, max_cells: int):
        if html is None:
            return
        for k, table in enumerate(_tables(html), 1):
            if table_no is not None and k != table_no:
                continue
            for i, tr in enumerate(table.all("tr")):
                if max_rows is not None and i > max_rows:
                    break
                try:
                    found = list(_cells(tr))
                    if len(found) > max_cells:
                        raise ValueError(f"a row of {len(found)} cells")
                    yield k, i, found, None
                except (IndexError, AttributeError, TypeError, ValueError) as e:
                    yield k, i, None, f"{type(e).__name__}: {e}"


class _PageLinks:
    def eval(self, html: str | None):
        if html is not None:
            for i, (href, text) in enumerate(_links(parse(html))):
                yield i, href, text


_table_rows = udtf(_TableRows, returnType=f"table_no int, row_index int, cells array<{CELL}>, error string")
_page_links = udtf(_PageLinks, returnType="pos int, href string, text string")


def lateral_rows(pages: DataFrame, *carried: str, table_no: Column | None = None, max_rows: int | None = None, max_cells: int = MOST_CELLS) -> DataFrame:
    """The carried columns, table_no, row_index, cells, error: a row for each table row, made by a table function.

    A row that fails has null cells and what was wrong with it, and the rest of its table goes on.  With table_no, which may differ from page to
    page, the rows of other tables are never built; with max_rows, those after so many data rows.
    """
    wanted = pages.select(*carried, "html", (F.lit(None) if table_no is None else table_no).cast("int").alias("_wanted"))
    made = wanted.lateralJoin(_table_rows(F.col("html").outer(), F.col("_wanted").outer(), F.lit(max_rows).cast("int"), F.lit(max_cells)))
    return made.select(*carried, "table_no", "row_index", "cells", "error")


def page_links(pages: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, pos, href, text: the links of each page in the order of the document."""
    return pages.select(*carried, "html").lateralJoin(_page_links(F.col("html").outer())).select(*carried, "pos", "href", "text")


def html_page(html: Column) -> Column:
    """The infobox and the first paragraph of a page."""

    @arrow_udf(PAGE)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if h is None else _page(h) for h in pages.to_pylist()], _ARROW_PAGE)

    return run(html)


def table_rows(pages: DataFrame, *carried: str, max_rows: int | None = None, only: Column | None = None) -> DataFrame:
    """The carried columns, table_no, row_index (0: the header) and cells: a row for each table row, of all tables or one of each page."""
    tables = pages.select(*carried, F.explode(html_tables(F.col("html"), max_rows, only)).alias("t"))
    rows = tables.select(*carried, F.col("t.table_no").alias("table_no"), F.explode("t.rows").alias("r"))
    return rows.select(*carried, "table_no", F.col("r.row_index").alias("row_index"), F.col("r.cells").alias("cells"))


def all_tables_preview(pages: DataFrame, *carried: str, rows: int = 10, confirm_threshold: int = 10, confirmed: bool = False) -> DataFrame:
    """The first rows of each table; pages with many tables give only their number unless confirmed."""
    tables = pages.select(*carried, html_tables(F.col("html"), rows).alias("tables")).withColumn("n_tables", F.size("tables"))
    shown = F.when(F.lit(confirmed) | (F.col("n_tables") <= confirm_threshold), F.col("tables"))
    out = tables.select(*carried, "n_tables", F.explode_outer(shown).alias("t"))
    return out.select(*carried, "n_tables", F.col("t.table_no").alias("table_no"), F.slice("t.rows", 1, rows).alias("rows"))


def table_preview(pages: DataFrame, *carried: str, table_no: int, rows: int = 10) -> DataFrame:
    """n_tables and the texts of the first data rows of one table; no rows if the page lacks it or has no html."""
    tables = pages.select(*carried, html_tables(F.col("html"), rows).alias("tables"))
    table = F.get(F.filter("tables", lambda t: t["table_no"] == table_no), 0)
    data = F.slice(F.filter(table["rows"], lambda r: r["row_index"] > 0), 1, rows)
    flat = F.transform(data, lambda r: F.transform(r["cells"], lambda c: F.trim(F.regexp_replace(c["text"], "\n", " "))))
    return tables.select(*carried, F.coalesce(F.size("tables"), F.lit(0)).alias("n_tables"), F.coalesce(flat, F.array().cast("array<array<string>>")).alias("rows"))


def header_cells(rows: DataFrame, *carried: str) -> DataFrame:
    """(col_index, text) of each table's first row."""
    first = rows.filter("row_index = 0").select(*carried, "table_no", F.posexplode("cells").alias("col_index", "c"))
    return first.select(*carried, "table_no", "col_index", F.col("c.text").alias("text"))


def link_map(rows: DataFrame, *carried: str) -> DataFrame:
    """(row_index, col_index) of the cells that hold a link."""
    cells = rows.select(*carried, "table_no", "row_index", F.posexplode("cells").alias("col_index", "c"))
    return cells.filter(F.size("c.links") > 0).select(*carried, "table_no", "row_index", "col_index")


def full_table(rows: DataFrame, *carried: str, table_no: int) -> DataFrame:
    """Every cell of the data rows of one table, however many there are: row_index, col_index, text, n_links."""
    own = rows.filter((F.col("table_no") == table_no) & (F.col("row_index") > 0))
    cells = own.select(*carried, "row_index", F.posexplode("cells").alias("col_index", "c"))
    return cells.select(*carried, "row_index", "col_index", F.col("c.text_sp").alias("text"), F.size("c.links").alias("n_links"))
