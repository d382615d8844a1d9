"""Pages read by the pattern for plain tags, against the standard parser alone."""

import random
from html.parser import HTMLParser

import pytest

from fieldstone.sources import html

BITS = """<table> </table> <tr> </tr> <td> </td> <th> <TD\tClass='a\tb'\tdata-sort-value="0&amp;1"> <a\thref='/wiki/x'> <a\thref="a>b"> </a> <br> <br/> <br\t/> <td/> <p> <li> text &amp; &#xZZ; &lt & <
<\tb> <![x[y]]> <!foo> <?\tx\t> <!--\tc\t--> <!-- </zz> </> </\ttd> <td <script> a<b </script> <style> </style> <script/> <span\tdata-sort-value='2001'> </span> <a\thref=/x/> <a\tb\t=c> <a\tb=c/> <img\tsrc="x"\t/>
<a\thref='x " > é <É> </p\tx> <a\ttitle='a&quot;b'\tTITLE=c\tnowrap> <title> </title> <![CDATA[\tx<y\t]]> <!DOCTYPE\thtml> <a\t=x> <a\tb==c> <a\thref="1"title='2'>""".split()


class Plain(html._Builder):
    """Fed as a whole to the standard parser."""

    def build(self, text):
        HTMLParser.feed(self, text)
        self.close()
        return self.root


def tree(node):
    return node.tag, list(node.attrs.items()), [c if isinstance(c, str) else tree(c) for c in node.children]


@pytest.mark.parametrize("seed", range(4))
def test_trees_are_those_of_the_standard_parser(seed):
    draw = random.Random(seed)
    for _ in range(1000):
        page = "".join(draw.choice(BITS).replace("\t", " ") for _ in range(draw.randint(0, 20)))
        assert tree(html.parse(page)) == tree(Plain().build(page)), page


def test_plain_tags_do_not_go_through_the_standard_parser(monkeypatch):
    """What made a page slow: each tag of a table went through three patterns of the standard parser."""

    def refuse(*_):
        raise AssertionError("plain markup")

    monkeypatch.setattr(HTMLParser, "goahead", refuse)
    monkeypatch.setattr(HTMLParser, "parse_starttag", refuse)
    page = "<p>x</p><table class=t><tr><th>a<th>b</tr><tr><td><a href='/wiki/P_1'>P&amp;Q</a></td><td data-sort-value=\"2\">May 1, 1990<br/>x</td></tr></table>"
    made = html._Tables()
    made.add(page, None)
    made.add(None, None)
    cell = lambda text, sp, links=(), marks=(), header=False: {"text": text, "text_sp": sp, "links": list(links), "sort_values": list(marks), "is_header": header}
    rows = [[cell("a", "a", header=True), cell("b", "b", header=True)], [cell("P&Q", "P&Q", [{"href": "/wiki/P_1", "text": "P&Q"}]), cell("May 1, 1990x", "May 1, 1990 x", marks=["2"])]]
    assert made.column().to_pylist() == [[{"table_no": 1, "rows": [{"row_index": i, "cells": r} for i, r in enumerate(rows)]}], None]


FLAT = """<table> </table> <tr> </tr> <td> </td> <th> </th> <tbody> </tbody> <a\thref='/x'>y</a> <a\thref="">y</a> <a\thref=''\ttitle='q'>&amp;\tz</a> <a\tname=x>n</a> <span\tdata-sort-value='1'>s</span> <span\tdata-sort-value>s</span>
<td\tdata-sort-value="7&amp;8"> <th\tdata-sort-value> text \t <br> <br\t/> <b>bold</b> <i>\tx\t</i> <b> </b> <tr\tclass=x> <td>a</td> <td>b <tr><td>1</td><td>2</td></tr> <tr><th>h<th>k</tr> <a\thref="u&amp;v"\thref='w'>t</a> <a\thref='/p'\t>q</a> <div> </div> <p> <tr/> <td/>""".split(" ")


def cells_by_tree(page):
    return [[[html._cell(c) for c in tr.all("td", "th")] for tr in table.all("tr")] for table in html.parse(page).all("table")]


def cells_by_rows(page):
    return [[[(text, sp, [*links], [*marks], head) for text, sp, links, marks, head in html._cells(tr)] for tr in table.all("tr")] for table in html._tables(page)]


@pytest.mark.parametrize("seed", range(4))
def test_rows_read_whole_have_the_cells_of_the_tree(seed):
    draw, whole = random.Random(seed), 0
    for _ in range(2000):
        page = "<table>" + "".join(draw.choice(FLAT if draw.random() < 0.97 else BITS).replace("\t", " ") for _ in range(draw.randint(0, 20)))
        assert cells_by_rows(page) == cells_by_tree(page), page
        whole += any(isinstance(tr, html._FlatRow) for table in html._tables(page) for tr in table.all("tr"))
    assert whole > 100


def test_plain_rows_are_not_read_tag_by_tag(monkeypatch):
    """What made the html queries slow: a node, and a turn of the builder, for each tag of a plain row."""
    opened, open_ = [], html._Builder._open
    monkeypatch.setattr(html._Builder, "_open", lambda self, tag, attrs: (opened.append(tag), open_(self, tag, attrs))[1])
    row = "<tr><td>4th<td><a href='/wiki/File:x'>pic</a><a href='/wiki/P'>P</a></td><td>May 1, 1990</td></tr>\n"
    made = html._Tables()
    made.add(f"<table><tr><th>a<th>b</tr>{row * 100}</table>", None)
    assert opened == ["table"] and len(made.row_index) == 101 and len(made.href) == 200


ODD = """<td> </td> <td>a</td> <td>b <th> </th> <tr> </tr> <tr><td>1</td><td> <![x[y]]> <!foo\tbar> <?\tx\t> </zz> <td</td> <b</i> <script</b> <!--\tc\t--> <!--\ta-b\t--> <!----> <![CDATA[x]]> <![if\tx]> <!DOCTYPE\thtml> <b> </b> <i>\tx <p> </p> <li> <div\tdata-sort-value='3'>
</div> <span\tdata-sort-value="4"> <span>s</span> </span> </a> <a\thref='/x'>y</a> <a\thref="/z"\tclass=c>z</a>w <a\tname=q>n</a> <br/> <h2> </h2> <td\tdata-sort-value=5> <u\tdata-sort-value=6>u</u> text &amp;\tx &#xZZ; <a\thref='/n'><b>n</b></a> </table> <table> <tbody> </tbody> <caption>c</caption>
</div> <div> <script>\t<td>\t</script> <B> <textarea> <br\tclass=x/> <![\tz]> <!> <tr\tclass=x> <td/>""".split()


@pytest.mark.parametrize("seed", range(6))
def test_odd_rows_read_whole_have_the_cells_of_the_tree(seed):
    """Odd markup, elements that are not closed, and what stands around tables."""
    draw, whole = random.Random(seed), 0
    for _ in range(3000):
        page = "".join(draw.choice(ODD[-18:]) for _ in range(draw.randint(0, 3))) + "<table><tr><td>" + "".join(draw.choice(ODD if draw.random() < 0.2 else ODD[:-18]) for _ in range(draw.randint(0, 16)))
        page = (page + draw.choice(("", "</tr></table>", "</td></tr>\n</table>x<p>y"))).replace("\t", " ")
        assert cells_by_rows(page) == cells_by_tree(page), page
        whole += sum(isinstance(table, html._FlatTable) for table in html._tables(page))
    assert whole > 200


def test_odd_rows_are_not_read_tag_by_tag(monkeypatch):
    """What made html_terms_broken slow: the standard parser, and a node for each tag, for every row that holds odd markup."""

    def refuse(*_):
        raise AssertionError("read tag by tag")

    opened, open_ = [], html._Builder._open
    monkeypatch.setattr(html._Builder, "_open", lambda self, tag, attrs: (opened.append(tag), open_(self, tag, attrs))[1])
    monkeypatch.setattr(html._Builder, "_odd", refuse)
    odd = ("<![x[y]]><!foo bar><? x >", "&#xZZ; </zz><td", "<p><small>q</small>")
    rows = "".join(f"<tr><td><a href='/wiki/P_{i}'>P</a></td><td>May 1, 1990</td><td>present{odd[i % 3]}</td></tr>\n" for i in range(99))
    made = html._Tables()
    made.add(f"<p>x</p><table><tr><td>stub</table><table class=t><tr><th>a<th>b<th>c</tr>{rows}</table>", None)
    assert opened == ["table", "table"] and len(made.row_index) == 101 and len(made.href) == 99
    assert made.text[4:].count("present") == 33 and made.text.count("present&#xZZ;") == 33 and made.text_sp.count("present q") == 33
