from __future__ import annotations

import pytest

from loometry.llm.html_text import extract, page_text
from loometry.llm.queries import QUERIES, table

CASES = [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<p>one<p>two", "one\n\ntwo"), ("<p><b>bold<p>next</b> end", "bold\n\nnext end"),
    ("a <b>b</b>c  \n d", "a bc d"), ("a<br>b</br>c", "a\nb\nc"), ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<title>t</title><style>x</style><script>var a='<p>no</p>'</script>yes", "yes"),
    ("<head><title>t</title><p>body begins", "body begins"),
    ("<p hidden>x</p><p style='color:red; display : none'>y</p><p style='visibility:hidden'>v</p>z", "z"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>", "name    n\na       10\nlonger  2"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>x<td>y</table>", "wide cell here\nx  y"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>", "a  b\n   c\n   d\ne  f"),
    ("<table><thead><tr><td rowspan=9>a<td>b</thead><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td rowspan=' +2x'>a<td colspan=0>b<tr><td>c<tr><td>d</table>", "a  b\n   c\nd"),
    ("<table><tr><td rowspan=" + "9" * 5000 + ">a<td>b" + "<tr><td>c" * 1500 + "</table>", "a  b" + "\n   c" * 1500),
    ("<table><caption>cap</caption><td>only</table>", "cap\nonly"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"), ("&lt;b&gt; &amp; &eacute; &#x41; &nosuch;", "<b> & é A &nosuch;"),
    ("<details><summary>s</summary>closed</details><details open>open</details>", "s\n\nopen"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<!-- c --><![CDATA[x]]>y", "y"),
    ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"), ("<img alt='pic'> and <input value='v'><input type=hidden value=no>", "pic and v"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("<a<b>>x</", ">x</"), ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_page(html, text):
    assert page_text(html) == text


FOREIGN = [
    ("<p>so <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds", "so a=2 holds"),
    ("<svg viewBox='0 0 1 1'><rect/><text x=1>North</text><g><text>South <tspan>9</tspan></text></g></svg>end", "North South 9 end"),
    *[(f"<svg><{t}>no</{t}><text>yes</text></svg>", "yes") for t in ("title", "desc", "metadata", "defs", "symbol")],
    *[(f"<math><semantics><mi>x</mi><{t}>no</{t}></semantics></math>", "x") for t in ("annotation", "annotation-xml")],
    ("<svg><defs><text>no</text></defs><defs/><title/><text>yes</text></svg>", "yes"),
    ("<svg><text display=none>no</text><text style='visibility:hidden'>no</text><text>yes</text></svg>", "yes"),
    ("<svg><foreignObject><div>a</div><div>b</div></foreignObject></svg>", "a\nb"),
    ("<svg><defs><p>out</p>", "out"), ("<svg/>a<math/>b", "ab"), ("a<desc>b</desc><defs>c</defs>", "abc"),
    ("<p>a<div/>b", "a\n\nb"), ("<svg><style>.x{}</style><script>no()</script><a href=x><text>link</text></a></svg>", "link"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1 2"),
]


@pytest.mark.parametrize("html,text", FOREIGN)
def test_formulas_and_drawings(html, text):
    assert page_text(html) == text


def test_deep_and_long_pages_keep_all_text():
    deep = "<div>" * 30000 + "core" + "</div>" * 30000 + "<p>after"
    assert page_text(deep).split() == ["core", "after"]
    long = "<p>" + "word " * 300000
    assert len(page_text(long)) == 300000 * 5 - 1
    lists = "<ul><li>x" * 5000
    assert page_text(lists).count("x") == 5000


def test_query_covers_all_pages(spark, data_dir):
    pages = {r.page_id: r.html for r in table(spark, data_dir, "pages").collect()}
    rows = QUERIES["op9_html_text"](spark, data_dir).collect()
    assert {r.page_id: r.text for r in rows} == {i: page_text(h) for i, h in pages.items()}
    assert all("track(" not in r.text and "{margin" not in r.text for r in rows)


def test_elements_below_the_depth_limit_hide_and_end():
    for depth in (190, 198, 199, 200, 201, 5000):
        deep = "<div>" * depth
        assert page_text(f"{deep}a<p hidden>no</p><script>no</script><style>no</style>b") == "ab"
        assert page_text(f"{deep}<span style='display:none'>no<b>no</b><img alt=no></span>yes") == "yes"
        # The end of an inner element ends no outer one.
        assert page_text(f"<span hidden>{deep}<span>no</span>no</span>") == ""
        assert page_text(f"{deep}<details><summary>s</summary>no<b>no</b></details>t").split() == ["s", "t"]
        assert page_text(f"{deep}a<div>b</div>c<b>d</b>e") == "a\nb\ncde"
        assert page_text(f"{deep}a<svg><defs>no</defs><text>b</text></svg>").split() == ["a", "b"]
    assert page_text("<p><object>" + "<div>" * 50000 + "x") == ""


def test_cells_of_any_length_keep_columns_aligned():
    long = "word " * 30 + "end"
    rows = page_text(f"<table><tr><td>{long}<td>b<tr><td>x<td>c</table>").split("\n")
    assert rows == [long + "  b", "x" + " " * (len(long) + 1) + "c"]
    rows = page_text(f"<table><tr><td>{long}<td>b<tr><td>{long} 2<td>c</table>").split("\n")
    assert rows[0].index("  b") == len(long) + 2 and rows[1].index("  c") == len(long) + 2


def test_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "r"), (1, None, "r"), (None, "<p>x", None)], "page_id long, html string, row string")
    out = extract(rows)
    assert out.columns == ["page_id", "html", "row", "_text"]
    assert sorted(r._text for r in out.collect()) == ["", "", "x"]
    assert extract(rows.limit(0)).count() == 0
