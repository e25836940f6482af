"""Safe markup: known rewrites, and what must hold of any input."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators.sanitizing import ATTRIBUTES, KEPT, sanitize, sanitized


def test_rewrites(spark):
    cases = {
        '<h1 onclick="x()">Tide & rail</h1><script>alert("<p>no</p>")</script><p>Body<p>Next</p><p> </p>': "<h2>Tide &amp; rail</h2><p>Body</p><p>Next</p>",
        'loose  text<custom>kept</custom><p style="color:red">x</p>': "<p>loose text</p><p>kept</p><p>x</p>",
        '<a href="javascript:x">a</a><a href="https://h.example/?a=1&amp;b=2" onclick="y">b</a>': '<p>a</p><a href="https://h.example/?a=1&amp;b=2" rel="nofollow noopener" target="_blank">b</a>',
        '<ul><li>one<li>two<ul><li>deep</ul></ul>': "<ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul>",
        '<div style="background:url(x)"><span style="color: #fff">s</span></div><br><br/>': '<div><span style="color: #fff">s</span></div><br>',
        "```html\n<p>fenced</p>\n```": "<p>fenced</p>",
        "<table><tr><td>1<td>2<tr><td colspan=2 width=9>3</table><h6>end": '<table><tr><td>1</td><td>2</td></tr><tr><td colspan="2">3</td></tr></table><h4>end</h4>',
        '<p><img src="https://h.example/x.png"></p>': "",
    }
    assert {k: sanitized(k) for k in cases} == cases
    assert sanitized('<p><img src="https://h.example/x.png" alt="A"></p>', images=True) == '<p><img src="https://h.example/x.png" alt="A"></p>'
    assert sanitized('<a href="https://h.example/">b</a>', links=False) == "<p>b</p>" and sanitized("") == sanitized(None) == ""
    df = spark.createDataFrame([(1, None), (2, "<p>x"), (3, "")], "id int, h string")
    assert [r.s for r in df.select("id", sanitize(F.col("h")).alias("s")).orderBy("id").collect()] == ["", "<p>x</p>", ""]


_PIECES = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<script>", "</script>", "<table>", "<tr>", "<td>", "</table>", "x y", "&lt;", "<", ">", '<a href="https://h.example/">', '<a href="data:x">', "</a>", "<img src=x onerror=y>", "<svg>", "</svg>", "<!-- c -->", "<h5>", "</h5>", "\n"])


@given(st.lists(_PIECES, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_input_is_safe_and_balanced(markup):
    out = sanitized(markup)
    stack = []
    for close, name, attributes in re.findall(r"<(/?)([a-z0-9]+)([^>]*)>", out):
        assert name in KEPT and all(a in ATTRIBUTES.get(name, ()) for a in re.findall(r"([a-z]+)=", attributes.split("https")[0]))
        if close:
            assert stack.pop() == name
        elif name not in ("br", "hr", "img"):
            stack.append(name)
    assert not stack and "javascript" not in out and "<!--" not in out and sanitized(out) == out
