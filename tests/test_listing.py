"""Listing extraction by tag depth, and character references."""

from html import unescape
from html.entities import html5

from pyspark.sql import functions as F

from casepipe.sources import html

FIELDS = {"a": html.Field("b", "k"), "d": html.Field("time", "w", "datetime")}


def items(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id INT, html STRING")
    return sorted((r.page_id, r.item, r.a, r.d) for r in html.listing_tree(df, "l", FIELDS).collect())


def test_nested_lists_are_no_items(spark):
    inner = "<ul class='l'><li><b class=k>inner</b></li></ul>"
    page = f"<ul><li>menu</ul><ol id=x class='a l'><li>{inner}<b class='k z'>one</b></li>\n<LI><time class='w' datetime=\"1\">x</time></LI></ol><ul class=l><li><b class=k>late</b></ul>"
    assert items(spark, page) == [(0, 0, "inner", ""), (0, 1, "", "1")]


def test_odd_pages(spark):
    unclosed = "<ul class=l><li><b class=k>one</b><li><b class=k>two"
    assert items(spark, None, "", "no list", "<ul class=ll><li>x</ul>", "<ul class=l></ul><li><b class=k>x</b>", unclosed) == [(5, 0, "one", ""), (5, 1, "", "")]


def test_attributes_in_any_form(spark):
    tags = ["<b class=k>v</b>", "<b x=1 CLASS = 'm k'>v</b>", '<b data-class="n" class="k">v</b>', "<b data-class=k>v</b>", "<bb class=k>v</bb>"]
    page = "<ul class=l>" + "".join(f"<li>{t}</li>" for t in tags) + "</ul>"
    assert [x[2] for x in items(spark, page)] == ["v", "v", "v", "", ""]


def test_names_of_html5(spark):
    names = [n for n in html5 if n.endswith(";")]
    texts = [f"a &{n} b" for n in names] + ["&apos;", "&amp;apos;", "&unknown;", "&amp", "&#39;&#x2019;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r.i: r.d for r in df.select("i", html.decode_entities(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [unescape(t) for t in texts]
