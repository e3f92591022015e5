"""HTML sources as Spark jobs over a ``(id, html)`` DataFrame.

No HTML library: the pages are cut with regular expressions inside the JVM
(``regexp_extract_all`` / ``split`` + ``posexplode``), one row per item.
"""

from __future__ import annotations

from collections.abc import Mapping
from html.entities import html5
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.functions.text import strip_ws
from casepipe.operators.segments import concat_by, running_count

TAG_RE = r"<[^>]*>"


#: A character reference: hexadecimal, decimal or by name, the end mark optional.
ENTITY_RE = r"&(#[xX][0-9a-fA-F]{1,6};?|#[0-9]{1,7};?|[A-Za-z][A-Za-z0-9]{1,31};?)"


#: Names that pages use most.
USUAL_NAMES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "pound", "sect", "copy", "hellip")


def decode_entities(c) -> F.Column:
    """Character references replaced by their characters, in expressions only.

    Names are those of the standard library's HTML 5 table, with ``;`` or, the
    few that may, without it; unknown ones stay as they are.  The usual names
    are looked up first: a look-up reads its map from the front."""
    usual = {f"{n};": html5[f"{n};"] for n in USUAL_NAMES}
    # one literal that Spark folds into a map, not a literal for each name
    literal = lambda names: F.str_to_map(F.lit("\x01".join(f"{n}\x02{v}" for n, v in names.items())), F.lit("\x01"), F.lit("\x02"))
    often, named = literal(usual), literal({n: v for n, v in html5.items() if n not in usual})
    pieces = F.split(c, ENTITY_RE, -1)

    def char(ref: F.Column) -> F.Column:
        digits = F.rtrim(ref, F.lit(";"))
        hexa = F.when(ref.rlike("^#[xX]"), F.lpad(F.substr(digits, F.lit(3)), 8, "0")).otherwise(
            F.lpad(F.hex(F.substr(digits, F.lit(2)).cast("long")), 8, "0")
        )
        number = F.decode(F.unhex(hexa), "UTF-32")
        return F.when(ref.startswith("#"), number).otherwise(F.coalesce(F.try_element_at(often, ref), F.try_element_at(named, ref), F.concat(F.lit("&"), ref)))

    found = F.transform(F.regexp_extract_all(c, F.lit(ENTITY_RE), 1), char)
    rest = F.zip_with(found, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), lambda x, y: F.concat(x, y))
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.concat(F.get(pieces, 0), F.array_join(rest, "")))


def strip_tags(c) -> F.Column:
    """Text of an HTML fragment: tags removed, character references decoded,
    then stripped (``get_text(strip=True)``)."""
    return strip_ws(decode_entities(F.regexp_replace(c, TAG_RE, "")))


def listing_items(
    pages: DataFrame,
    list_re: str,
    fields: Mapping[str, str],
    id_col: str = "page_id",
    html_col: str = "html",
    item_re: str = r"(?s)<li[^>]*>(.*?)</li>",
) -> DataFrame:
    """One row per ``<li>`` of the first list matched by ``list_re``.

    ``fields`` maps an output column to a regex whose group 1 is the value;
    the value is tag-stripped and whitespace-stripped.  Pages without the list
    give no rows.  Result ``(id, item, <fields...>)``.
    """
    block = F.regexp_extract(F.col(html_col), list_re, 1)
    items = pages.select(
        F.col(id_col), F.posexplode(F.regexp_extract_all(block, F.lit(item_re), 1)).alias("item", "_li")
    )
    return items.select(id_col, "item", *[strip_tags(F.regexp_extract("_li", rx, 1)).alias(name) for name, rx in fields.items()])


_LIST_TAG = r"(?is)</?(?:ul|ol|li)\b[^>]*>"


def _attribute(tag: F.Column, name: str) -> F.Column:
    """An attribute's value in an opening tag, quoted either way or not at all; character references decoded."""
    value = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    quoted = value.startswith('"') | value.startswith("'")
    return decode_entities(F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def _has_class(tag: F.Column, cls: str) -> F.Column:
    return F.array_contains(F.split(_attribute(tag, "class"), r"\s+"), cls)


def _opening(piece: F.Column) -> F.Column:
    return F.regexp_extract(piece, "^<[^>]*>", 0)


class Field(NamedTuple):
    """The first ``tag`` element of a class: its text, or its ``attribute``."""

    tag: str
    cls: str
    attribute: str = ""

    def value(self, html: str) -> F.Column:
        whole = rf"(?is)(<{self.tag}\b[^>]*>)" if self.attribute else rf"(?is)(<{self.tag}\b[^>]*>.*?)</{self.tag}\s*>"
        first = F.get(F.filter(F.regexp_extract_all(F.col(html), F.lit(whole), 1), lambda p: _has_class(_opening(p), self.cls)), 0)
        return strip_ws(F.coalesce(_attribute(first, self.attribute) if self.attribute else strip_tags(first), F.lit("")))


def listing_tree(pages: DataFrame, list_class: str, fields: Mapping[str, Field], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per item of the first list of class ``list_class`` of a page:
    ``(id, item, <fields...>)``, ``item`` from 0.

    The list's own items are told from those of lists inside them by depth: a
    prefix sum over the page's list tags (+1 where a list opens, -1 where one
    ends) gives every tag its depth, the list ends where the depth falls below
    its own, and its items are the ``li`` of its depth.  Attributes may come in
    any order, in either quotes, and a class among others.  Pages without the
    list give no row; an unclosed list goes on to the page's end.
    """
    tags = F.regexp_extract_all(F.col(html_col), F.lit(_LIST_TAG), 0)
    after = F.slice(F.split(F.col(html_col), _LIST_TAG, -1), 2, F.greatest(F.size(tags), F.lit(1)))
    rows = pages.select(F.col(id_col).alias("_id"), F.posexplode(F.arrays_zip(tags.alias("tag"), after.alias("after"))).alias("_i", "_t"))
    rows = rows.select("_id", "_i", "_t.tag", "_t.after")
    is_list = F.col("tag").rlike("(?i)^</?[uo]l")
    closes = F.col("tag").startswith("</")
    step = F.when(is_list & closes, -1).when(is_list, 1).otherwise(0)
    rows = running_count(rows, "_id", "_i", step, "_depth")
    opened = is_list & ~closes & _has_class(F.col("tag"), list_class)
    start = rows.where(opened).groupBy("_id").agg(F.min(F.struct("_i", "_depth")).alias("_s"))
    rows = rows.join(start.select("_id", F.col("_s._i").alias("_from"), F.col("_s._depth").alias("_level")), "_id").where(F.col("_i") > F.col("_from"))
    end = rows.where(F.col("_depth") < F.col("_level")).groupBy("_id").agg(F.min("_i").alias("_to"))
    rows = rows.join(end, "_id", "left").where(F.coalesce(F.col("_i") < F.col("_to"), F.lit(True)))
    item = (F.col("_depth") == F.col("_level")) & F.col("tag").rlike("(?i)^<li")
    rows = running_count(rows, "_id", "_i", item.cast("int"), "_item").where("_item > 0")
    whole = concat_by(rows.withColumn("_html", F.concat("tag", "after")), ["_id", "_item"], "_i", "_html", "", out="_li")
    return whole.select(F.col("_id").alias(id_col), (F.col("_item") - 1).cast("int").alias("item"), *[f.value("_li").alias(n) for n, f in fields.items()])


def total_documents(text) -> F.Column:
    """Leading number of ``'N documents found'``; thousands separators removed."""
    first = F.regexp_extract(strip_ws(text), r"^(\S+)", 1)
    return F.regexp_replace(first, ",", "").cast("long")


def page_plan(df: DataFrame, total_col: str, base_col: str, query: str, page_size: int = 10, id_col: str = "page_id") -> DataFrame:
    """``ceil(N / page_size)`` result pages -> one request URL per page 1..n."""
    n_pages = F.ceil(F.col(total_col) / F.lit(page_size)).cast("int")
    planned = df.select(id_col, base_col, F.explode(F.sequence(F.lit(1), F.greatest(n_pages, F.lit(0)))).alias("page")).where(
        F.col("page") >= 1
    )
    return planned.select(
        id_col,
        "page",
        F.concat(F.col(base_col), F.lit(f"/search?query={query}&page="), F.col("page").cast("string")).alias("url"),
    )


def feed_entries(feeds: DataFrame, id_col: str = "page", xml_col: str = "xml") -> DataFrame:
    """``(id, pos, title, entry_id)``: title and id of every ``<entry>`` of a feed."""
    items = feeds.select(id_col, F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<entry[^>]*>(.*?)</entry>"), 1)).alias("pos", "_e"))
    text = lambda tag: strip_tags(F.regexp_extract("_e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return items.select(id_col, "pos", text("title").alias("title"), text("id").alias("entry_id"))


def feed_title_id(entries: DataFrame, title: str = "title", id_col: str = "entry_id", order: str = "pos") -> DataFrame:
    """Title -> id dictionary; when a title repeats the last entry wins."""
    return entries.groupBy(title).agg(F.max_by(F.col(id_col), F.col(order)).alias(id_col))


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Paragraphs of an HTML page, tolerant of unclosed ``<p>``.

    Split at every ``<p ...>`` opening tag, drop the piece before the first,
    cut each piece at ``</p>`` or ``</article>``, strip tags and whitespace.
    Result ``(id, pos, paragraph)`` with ``pos`` from 0.
    """
    pieces = F.slice(F.split(F.col(html_col), "<p[^>]*>", -1), 2, 1 << 30)
    # a step's text is a variable of the next step, so it is made once; and inside the generator's
    # array, so a later filter reads it and does not make it again
    bare = F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)(</p>|</article>).*$", ""), TAG_RE, ""))
    texts = F.transform(F.transform(bare, decode_entities), strip_ws)
    return pages.select(F.col(id_col), F.posexplode(texts).alias("pos", "paragraph"))
