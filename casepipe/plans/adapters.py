"""Adapter views: the driver's generic tables shaped into the engine's inputs.

The raw ``documents`` hold no citation, statute, numbered or blank lines, so
queries on them would be vacuous.  Each adapter decorates the driver tables
with one deterministic expression; the same expression is written in DuckDB
SQL in ``casepipe.plans.oracle`` so both sides read identical inputs.  Every
adapter is a lazy DataFrame over the whole table -- no sampling, no caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.functions.tags import TAGS
from casepipe.operators.segments import concat_by, running_count
from casepipe.sources.akn import AKN_NS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: number of tasks that text tables of a single row group
#: are dealt out to before the per-row work.  Unset: no extra shuffle (the
#: right choice for a corpus of many files).
SPREAD = "casepipe.spread"


def text_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A text-heavy table, projected first (column pruning)."""
    df = table(spark, sf_dir, name)
    if cols:
        df = df.select(*cols)
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def _s(c) -> F.Column:
    return c.cast("string")


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_name, doc_id, pos, paragraph)``: one row per line of a document.

    ``file_name = xml_page_{doc_id % 10 + 1}/doc_{doc_id}.xml``; the line at
    ``pos`` is decorated by ``pos % 7``: numbered, + citation, + statute,
    + hyphens, blank (TAB), ``***``, unchanged.
    """
    d = text_table(spark, sf_dir, "documents", "doc_id", "text")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "p"))
    doc = F.col("doc_id")
    pos = F.col("pos")
    p = F.col("p")
    m = pos % 7
    paragraph = (
        F.when(m == 0, F.concat(_s(pos + 1), F.lit(". "), p))
        .when(m == 1, F.concat(p, F.lit(" see ["), _s(doc % 24 + 2000), F.lit("] EWHC "), _s(doc + 100), F.lit(" (Admin)")))
        .when(m == 2, F.concat(p, F.lit(" under s."), _s(doc % 300 + 1), F.lit(" of the Act")))
        .when(m == 3, F.concat(F.lit("a-b-c-d "), p))
        .when(m == 4, F.lit("\t"))
        .when(m == 5, F.lit("***"))
        .otherwise(p)
    )
    file_name = F.concat(F.lit("xml_page_"), _s(doc % 10 + 1), F.lit("/doc_"), _s(doc), F.lit(".xml"))
    return x.select(file_name.alias("file_name"), doc.alias("doc_id"), pos.cast("int").alias("pos"), paragraph.alias("paragraph"))


def odd_cells(df: DataFrame) -> DataFrame:
    """Annotated paragraphs with texts that careless CSV code changes: blanks
    and line ends at either end, quotes, commas, the empty text and NULL, by ``pos % 12``."""
    p, m = F.col("paragraph"), F.col("pos") % 12
    odd = (
        F.when(m == 0, F.concat(F.lit("  \t"), p))
        .when(m == 1, F.concat(p, F.lit(" \n")))
        .when(m == 2, F.concat(F.lit('"a", "b"\nline two, '), p))
        .when(m == 8, F.lit(""))
        .when(m == 9, F.lit(None).cast("string"))
        .when(m == 10, F.lit("null"))
        .otherwise(p)
    )
    return df.withColumn("paragraph", odd)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paras`` after the main-text quality filter."""
    from casepipe.functions.text import paragraph_ok

    return paras(spark, sf_dir).where(paragraph_ok("paragraph"))


def _h(c: str = "pos") -> F.Column:
    return F.col("doc_id") + F.col(c)


def ij_labels(spark: SparkSession, sf_dir: str, kept_df: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """Introduction / judgment annotation rows (a workbook stand-in).

    All rows of ``kept``, or (``partial``, a source that does not label every
    paragraph) those with ``(doc_id + pos) % 3 <> 0``; ``introduction`` is
    NULL when ``% 17 = 0``; rows with ``% 13 = 0`` appear twice, the copy
    (``dup = 1``) with the judgment label flipped.  One pass: the copy is an
    ``explode`` of the row, not a second scan.
    """
    k = kept_df if kept_df is not None else kept(spark, sf_dir)
    k = k.where(_h() % 3 != 0) if partial else k
    k = k.withColumn("dup", F.explode(F.when(_h() % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    judg = F.when(_h() % 11 == 0, 1).otherwise(0)
    return k.select(
        "file_name",
        "paragraph",
        "pos",
        "dup",
        F.when(_h() % 17 == 0, F.lit(None).cast("int")).when(F.col("pos") < 3, 1).otherwise(0).alias("introduction"),
        F.when(F.col("dup") == 1, 1 - judg).otherwise(judg).alias("judgment"),
    )


def citation_labels(spark: SparkSession, sf_dir: str, kept_df: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """Citation labels of all rows of ``kept`` (``partial``: of the rows with
    even ``doc_id + pos``); 1 on the citation-decorated lines, NULL when ``% 19 = 0``."""
    k = kept_df if kept_df is not None else kept(spark, sf_dir)
    k = k.where(_h() % 2 == 0) if partial else k
    return k.select(
        "file_name",
        "paragraph",
        "pos",
        F.when(_h() % 19 == 0, F.lit(None).cast("int")).when(F.col("pos") % 7 == 1, 1).otherwise(0).alias("citation"),
    )


def fact_labels(spark: SparkSession, sf_dir: str, kept_df: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """Raw fact outputs of a batch labeller: ``'1' '0' 'Output: 1' 'yes'
    '10'`` or NULL by ``(doc_id + pos) % 6``; ``partial``: rows with ``% 5 = 1``
    not answered yet; rows with ``% 9 = 0`` answered twice (copy ``dup = 1`` says ``'0'``)."""
    k = kept_df if kept_df is not None else kept(spark, sf_dir)
    k = k.where(_h() % 5 != 1) if partial else k
    k = k.withColumn("dup", F.explode(F.when(_h() % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    m = _h() % 6
    raw = (
        F.when(m == 0, "1").when(m == 1, "0").when(m == 2, "Output: 1").when(m == 3, "yes").when(m == 4, "10")
        .otherwise(F.lit(None).cast("string"))
    )
    return k.select("file_name", "paragraph", "pos", "dup", F.when(F.col("dup") == 1, F.lit("0")).otherwise(raw).alias("fact"))


def _in_header() -> F.Column:
    """Structure of the stand-in judgments: decorated lines are body, and so
    are lines that end a sentence."""
    return ~F.col("paragraph").endswith(".") & ~(F.col("pos") % 7).isin(4, 5)


def header_paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header ``p`` texts (with their newline tail) of every file except
    ``doc_id % 7 = 3`` (no header at all): every line without a full stop at
    its end; for ``doc_id % 5 = 0`` the header is present but blank."""
    p = paras(spark, sf_dir).where(_in_header() & (F.col("doc_id") % 7 != 3))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("\n")).otherwise(F.concat(F.col("paragraph"), F.lit("\n")))
    return p.select("file_name", "doc_id", "pos", text.alias("paragraph"))


def body_paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body ``p`` texts (unfiltered): all other lines, with marker
    lines: ``JUDGMENT`` at ``pos`` 4 unless ``doc_id % 3 = 2``, and a
    ``Hearing date:`` line at ``pos`` 6 when ``doc_id % 3 = 0``."""
    p = paras(spark, sf_dir).where(~_in_header())
    d3 = F.col("doc_id") % 3
    text = (
        F.when((d3 == 0) & (F.col("pos") == 6), F.concat(F.lit("Hearing date: "), F.col("paragraph")))
        .when((d3 != 2) & (F.col("pos") == 4), F.lit("JUDGMENT"))
        .otherwise(F.col("paragraph"))
    )
    return p.select("file_name", "doc_id", "pos", text.alias("paragraph"))


def _div(c, n: int) -> F.Column:
    return F.floor(c / F.lit(n)).cast("long")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat search results, one per page of ``pages``.

    ``title`` = the page's ``<h1>`` (``'Case ' || page_id div 40`` for
    ``page_id % 40`` in (0, 1): duplicate titles on one listing page);
    ``citation`` in four shapes by ``page_id % 4`` (bracketed sub-court,
    numeric, 3 parts with extra blanks, invalid); listing ``page`` =
    ``page_id div 10 + 1``, ``item`` = ``page_id % 10``.
    """
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    pid = F.col("page_id")
    year = _s(pid % 24 + 2000)
    m4 = pid % 4
    citation = (
        F.when(m4 == 0, F.concat(F.lit("["), year, F.lit("] EWHC "), _s(pid + 100), F.lit(" (Admin)")))
        .when(m4 == 1, F.concat(F.lit("["), year, F.lit("] EWCA Civ "), _s(pid + 100)))
        .when(m4 == 2, F.concat(F.lit("  ["), year, F.lit("]   UKSC "), _s(pid % 50 + 1), F.lit(" ")))
        .otherwise(F.concat(F.lit("["), year, F.lit("] UKSC")))
    )
    h1 = F.regexp_extract(F.col("html"), r"<h1>(.*?)</h1>", 1)
    title = F.when(pid % 40 <= 1, F.concat(F.lit("Case "), _s(_div(pid, 40)))).otherwise(h1)
    court = F.when(m4 == 0, "High Court").when(m4 == 1, "Court of Appeal").otherwise("Supreme Court")
    date = F.concat(year, F.lit("-"), F.lpad(_s(pid % 12 + 1), 2, "0"), F.lit("-15T00:00:00"))
    return p.select(
        "page_id",
        (pid % 10).cast("int").alias("item"),
        title.alias("title"),
        court.alias("court"),
        citation.alias("citation"),
        date.alias("date"),
        (_div(pid, 10) + 1).cast("int").alias("page"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page, html, xml)``: the search results of a listing page as the
    HTML list of a listing and as a feed."""
    r = search_results(spark, sf_dir).select("page", "item", "page_id", *[_xml_escape(F.col(c)).alias(c) for c in ("title", "court", "citation", "date")])

    def span(cls: str, c) -> F.Column:
        return F.concat(F.lit(f'<span class="judgment-listing__{cls}">'), c, F.lit("</span>\n"))

    li = F.concat(
        F.lit("<li>\n"),
        span("title", F.concat(F.lit('<a href="/x"> '), F.col("title"), F.lit(" </a>"))),
        span("court", F.col("court")),
        span("neutralcitation", F.col("citation")),
        F.lit('<time class="judgment-listing__date" datetime="'), F.col("date"), F.lit('">a day</time></li>'),
    )
    entry = F.concat(F.lit("<entry><title>"), F.col("title"), F.lit("</title>\n<id> id-"), _s(F.col("page_id")), F.lit("</id></entry>"))
    both = r.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("item", li.alias("li"), entry.alias("entry")))).alias("_a"))
    return both.select(
        "page",
        F.concat(F.lit('<ul class="judgment-listing__list">'), F.array_join(F.transform("_a", lambda x: x["li"]), ""), F.lit("</ul>")).alias("html"),
        F.concat(F.lit("<feed><title>all</title>"), F.array_join(F.transform("_a", lambda x: x["entry"]), ""), F.lit("</feed>")).alias("xml"),
    )


def nested_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page, html)``: the listing with a list of tags inside every item, a
    menu before it and another list after it, attributes in other orders and
    quotes, classes among others, and courts that end in ``'s`` as a reference."""
    r = search_results(spark, sf_dir).select("page", "item", "page_id", *[_xml_escape(F.col(c)).alias(c) for c in ("title", "court", "citation", "date")])
    li = F.concat(
        F.lit("<LI data-x='1'>\n<ul class='tags'><li>t1</li><li><ol><li>deep</li></ol></li></ul>\n<span id=t class='big judgment-listing__title'><a href=\"/x\"> "),
        F.col("title"),
        F.lit(" </a></span>\n<span lang=en\n class=judgment-listing__court>"),
        F.col("court"),
        F.lit('&apos;s</span><span class="x">no</span><span data-a="1" class="judgment-listing__neutralcitation y">'),
        F.col("citation"),
        F.lit("</span><time datetime='"), F.col("date"), F.lit("' class='a judgment-listing__date'>a day</time></LI>"),
    )
    all_ = r.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("item", li.alias("li")))).alias("_a"))
    head = F.lit("<ul><li>menu</li></ul><ul id='l' class='judgment-listing__list wide'>")
    return all_.select("page", F.concat(head, F.array_join(F.transform("_a", lambda x: x["li"]), "\n"), F.lit("</ul><ul class='judgment-listing__list'><li>other</li></ul>")).alias("html"))


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, base, total_text)``: a results-intro line per page,
    ``'N documents found'`` with ``N`` = 3 x the number of ``<p`` tags +
    ``page_id % 10``, times 100 with thousands separators when
    ``page_id % 5 = 0``."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n_p = _div(F.length("html") - F.length(F.regexp_replace("html", "<p", "")), 2)
    n = n_p * 3 + F.col("page_id") % 10
    text = F.when(F.col("page_id") % 5 == 0, F.format_number(n * 100, 0)).otherwise(_s(n))
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("base"),
        F.concat(text, F.lit(" documents found")).alias("total_text"),
    )


def words_of(text: str) -> F.Column:
    return F.filter(F.split(text, r"\s+", -1), lambda x: x != "")


def true_tag_of(word: F.Column, idx: F.Column) -> F.Column:
    """The tag that the trainer reads for the word at ``idx``."""
    b = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(word), 1, 1)) - 1
    tags = F.array(*[F.lit(t) for t in TAGS])
    return F.when((idx % 13 == 12) | (b >= len(TAGS)), F.lit("O")).otherwise(F.get(tags, b))


def _word_table(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Every word of every document (whole texts) with a tag from the md5 of the
    word; the further columns of ``docs`` (``doc_id``, ``text``, ...) are kept."""
    d = text_table(spark, sf_dir, "documents", "doc_id", "text") if docs is None else docs
    more = [c for c in d.columns if c not in ("doc_id", "text")]
    w = d.select("doc_id", *more, F.posexplode(words_of("text")).alias("idx", "word"))
    b = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("word"), 1, 1)) - 1
    tags = F.array(*[F.lit(t) for t in TAGS])
    tag = F.when(b < 11, F.get(tags, b)).otherwise(F.lit("O"))
    return w.select("doc_id", *more, F.col("idx").cast("int").alias("idx"), "word", b.alias("bucket"), tag.alias("tag"))


def ner_words(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The words of ``ner_pred`` as one row per document, ``(doc_id, words)``,
    and the further columns of ``docs``."""
    d = text_table(spark, sf_dir, "documents", "doc_id", "text") if docs is None else docs
    return d.withColumn("words", words_of("text")).drop("text")


def iob_lines(spark: SparkSession, sf_dir: str, with_doc: bool = False) -> DataFrame:
    """An IOB file as ``(file, line_no, line)``: per document a
    ``-DOCSTART- -X- O O`` line, one ``word TAB tag`` line per word (a bare
    ``word TAB`` every 13th word, a four-column line every 17th), a blank
    line after every 10th word, and for ``doc_id % 9 = 0`` a second DOCSTART
    at the end (an empty document).  Line numbers are dense: a document's
    first line follows the last one of the document before it (cumulative line
    counts).  A document learns its first line's number before its words are
    taken apart; word and blank lines come from one pass over them (an
    ``explode`` of one or two lines per word)."""
    d = text_table(spark, sf_dir, "documents", "doc_id", "text")
    n_words = F.size(F.filter(F.split("text", r"\s+", -1), lambda x: x != ""))
    n = n_words + F.floor(n_words / 10) + 1 + (F.col("doc_id") % 9 == 0).cast("int")
    sizes = d.select("doc_id", n.cast("long").alias("n"), F.lit("output-iob.tsv").alias("file"))
    ends = running_count(sizes, "file", "doc_id", F.col("n"), "end", dtype="long").select("doc_id", (F.col("end") - F.col("n")).alias("base"), "end")
    w = _word_table(spark, sf_dir, d.join(ends.select("doc_id", "base"), "doc_id"))
    i = F.col("idx")
    line = (
        F.when(i % 13 == 12, F.concat("word", F.lit("\t")))
        .when(i % 17 == 16, F.concat("word", F.lit("\t_\t_\t"), "tag"))
        .otherwise(F.concat("word", F.lit("\t"), "tag"))
    )
    at = F.col("base") + i + F.floor(i / 10) + 1
    word_line = F.struct(at.alias("line_no"), line.alias("line"))
    blank_line = F.struct((at + 1).alias("line_no"), F.lit("").alias("line"))
    both = F.when(i % 10 == 9, F.array(word_line, blank_line)).otherwise(F.array(word_line))
    words = w.select("doc_id", F.explode(both).alias("l")).select("doc_id", "l.line_no", "l.line")
    start = F.struct(F.col("base").alias("line_no"), F.lit("-DOCSTART- -X- O O").alias("line"))
    extra = F.struct((F.col("end") - 1).alias("line_no"), F.lit("-DOCSTART- -X- O O").alias("line"))
    starts = ends.select(
        "doc_id", F.explode(F.when(F.col("doc_id") % 9 == 0, F.array(start, extra)).otherwise(F.array(start))).alias("l")
    ).select("doc_id", "l.line_no", "l.line")
    allv = words.unionByName(starts)
    return allv.select(*["doc_id"] * with_doc, F.lit("output-iob.tsv").alias("file"), F.col("line_no").cast("long").alias("line_no"), "line")


def ner_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of ``ner_pred`` as word pieces of up to four characters, each
    with its word's tags: what is scored when all pieces carry labels."""
    d = text_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", words_of("text").alias("w"))

    tags = F.array(*[F.lit(t) for t in TAGS])

    # a word's digests are made once, then its tags, then its pieces
    def digits(w):
        return F.struct(
            (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(w), 1, 1)) - 1).alias("b"),
            F.substring(F.md5(F.concat(w, F.lit("#"))), 1, 1).isin("0", "1", "2").alias("flip"),
            F.ceil(F.length(w) / 4).cast("int").alias("n"),
        )

    def tagged(x, i):
        true_tag = F.when((i % 13 == 12) | (x["b"] >= len(TAGS)), F.lit("O")).otherwise(F.get(tags, x["b"]))
        return F.struct(true_tag.alias("t"), F.when(x["flip"], F.get(tags, (x["b"] + 3) % 11)).otherwise(true_tag).alias("p"), x["n"].alias("n"))

    words = F.transform(F.transform("w", digits), tagged)
    pieces = F.flatten(F.transform(words, lambda x: F.array_repeat(F.struct(x["t"].alias("t"), x["p"].alias("p")), x["n"])))
    p = d.select("doc_id", F.posexplode(pieces).alias("idx", "x"))
    return p.select("doc_id", "idx", F.col("x.t").alias("true_tag"), F.col("x.p").alias("pred_tag"))


def ner_pred(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Token table ``(doc_id, idx, word, true_tag, pred_tag)``: the IOB words
    with the tag the trainer reads (bare lines -> ``O``) and a prediction
    that differs for words whose second md5 starts with 0, 1 or 2; and the
    further columns of ``docs``."""
    w = _word_table(spark, sf_dir, docs)
    more = [c for c in w.columns if c not in ("doc_id", "idx", "word", "bucket", "tag")]
    true_tag = F.when(F.col("idx") % 13 == 12, F.lit("O")).otherwise(F.col("tag"))
    tags = F.array(*[F.lit(t) for t in TAGS])
    flip = F.substring(F.md5(F.concat("word", F.lit("#"))), 1, 1).isin("0", "1", "2")
    pred = F.when(flip, F.get(tags, (F.col("bucket") + 3) % 11)).otherwise(true_tag)
    return w.select("doc_id", "idx", "word", true_tag.alias("true_tag"), pred.alias("pred_tag"), *more)


def ml_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label predictions: truth ``[quality, toxic]`` from ``labels``,
    logits ``[(n_chars % 1000) / 250 - 2, md5-digit(doc_id) / 4 - 2]``."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id", "inner")
    b = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(_s(F.col("doc_id"))), 1, 1)) - 1
    return j.select(
        "doc_id",
        F.array(F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("y"),
        F.array((F.col("n_chars") % 1000) / 250.0 - 2.0, b / 4.0 - 2.0).alias("logits"),
    )


def _xml_escape(c) -> F.Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def akn_xml(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """``(path, content BINARY)``: one well-formed Akoma Ntoso judgment per document.

    Header: ``<p>`` per line at ``pos`` < 2.  Body: every later line as a
    ``<p>``, preceded by a styled ``<num>`` when ``pos % 7 = 0`` (text
    ``(pos)`` when ``pos % 14 = 7``, else ``pos+1.``) and by an un-styled
    ``<num>`` when ``pos % 7 = 3``; every ``</p>`` is followed by a newline.
    With ``broken`` the documents with ``doc_id % 50 = 7`` close with a wrong
    tag and those with ``doc_id % 50 = 8`` declare an unknown encoding (whole texts all the same).
    """
    p = paras(spark, sf_dir)
    pos = F.col("pos")
    ptag = F.concat(F.lit("<p>"), _xml_escape(F.col("paragraph")), F.lit("</p>\n"))
    num_text = F.when(pos % 14 == 7, F.concat(F.lit("("), _s(pos), F.lit(")"))).otherwise(F.concat(_s(pos + 1), F.lit(".")))
    body = (
        F.when(pos % 7 == 0, F.concat(F.lit('<num style="s">'), num_text, F.lit("</num>"), ptag))
        .when(pos % 7 == 3, F.concat(F.lit("<num>"), _s(pos), F.lit("</num>"), ptag))
        .otherwise(ptag)
    )
    # one ordered concat per document: the body opens right before the
    # first body line (pos 2); documents without body lines get it at the end
    opener = F.lit("</header><judgmentBody>")
    frag = F.when(pos < 2, ptag).when(pos == 2, F.concat(opener, body)).otherwise(body)
    docs = concat_by(p.select("file_name", "doc_id", "pos", frag.alias("frag")), ["file_name", "doc_id"], "pos", "frag", "", out="x")
    j = docs
    xml = F.concat(
        F.lit(f'<akomaNtoso xmlns="{AKN_NS}"><judgment><header>'),
        F.col("x"),
        F.when(F.col("last_pos") < 2, opener).otherwise(F.lit("")),
        F.lit("</judgmentBody></judgment></akomaNtoso>"),
    )
    if broken:
        xml = (
            F.when(F.col("doc_id") % 50 == 7, F.replace(xml, F.lit("</judgmentBody>"), F.lit("</body>")))
            .when(F.col("doc_id") % 50 == 8, F.concat(F.lit('<?xml version="1.0" encoding="x-none"?>'), xml))
            .otherwise(xml)
        )
    return j.select(F.col("file_name").alias("path"), F.encode(xml, "UTF-8").alias("content"))
