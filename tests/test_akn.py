"""Golden AKN document (FIXTURES §1.3)."""

from pyspark.sql import functions as F

from casepipe.operators import segments
from casepipe.sources import akn, akn_stream

DOC = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><judgment><header><p>Neutral Citation: [2020] EWHC 123 (Admin)</p>
<p>a-b-c-d</p>
<p>Before: <b>MR JUSTICE X</b></p>
</header><judgmentBody><p>JUDGMENT</p>
<num style="s">1.</num><p>A <i>B <b>C</b> D</i> E</p>
<num style="s">(a)</num><p>sub item</p>
<num>9.</num><p>unstyled</p>
<num style="s">2.</num><p>See s.288 of the Act</p><p> *** </p>
</judgmentBody></judgment></akomaNtoso>"""

NO_HEADER = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><judgment><judgmentBody><p>x</p></judgmentBody></judgment></akomaNtoso>"""


def scan(spark):
    return spark.createDataFrame(
        [("p1/doc.xml", bytearray(DOC.encode())), ("p1/bad.xml", bytearray(b"<akomaNtoso><judg")), ("p2/nohead.xml", bytearray(NO_HEADER.encode()))],
        "path STRING, content BINARY",
    )


def test_paragraph_texts_and_filters(spark):
    s = scan(spark)
    raw = akn.akn_paragraph_texts(s, "header").where(F.col("file_name") == "p1/doc.xml").orderBy("pos")
    assert [r.paragraph for r in raw.collect()] == [
        "Neutral Citation: [2020] EWHC 123 (Admin)\n", "a-b-c-d\n", "Before: MR JUSTICE X\n"
    ]
    body = akn.akn_paragraph_texts(s).where(F.col("file_name") == "p1/doc.xml").orderBy("pos")
    assert [r.paragraph for r in body.collect()] == ["JUDGMENT\n", "A B C D E\n", "sub item\n", "unstyled\n", "See s.288 of the Act", " *** \n"]
    main = akn.akn_paragraphs(s).where(F.col("file_name") == "p1/doc.xml").orderBy("pos")
    assert [r.paragraph for r in main.collect()] == ["JUDGMENT\n", "A B C D E\n", "sub item\n", "unstyled\n", "See s.288 of the Act"]


def test_cover(spark):
    got = {r.file_name: r.cover_text for r in akn.akn_cover(scan(spark)).collect()}
    assert got == {"p1/doc.xml": "Neutral Citation: [2020] EWHC 123 (Admin)\nBefore: MR JUSTICE X\n"}


def test_quarantine(spark):
    q = akn.quarantine(akn.akn_paragraph_texts(scan(spark)))
    assert [r.file_name for r in q.collect()] == ["p1/bad.xml"]


def test_segments_reference_and_document_order(spark):
    ev = akn.akn_events(scan(spark)).where(F.col("error").isNull() & (F.col("file_name") == "p1/doc.xml"))
    ref = [r.segment for r in segments.build_segments(ev).orderBy("seg").collect()]
    assert ref == ["1. A  B E C D", "(a) sub item  unstyled", "2. See s.288 of the Act ***"]
    doc = [r.segment for r in segments.build_segments(ev, order="document").orderBy("seg").collect()]
    assert doc[0] == "1. A B C D E"
    seg = segments.build_segments(ev).select("file_name", F.col("seg").alias("pos"), F.col("segment").alias("paragraph"))
    merged = [r.paragraph for r in segments.merge_numbered(seg).orderBy("gid").collect()]
    assert merged == ["1. A  B E C D (a) sub item  unstyled", "2. See s.288 of the Act ***"]


def test_prefix_fallback(spark):
    body = akn.akn_paragraph_texts(scan(spark)).where(F.col("file_name") == "p1/doc.xml")
    got = segments.prefix_until_marker(body).first().prefix_text
    assert got == "JUDGMENT\n"


def test_nested_p_yields_outer_and_inner(spark):
    doc = (
        '<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><judgment><judgmentBody>'
        "<p>outer <p>inner</p> tail</p>\n</judgmentBody></judgment></akomaNtoso>"
    )
    s = spark.createDataFrame([("p/n.xml", bytearray(doc.encode()))], "path STRING, content BINARY")
    got = [r.paragraph for r in akn.akn_paragraph_texts(s).orderBy("pos").collect()]
    assert got == ["outer inner tail\n", "inner tail"]


ODD = [
    ("nested", '<akomaNtoso xmlns="{ns}"><judgment><header><p>h <p>in</p>t</p>x</header><judgmentBody><p>outer <p>inner <i>i</i>!</p> tail</p>\n<!-- c --><p/>z<p>a<!-- c -->b</p></judgmentBody></judgment></akomaNtoso>'),
    ("twice", '<akomaNtoso xmlns="{ns}"><header><p>1</p><header><p>2</p></header><p>3</p></header>..<header><p>4</p></header><judgmentBody/><judgmentBody><p>5</p></judgmentBody></akomaNtoso>'),
    ("root", '<judgmentBody xmlns="{ns}"><num style="">1.</num><p>r</p>&amp;<num>2</num></judgmentBody>'),
    ("foreign", '<a xmlns:x="u" xmlns:k="{ns}"><x:judgmentBody><p>no</p></x:judgmentBody><k:judgmentBody><p>no</p><k:p>yes</k:p></k:judgmentBody></a>'),
    ("deep", '<judgmentBody xmlns="{ns}">' + "<b>" * 3000 + "<p>d</p>e" + "</b>" * 3000 + "</judgmentBody>"),
    ("long", '<judgmentBody xmlns="{ns}"><p>' + "lång text &lt; " * 20_000 + "</p>" + "<p>é</p>\n" * 7000 + "</judgmentBody>"),
    ("late", '<judgmentBody xmlns="{ns}"><p>' + "x" * 200_000 + "</p><p>y</judgmentBody>"),
    ("entity", "<a>&unknown;</a>"),
    ("encoding", '<?xml version="1.0" encoding="x-none"?><a/>'),
    ("empty", ""),
]


def test_one_parse_equals_the_separate_parses(spark):
    odd = [(n, bytearray(t.replace("{ns}", akn.AKN_NS).encode())) for n, t in ODD] + [("null", None), ("utf16", bytearray(NO_HEADER.encode("utf-16")))]
    s = scan(spark).unionAll(spark.createDataFrame(odd, "path STRING, content BINARY"))
    rows = akn_stream.akn_rows(s).cache()

    def same(got, want):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))

    for kind, section in (("body", "judgmentBody"), ("header", "header")):
        want = akn.akn_paragraph_texts(s, section, markers=True)
        same(rows.where(F.col("kind") == kind).select("file_name", "pos", "paragraph"), want.where("error IS NULL"))
        failed = rows.where("kind = 'error'").select("file_name", F.substring_index("error", ":", 1).alias("error"))
        same(failed.where("file_name <> 'null'"), want.where("error IS NOT NULL AND file_name <> 'null'").select("file_name", F.substring_index("error", ":", 1).alias("error")))
    assert {r.file_name for r in rows.where("kind = 'error'").collect()} == {"p1/bad.xml", "late", "entity", "encoding", "empty", "null"}
    want = akn.akn_events(s).where("error IS NULL")
    same(akn_stream.events(rows), want)
    same(akn_stream.main_paragraphs(rows), akn.akn_paragraphs(s))
    same(akn_stream.covers(rows), akn.akn_cover(s))
    tables = {r.file_name: r for r in akn_stream.case_tables(rows).collect()}
    assert len(tables) == 3 + len(odd)
    assert tables["late"].error_kind == "parse" and tables["late"].n_paragraphs == 0 and tables["late"].cover_text is None
    assert tables["p1/doc.xml"].n_segments == 3 and tables["long"].n_paragraphs == 7001
    rows.unpersist()


def test_a_parse_holds_the_open_elements_only():
    doc = f'<judgmentBody xmlns="{akn.AKN_NS}">' + "<p>some text</p>\n" * 50_000 + "</judgmentBody>"
    parts = [len(p) for p in akn_stream._document("x", doc.encode())]
    assert sum(parts) == 1 + 2 * 50_000 + 1 and max(parts) < 2 * akn_stream.PIECE / len("<p>some text</p>\n") + 8
