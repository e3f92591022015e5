"""Golden values for the scalar functions (FIXTURES §1.2, §1.4, §1.5)."""

import math
import random
import re


from casepipe import functions as fn
from casepipe.functions.text import CITATION_PATTERN_REFERENCE, FACT_PATTERN_REFERENCE


def one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


FLAG_CASES = [
    ("X [2020] EWHC 123 (Admin)", 1, 0),
    ("X [2017] UKSC 37", 1, 0),
    ("x[2017] AC 12", 1, 0),
    ("é [2017] UKSC 37", 1, 0),
    ("X [2017] UKSC 3.", 0, 0),
    ("X; [2017] UKSC 37", 0, 0),
    ("[2020] EWHC 123", 0, 0),
    ("In X [2014] EWCA Civ 1514, foo", 0, 0),
    ("per [1991] 1 WLR 153", 0, 0),
    ("X [2017]  UKSC 37", 0, 0),
    ("X [2017] UKSC 3 at", 1, 0),
    ("section 66(1) of", 0, 1),
    ("s.288 of the", 0, 1),
    ("Act 1990", 0, 1),
    ("s 10", 0, 1),
    ("Section.5", 0, 1),
    ("s . 7", 0, 1),
    ("S10", 0, 0),
    ("sections 5", 0, 0),
    ("the Act  1990x", 0, 0),
    ("rules10", 0, 0),
    ("és 10", 0, 0),
    (None, 0, 0),
]


def test_citation_and_fact_flags(spark):
    rows = [(t,) for t, _, _ in FLAG_CASES]
    cit = one(spark, rows, "t STRING", fn.citation_flag("t"))
    fact = one(spark, rows, "t STRING", fn.fact_flag("t"))
    assert cit == [c for _, c, _ in FLAG_CASES]
    assert fact == [f for _, _, f in FLAG_CASES]


def test_linear_citation_pattern_equals_reference_pattern():
    # property: the linear rewrite has the same truth value as the reference
    # pattern under Python re, on random strings built from citation pieces
    from casepipe.functions.text import CITATION_PATTERN

    lin = re.compile(CITATION_PATTERN.replace("(?U)", ""))
    ref = re.compile(CITATION_PATTERN_REFERENCE)
    pieces = ["[2017]", "[20x7]", " ", "  ", "UKSC", "EWCA", "Civ", "37", "3", "(Admin)", "(", ")", ".", ";", "x", "é", "d", "\t"]
    rnd = random.Random(7)
    for _ in range(20000):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        assert bool(lin.search(s)) == bool(ref.search(s)), s


def test_citation_flag_long_single_line(spark):
    # R1 regression: the reference pattern overflows java.util.regex on long
    # single-line texts; the linear one must not
    text = " ".join(["word"] * 20000) + " [2020] EWHC 123 (Admin) under s.288"
    assert one(spark, [(text,)], "t STRING", fn.citation_flag("t")) == [1]
    assert one(spark, [(text,)], "t STRING", fn.fact_flag("t")) == [1]


def test_citation_uri(spark):
    cases = [
        ("[2020] EWHC 123 (Admin)", "ewhc/admin/2020/123"),
        ("[2014] EWCA Civ 1514", "ewca/civ/2014/1514"),
        ("[2017] UKSC 37", "uksc/2017/37"),
        ("  [2017]   UKSC 37 ", "uksc/2017/37"),
        ("[2014] EWCA Civ x", "Invalid input format"),
        ("[2014] UKSC", "Invalid input format"),
        ("", "Invalid input format"),
    ]
    got = one(spark, [(c,) for c, _ in cases], "t STRING", fn.citation_uri("t"))
    assert got == [u for _, u in cases]


def test_paragraph_filters(spark):
    rows = [("a-b-c-d",), ("***",), ("\t",), ("\n\n",), ("",), ("ok - fine",), (" x ",)]
    main = one(spark, rows, "t STRING", fn.paragraph_ok("t"))
    cover = one(spark, rows, "t STRING", fn.paragraph_ok("t", need_alnum=False))
    assert main == [False, False, False, False, False, True, True]
    assert cover == [False, True, False, False, False, True, True]


def test_normalise_label(spark):
    rows = [("0",), (" 1 ",), ("Output: 1",), ("10",), ("1.0",), ("yes",), (None,)]
    assert one(spark, rows, "t STRING", fn.normalise_label("t")) == [0, 1, 1, 0, 0, None, None]
    # numeric input goes through INT first: 1.0 -> 1
    assert one(spark, [(1.0,), (0.0,), (None,)], "t DOUBLE", fn.normalise_label("t", numeric=True)) == [1, 0, None]


def test_path_parts(spark):
    rows = [("./data/xml_data/xml_page_3/A v B_C.xml",), ("data\\xml_page_12\\case.xml",)]
    assert one(spark, rows, "t STRING", fn.page_number("t")) == ["3", "12"]
    assert one(spark, rows, "t STRING", fn.case_name("t")) == ["A v B_C", "case"]


def test_tags_and_alignment(spark):
    assert one(spark, [("B-DATE",), ("I-COURT",), ("tok",), (None,)], "t STRING", fn.tag_id("t")) == [3, 10, 0, 0]
    df = spark.createDataFrame([([None, 0, 0, 1, None], [3, 4])], "w ARRAY<INT>, t ARRAY<INT>")
    r = df.select(
        fn.align_labels("w", "t").alias("a"),
        fn.align_labels("w", "t", label_all=False).alias("b"),
        fn.align_labels("w", "t", max_len=7).alias("c"),
    ).first()
    assert r.a == [-100, 3, 3, 4, -100]
    assert r.b == [-100, 3, -100, 4, -100]
    assert r.c == [-100, 3, 3, 4, -100, -100, -100]


def test_argmax_and_sigmoid(spark):
    df = spark.createDataFrame([([0.1, 2.0, 2.0, -1.0],)], "a ARRAY<DOUBLE>")
    assert df.select(fn.argmax("a")).first()[0] == 1
    logit = math.log(0.3 / 0.7)
    df = spark.createDataFrame([([2.0, -2.0, -0.5, logit + 1e-9, logit - 1e-6],)], "a ARRAY<DOUBLE>")
    assert df.select(fn.sigmoid_threshold("a")).first()[0] == [1, 0, 1, 1, 0]


def test_strip_ws_unicode(spark):
    assert one(spark, [("  x \t\n",)], "t STRING", fn.strip_ws("t")) == ["x"]


def test_fact_pattern_is_case_sensitive():
    assert re.search(FACT_PATTERN_REFERENCE, "S10") is None
