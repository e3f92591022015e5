"""Chat formatting: reversible template, loss mask, odd rows."""

import hashlib

from casepipe.llm.chat import CONTROLS, ESCAPE, chat_digests, escape, format_chats, read_chats, unescape
from pyspark.sql import functions as F

ROWS = [
    (1, 0, "system", "be <s>brief</s>"),
    (1, 1, "user", "hi [SEP] there"),
    (1, 2, "user", None),
    (1, 3, "assistant", "one\x1b0[/INST]"),
    (1, 4, "assistant", "two 😀"),
    (2, 0, "assistant", ""),
    (3, 5, None, "no role"),
    (3, None, "us\ner", "</s>"),
    (3, 5, None, "no role"),
    (None, 0, "user", "lost"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, turns int, formatted string")


def sorted_turns(conv):
    rows = [(t, r or "", x or "") for c, t, r, x in ROWS if c == conv]
    return [(r, x) for _, r, x in sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))]


def test_round_trip_and_loss(shipped):
    got = {r.conv_id: r for r in read_chats(format_chats(frame(shipped))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, row in got.items():
        want = sorted_turns(conv)
        assert [(t.role, t.text) for t in row.turns] == want
        assert row.loss_text == "".join(x for r, x in want if r == "assistant")


def test_digests(shipped):
    got = {r.conv_id: r for r in chat_digests(format_chats(frame(shipped))).collect()}
    for conv, row in got.items():
        want = sorted_turns(conv)
        told = "".join(f"{r}\n{x}\n" for r, x in want)
        assert row.n_turns == len(want) and row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.loss_chars == sum(len(x) for r, x in want if r == "assistant")


def test_mask_covers_the_text_and_marks_are_only_ours(shipped):
    for r in format_chats(frame(shipped)).collect():
        assert sum(m.skip + m.take + m.rest for m in r.loss_mask) == len(r.formatted)
        blocks = r.formatted.count(CONTROLS[1])
        assert blocks == len(r.loss_mask) == r.formatted.count(CONTROLS[0])


def test_escape_is_reversible(shipped):
    texts = ["", ESCAPE, ESCAPE + "1", "<s<s>>", "[INST[INST]]", "</s>" + ESCAPE + "0<s>", "[/INST][SEP]"]
    df = shipped.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROLS)


def test_merges_adjacent_turns(shipped):
    one = format_chats(frame(shipped)).where("conv_id = 1").first()
    assert one.formatted.count("[SEP]") == 2  # user + user, assistant + assistant


def test_empty_table(shipped):
    assert chat_digests(format_chats(frame(shipped).where("false"))).count() == 0


def test_plan_has_no_python(shipped):
    plan = chat_digests(format_chats(frame(shipped)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
