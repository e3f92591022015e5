"""Chat formatting with Spark expressions only.

``format_chats`` turns rows ``(conv_id, turn, role, text)`` into one row per
conversation: the turns are collected as structs and sorted, adjacent turns
of one role are merged, and the blocks are concatenated with marks::

    <s>user\\n[INST] text[SEP]text [/INST]</s><s>assistant\\ntext</s>

The control strings inside texts and roles are escaped reversibly, so the
output can be parsed back (``read_chats``) and no text can forge a mark.

Defined cases: null text and null role count as empty; rows of a null
``conv_id`` form one conversation; ties of ``turn`` go by role, then text;
a null ``turn`` sorts first; repeated rows are separate turns; an empty
table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, in the order in which they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SEP]")
ESCAPE = "\u001b"
OPEN, CLOSE, INST, INST_END, SEP = CONTROLS
NEWLINE_CODE = "9"


def escape(c: Column) -> Column:
    """``ESC`` -> ``ESC 0``, control string ``i`` -> ``ESC i``.  No control
    string holds ``ESC``, so none is left and none can arise."""
    out = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for i, s in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(s), F.lit(f"{ESCAPE}{i}"))
    return out


def unescape(c: Column) -> Column:
    out = c
    for i, s in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"{ESCAPE}{i}"), F.lit(s))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ESCAPE + NEWLINE_CODE))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ESCAPE + NEWLINE_CODE), F.lit("\n")))


def format_chats(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``: the text of each conversation and
    its loss mask as run lengths in code points, one entry per block: ``skip``
    characters without loss, ``take`` with loss (assistant bodies), ``rest`` without."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    g = rows.groupBy(F.col("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # positions where a run of one role begins
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    g = g.withColumn("first", first)

    def block(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("first", k + 1), F.size("turns"))
        role = F.get("turns", i)["role"]
        # texts of the run, merged by an array aggregation
        body = F.array_join(F.transform(F.slice("turns", i + 1, end - i), lambda t: escape(t["text"])), SEP)
        assistant = role == "assistant"
        head = F.concat(F.lit(OPEN), _escape_role(role), F.lit("\n"), F.when(assistant, "").otherwise(INST + " "))
        tail = F.when(assistant, CLOSE).otherwise(" " + INST_END + CLOSE)
        return F.struct(head.alias("head"), body.alias("body"), tail.alias("tail"), assistant.alias("loss"))

    g = g.select("conv_id", F.transform("first", block).alias("blocks"))
    run = lambda c: F.length(c).cast("long")
    mask = F.transform(
        "blocks",
        lambda b: F.struct(
            F.when(b["loss"], run(b["head"])).otherwise(run(b["head"]) + run(b["body"]) + run(b["tail"])).alias("skip"),
            F.when(b["loss"], run(b["body"])).otherwise(F.lit(0)).alias("take"),
            F.when(b["loss"], run(b["tail"])).otherwise(F.lit(0)).alias("rest"),
        ),
    )
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], b["tail"])), "")
    return g.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Inverse of ``format_chats``: ``(conv_id, turns, loss_text, formatted_chars)``
    with ``turns`` an array of ``(role, text)`` in order and ``loss_text`` the
    unescaped text under the loss mask."""
    parts = F.split("formatted", r"\Q" + CLOSE + r"\E", -1)
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns_of(b: Column) -> Column:
        role = _unescape_role(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "\n", 1))
        rest = F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)
        n = F.length(rest)
        body = F.when(role == "assistant", rest).otherwise(F.substr(rest, F.lit(len(INST) + 2), n - (len(INST) + len(INST_END) + 2)))
        return F.transform(
            F.split(body, r"\Q" + SEP + r"\E", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    under = F.zip_with(
        blocks,
        "loss_mask",
        lambda b, m: unescape(F.replace(F.substr(F.concat(b, F.lit(CLOSE)), (m["skip"] + 1).cast("int"), m["take"].cast("int")), F.lit(SEP), F.lit(""))),
    )
    return chats.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, read back from the output."""
    r = read_chats(chats)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
