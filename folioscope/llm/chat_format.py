"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context, and that reply alone is trainable. Turns after the last reply (or all
of them, where there is none) make one further example with nothing trainable,
so that the output holds each conversation whole.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Control strings start
with ``<|``; inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can contain one, and dropping the escaping backslash gives
the text back.

Defined cases: a null text or role is empty; a null conv_id is a conversation of
its own; rows that tie on turn are ordered by role, then text; repeated rows are
repeated turns; an empty table gives no example; other columns are not read.

Only DataFrame functions are used. Rows meet once, by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chat(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row per example: conv_id, example, n_context, context, target, is_trained."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    marked = whole.select(
        "conv_id",
        F.transform("t", lambda x: F.concat(F.lit(TURN), escape(x.role), F.lit(TEXT), escape(x.text), F.lit(END))).alias("parts"),
        F.transform("t", lambda x: F.concat(F.lit(TURN), escape(x.role), F.lit(TEXT))).alias("heads"),
        F.filter(F.transform("t", lambda x, i: F.when(x.role == trained, i)), lambda i: i.isNotNull()).alias("replies"),
    )
    # A last position that is no reply stands for the turns after the last one.
    ends = F.when(
        F.coalesce(F.try_element_at("replies", F.lit(-1)) == F.size("parts") - 1, F.lit(False)), F.col("replies")
    ).otherwise(F.concat("replies", F.array(F.size("parts"))))
    examples = marked.select("conv_id", "parts", "heads", F.posexplode(ends).alias("example", "at"))
    reply = F.col("at") < F.size("parts")
    head = F.when(reply, F.try_element_at("heads", F.col("at") + 1)).otherwise(F.lit(""))
    body = F.when(reply, F.try_element_at("parts", F.col("at") + 1)).otherwise(F.lit(""))
    return examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("at").cast("long").alias("n_context"),
        # The head of the reply is context: the mask covers its text and end mark alone.
        F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("at")), ""), head).alias("context"),
        F.substr(body, F.length(head) + 1).alias("target"),
        reply.alias("is_trained"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT))).alias("text"),
        ),
    )


def trained_text(target: Column) -> Column:
    """What the mask covers, without the end mark and unescaped."""
    return unescape(F.substr(target, F.lit(1), F.length(target) - len(END)))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: turns, trained text, length."""
    per = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", F.concat("context", "target").alias("s"))).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("is_trained"), F.struct("example", trained_text(F.col("target")).alias("s"))))).alias("loss"),
        F.sum(F.length("context") + F.length("target")).cast("long").alias("formatted_chars"),
    )
    read = per.select("conv_id", parse(F.col("last.s")).alias("turns"), F.array_join(F.transform("loss", lambda x: x.s), "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
