"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn reads `<|im_start|>role<|im_sep|>text<|im_end|>`. Control strings inside roles and texts get a backslash behind
their first character, one more if they have some already, so a formatted text holds markers only where a turn begins,
is parted or ends, and the escape can be taken back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PARTED, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TAIL = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(F.coalesce(role, F.lit(""))), F.lit(PARTED), escape(F.coalesce(text, F.lit(""))),
                    F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1),
                        lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    return F.transform(inner, lambda p: F.struct(unescape(F.element_at(p, 1)).alias("role"),
                                                 unescape(F.element_at(p, 2)).alias("text")))


def examples(turns: DataFrame, *, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
             target_role: str = "assistant") -> DataFrame:
    """(conv, example, text, loss_start, loss_end): one example per assistant turn, its prefix as context.

    Only the reply between loss_start and loss_end (code points, end exclusive) is trainable. Turns after the last
    reply make one more example without a span, so no turn is lost; a conversation without replies has only that one.
    Turns of equal order are taken by role, then text; a null order comes first; null roles and texts are empty; rows
    without a conversation id form one conversation; a repeated row is a turn of its own. Empty table: empty result.
    Other columns are not looked at. One conversation is one unit of work: its longest example holds all of it.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.struct(
        F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    ready = whole.select("conv", F.size("turns").alias("n"), F.transform("turns", lambda t: t["role"] == target_role).alias("trains"),
                         F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("parts"))
    chosen = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trains", i) | (i == F.col("n")))
    each = ready.select("conv", "parts", "trains", F.explode(chosen).alias("example"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("example") - 1), "")
    each = each.select("conv", "example", F.element_at("trains", F.col("example")).alias("trains"), context.alias("context"),
                       F.element_at("parts", F.col("example")).alias("last"))
    head = len(START) + len(target_role) + len(PARTED)
    begin = F.when(F.col("trains"), F.length("context") + head)
    finish = F.when(F.col("trains"), F.length("context") + F.length("last") - len(END))
    return each.select("conv", "example", F.concat("context", "last").alias("text"), begin.alias("loss_start"),
                       finish.alias("loss_end"))


def digest(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, hash of turns, trainable text, characters made."""
    reply = F.when(F.col("loss_start").isNotNull(),
                   F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = made.groupBy("conv").agg(
        F.max_by("text", "example").alias("longest"), F.sum(F.length("text")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("replies", lambda r: unescape(F.coalesce(r["reply"], F.lit("")))), "")
    read = per.select("conv", "formatted_chars", parse_turns(F.col("longest")).alias("turns"), learnt.alias("learnt"))
    return read.select("conv", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))
