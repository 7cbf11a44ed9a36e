"""Chat formatting with DataFrame functions only: one training example for each assistant turn.

A turn is written `<turn ROLE>` newline text `</turn>` newline.  Inside roles and texts a backslash becomes `\\b`, `<`
becomes `\\l`, `>` becomes `\\g` (and in roles a newline `\\n`), so control strings occur only where the template writes
them and unescaping gives the text back.  Every assistant turn becomes an example: all turns before it as context, and
itself, of which only the reply's text is trainable (`loss_start`, `loss_chars`, in code points of `formatted`).  A conversation
that doesn't end with an assistant turn gets one more example, without a trainable part, so that no turn is lost.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows give the same output each time; rows with a null conv_id form one conversation; extra columns are ignored.
A conversation is gathered in one row, since its last example holds all of it anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The inverse: a backslash always starts an escape, so undoing `\\b` last can't form a new one."""
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _opening(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit(">\n"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 1), n_turns (in it), formatted, loss_start, loss_chars (null in an example without a reply)."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    opening = F.transform("turns", lambda t: _opening(t["role"]))
    body = F.transform("turns", lambda t: escape(t["text"]))
    written = F.transform(F.arrays_zip(F.col("opening"), F.col("body")), lambda p: F.concat(p["opening"], p["body"], F.lit(CLOSE)))
    ends = F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == ASSISTANT) | (i == F.size("turns") - 1), i + 1)), lambda i: i.isNotNull())
    chats = chats.withColumns({"opening": opening, "body": body}).withColumns({"written": written, "ends": ends})
    cut = chats.select("conv_id", "turns", "opening", "body", "written", F.posexplode("ends").alias("example", "n_turns"))
    context = F.array_join(F.slice("written", F.lit(1), F.col("n_turns") - 1), "")
    reply = F.element_at("turns", F.col("n_turns"))["role"] == ASSISTANT
    return cut.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        "n_turns",
        F.array_join(F.slice("written", F.lit(1), F.col("n_turns")), "").alias("formatted"),
        F.when(reply, F.char_length(context) + F.char_length(F.element_at("opening", F.col("n_turns")))).alias("loss_start"),
        F.when(reply, F.char_length(F.element_at("body", F.col("n_turns")))).alias("loss_chars"),
    )


def parse(formatted: Column) -> Column:
    """Back to an array of (role, text)."""
    whole = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ">\n", 1)
        text = p.substr(F.char_length(role) + 3, F.char_length(p))
        role = F.replace(role.substr(F.lit(7), F.char_length(role)), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, turn)
