r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns of the conversation as context, and that turn's
text as the only trainable part. Turns after the last assistant turn (or a conversation without one) give one more
example with nothing trainable, so that the output holds the whole conversation.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts, strings that could be control strings
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first character, one more than is there;
taking one away gives the text back, whatever it holds.

Defined results: null roles and texts are empty; rows go by turn, then role, then text, nulls first; repeated rows are turns
of their own; a null conversation id is an id of its own; an empty table gives no examples; other columns are ignored.
The output grows with the square of a conversation's length, as each example holds its whole context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2")


def expand(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_chars): loss_start counts code points from 0; loss_chars is null in an example that has no target."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(
        F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"),
        F.concat(F.lit(TURN), escape(empty(role)), F.lit(TEXT), escape(empty(text)), F.lit(END)).alias("formatted"),
        F.char_length(escape(empty(text))).alias("chars"),
    )
    whole = rows.select(F.col(conv_id).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct((i + 1).alias("n"), (t["role"] == "assistant").alias("target"), t["chars"].alias("chars")))
    ends = F.filter(numbered, lambda t: t["target"] | (t["n"] == F.size("turns")))
    text_here = F.array_join(F.slice("formatted", 1, F.col("e.n")), "")
    found = whole.select("conv_id", F.transform("turns", lambda t: t["formatted"]).alias("formatted"), F.posexplode(ends).alias("example", "e"))
    found = found.select("conv_id", "example", F.col("e.n").alias("n_turns"), text_here.alias("text"), F.when(F.col("e.target"), F.col("e.chars")).alias("loss_chars"))
    return found.select("conv_id", "example", "n_turns", "text", (F.char_length("text") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars): the turns (role, text) and the text under the loss mask, both unescaped, from the formatted examples alone."""
    loss = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars"))
    last = F.max_by("text", "n_turns")
    found = examples.groupBy("conv_id").agg(
        last.alias("text"), F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    parts = F.filter(F.split("text", "<\\|turn\\|>"), lambda p: p != "")
    role, body = (lambda p: F.substring_index(p, TEXT, 1)), (lambda p: F.substring_index(F.substring_index(p, TEXT, -1), END, 1))
    turns = F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    return found.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: unescape(F.coalesce(x["loss"], F.lit("")))).alias("loss"), "formatted_chars")
