"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all preceding turns are context, and only
that reply is under the loss mask. Turns after the last assistant turn (or a whole
conversation without one) become one more example with an empty mask, so that nothing
is lost. Control strings inside texts and roles are escaped reversibly.

Template: "<s>[INST] role newline text [/INST]</s>" for any role but assistant,
"<s>text</s>" for assistant. Escape: a backslash is doubled, and one is put behind the
first character of each control string, so that none of them occurs inside a text.

Edge cases: a null text or role is an empty one; rows of equal turn are ordered by
role, then text; null turns come first; a null conv_id is a conversation of its own;
repeated rows are turns of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, INST, END_INST = "<s>", "</s>", "[INST] ", " [/INST]"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_text(turn: Column) -> Column:
    other = F.concat(F.lit(OPEN + INST), F.url_encode(turn["role"]), F.lit("\n"), turn["body"], F.lit(END_INST + CLOSE))
    return F.when(turn["role"] == "assistant", F.concat(F.lit(OPEN), turn["body"], F.lit(CLOSE))).otherwise(other)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, mask_start, mask_chars (0 where nothing is trainable).

    turns: conv_id, turn, role, text. mask_start counts characters from 0.
    """
    conv = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("body"))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.char_length(t["body"]).alias("n"), turn_text(t).alias("piece"))).alias("turns"))
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    example = conv.select("conv_id", "turns", F.posexplode(ends).alias("example", "end")).withColumns(
        {"formatted": F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda t: t["piece"]), ""), "last": F.element_at("turns", F.col("end"))}
    )
    return example.select(
        "conv_id",
        F.col("example").cast("int"),
        "formatted",
        F.when(F.col("last.reply"), F.char_length("formatted") - len(CLOSE) - F.col("last.n")).otherwise(F.char_length("formatted")).alias("mask_start"),
        F.when(F.col("last.reply"), F.col("last.n")).otherwise(0).alias("mask_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) of a formatted example."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))

    def parsed(p: Column) -> Column:
        rest = F.substring(p, len(INST) + 1, 1 << 30)
        cut = F.locate("\n", rest)
        other = F.struct(
            F.url_decode(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(rest, cut + 1, F.char_length(rest) - cut - len(END_INST))).alias("text"),
        )
        return F.when(p.startswith(INST), other).otherwise(F.struct(F.lit("assistant").alias("role"), unescaped(p).alias("text")))

    return F.transform(inner, parsed)


def loss_text(formatted: Column, mask_start: Column, mask_chars: Column) -> Column:
    return unescaped(F.substring(formatted, mask_start + 1, mask_chars))
