"""Chat formatting as Spark expressions: sort the turns, merge neighbours of one role, concatenate; texts can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import in_blocks

#: The template's control strings. A block is HEAD role NEXT_LINE text (TURN text)* END.
HEAD, TURN, END = "<|role|>", "<|turn|>", "<|end|>"
#: All control strings, ours and other templates', hold one of these characters; in texts and roles they are replaced, & first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsb;")]


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row a conversation of turns (conv_id, turn, role, text).

    Turns are sorted by turn, then role, then text; neighbours of one role share a block. loss_mask holds (start, end), code points of formatted
    (end exclusive), for each text of loss_role in order. Null texts and roles count as empty, a null turn comes first, repeated rows are
    turns of their own, a null conv_id is a conversation. An empty table gives no rows.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.try_element_at(F.col("turns"), F.greatest(i, F.lit(1)))["role"] != t["role"])
        closes = F.coalesce(F.try_element_at(F.col("turns"), i + 2)["role"] != t["role"], F.lit(True))
        before = F.when(opens, F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(TURN))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")),
            F.struct(F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.flatten(F.transform("turns", pieces))
    span = "array<struct<start:int,end:int>>"

    def placed(a: Column, i: Column) -> Column:
        s = F.element_at("segments", i)
        end = a["at"] + F.length(s["text"])
        here = F.array(F.struct(a["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), a["k"].alias("k"), F.when(s["loss"], F.concat(a["out"], here)).otherwise(a["out"]).alias("out"))

    mask = in_blocks(F.size("segments"), span, placed)
    return sorted_turns.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation, as array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(F.substring(block, len(HEAD) + 1, 2**31 - 1), "\n", 1))
        body = F.regexp_replace(block, r"^[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string and unescaped, one after the other."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations' rows: turns, and the text under the loss mask; both come out of the formatted string."""
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss_text"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
