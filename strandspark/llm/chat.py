"""Relational chat formatting: Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template: a block of one role is START role NL (turn SEP)* turn END NL.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Inside texts and roles "<" of a control string is written "<\\"; a run of backslashes after "<" grows by one.
_ESCAPE, _UNESCAPE = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    """Reversibly rewrite ``<|`` so that no control string can occur in a text: every ``<\\...|`` gains a backslash."""
    return F.regexp_replace(text, _ESCAPE, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: a backslash is written backslash b, a line feed backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # every backslash begins a pair, so the two replacements do not meet
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One formatted string for each conversation, with its loss spans.

    Turn structs of a conversation are collected, sorted by turn, and folded so that neighbouring turns of one role
    share a block (their texts joined by SEP); blocks are joined into `formatted`. `loss_spans` are the code point
    ranges (start, length) of the formatted texts of `target_role`, one a turn. Control strings in texts and roles are
    escaped reversibly. Null texts and roles are empty; repeated turns are all kept, ordered by (turn, role, text);
    null turns come first; rows without conv_id make one conversation; an empty table gives no rows; extra columns, whatever
    their names, are ignored.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == target_role).alias("loss")))
    # what stands before a turn's text: a new block, or a separator within the block of the turn before
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    merged = F.transform(
        "e",
        lambda t, i: F.struct(
            F.when(i == 0, head(t)).when(F.get("e", i - 1)["role"] == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END + "\n"), head(t))).alias("before"),
            t["text"].alias("text"),
            t["loss"].alias("loss"),
        ),
    )
    lengths = F.transform("m", lambda t: F.struct((F.length(t["before"]) + F.length(t["text"])).cast("long").alias("n"), F.length(t["text"]).cast("long").alias("own"), t["loss"].alias("loss")))
    spans = F.aggregate(
        "lengths",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["n"]).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["n"] - t["own"]).alias("start"), t["own"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.concat(F.array_join(F.transform("m", lambda t: F.concat(t["before"], t["text"])), ""), F.lit(END + "\n"))
    return (
        grouped.select("conv_id", escaped.alias("e"))
        .select("conv_id", merged.alias("m"))
        .select("conv_id", text.alias("formatted"), lengths.alias("lengths"))
        .select("conv_id", "formatted", spans.alias("loss_spans"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (array of role, text) and loss texts, parsed from the formatted string and its spans alone."""
    end = F.length("formatted") - len(END) - 1 - len(START)
    blocks = F.split(F.substring(F.col("formatted"), F.lit(len(START) + 1), F.greatest(end, F.lit(0))), r"<\|im_end\|>\n<\|im_start\|>")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"<\|im_sep\|>"),
                lambda text: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
