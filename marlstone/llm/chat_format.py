"""Prefix-target expansion of conversations into training examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``start`` role newline text ``end`` newline, for each turn.

    Control strings all begin with ``mark``. In texts and roles a backslash is
    doubled and the mark gets a backslash between its two characters, so an
    escaped text never holds a control string and can be read back.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    mark: str = "<|"

    def escape(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(self.mark), F.lit(f"{self.mark[0]}\\{self.mark[1:]}"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def escape_role(self, role: Column) -> Column:
        """As ``escape``; a newline, which ends the role, becomes backslash and N."""
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\N"))

    def unescape_role(self, role: Column) -> Column:
        pairs = F.regexp_extract_all(role, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
        return F.array_join(F.transform(pairs, lambda p: F.when(p == "\\N", F.lit("\n")).when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)), "")

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), self.escape_role(role), F.lit("\n"))

    def tail(self) -> Column:
        return F.lit(f"{self.end}\n")


def prefix_target_examples(turns: DataFrame, template: ChatTemplate = ChatTemplate(), target_role: str = "assistant") -> DataFrame:
    """One example per turn of ``target_role``: all turns before it as context, its text alone trainable.

    Returns conv_id, example, target_turn, is_last, formatted, loss_start and
    loss_chars (code points; the loss mask is that span of ``formatted``).
    Turns behind the last target, or a conversation without one, become one
    more example without a target (null target_turn, empty mask), so that no
    turn is lost. ``is_last`` marks the example that holds the whole
    conversation. A null role or text counts as empty; a null conv_id is a
    conversation of its own; turns are ordered by turn (nulls first), role,
    text, so ties and repeated rows have one result. Other columns are ignored.

    An example holds its whole context, so a conversation's turns meet in one
    row by definition of the output; conversations share no task state.
    """
    piece = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    convs = turns.select("conv_id", piece.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    shown = F.transform(
        F.col("ts"),
        lambda t: F.struct(
            t["turn"].alias("turn"),
            (t["role"] == target_role).alias("target"),
            template.head(t["role"]).alias("head"),
            template.escape(t["text"]).alias("body"),
        ),
    )
    convs = convs.select("conv_id", shown.alias("ts"))
    n = F.size("ts")
    ends = F.filter(F.transform(F.col("ts"), lambda t, i: F.when(t["target"] | (i == n - 1), i)), lambda i: i.isNotNull())
    cut = convs.select("conv_id", "ts", n.alias("n"), F.posexplode(ends).alias("example", "k"))
    last = F.element_at("ts", F.col("k") + 1)
    context = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("k")), lambda t: F.concat(t["head"], t["body"], template.tail())), "")
    head = F.concat(context, last["head"])
    return cut.select("conv_id", "example", "n", "k", last.alias("last"), head.alias("head")).select(
        "conv_id",
        "example",
        F.when(F.col("last.target"), F.col("last.turn")).alias("target_turn"),
        (F.col("k") == F.col("n") - 1).alias("is_last"),
        F.concat("head", "last.body", template.tail()).alias("formatted"),
        F.char_length("head").alias("loss_start"),
        F.when(F.col("last.target"), F.char_length("last.body")).otherwise(0).alias("loss_chars"),
    )


def read_back(examples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation, from the formatted strings and masks alone: its turns and its trained texts.

    Returns conv_id, turns array<struct<role, text>>, loss array<string> (the
    unescaped text under each example's mask, in order) and formatted_chars
    (code points of all its examples).
    """
    parts = F.filter(F.split(F.col("formatted"), rf"\Q{template.end}\E\n"), lambda p: p.startswith(template.start))
    turns = F.transform(
        F.transform(parts, lambda p: F.substring(p, len(template.start) + 1, 1 << 30)),
        lambda p: F.struct(
            template.unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            template.unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    read = examples.select(
        "conv_id",
        "example",
        F.when(F.col("is_last"), turns).alias("turns"),
        F.when(F.col("target_turn").isNotNull() | (F.col("loss_chars") > 0), template.unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars")))).alias("loss"),
        F.char_length("formatted").alias("chars"),
    )
    return read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]).alias("loss"),
        F.sum(F.col("chars").cast("long")).alias("formatted_chars"),
    )
