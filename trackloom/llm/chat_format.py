"""Chat formatting by prefix-target expansion (DataFrame operations only).

Every assistant turn becomes an example of its own: all preceding turns are its context and
only that reply is trainable. A conversation's examples are prefixes of one formatted
text, so the output shares them: one row per turn holds its formatted segment and
its code-point range, and one row per example says how far its text reaches and which
range the loss covers. A conversation of n turns thus takes n rows, not n*n/2, even
if it holds a third of the corpus. :func:`materialise_examples` joins an example's text.

Template of a turn: ``<s>[INST]role[/INST]text</s>``; role and text are escaped: a
backslash is doubled and a control string gets a backslash after its first character, so a control
string in the output is always the template's. ``unescape`` drops one backslash before
any character.

Defined results: turns go by (turn, role, text), nulls first, repeated rows stay; null role and
null text count as empty; a conversation without assistant turns has no example; rows with a
null conv_id form one conversation; very long texts are escaped whole; other columns are not read, whatever their
names; an empty table gives empty outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
CONTROL = r"<(?=/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn_no (0..), segment, seg_start, seg_end, loss_start, loss_end.

    The loss range is that of the reply's escaped text, null for other roles.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    rows = rows.withColumn("head_chars", F.length(head)).withColumn("segment", F.concat(head, escape(F.col("text")), F.lit(CLOSE)))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("segment").cast("long")).over(upto)
    rows = rows.withColumn("turn_no", F.row_number().over(by_turn) - 1).withColumn("seg_end", end)
    rows = rows.withColumn("seg_start", F.col("seg_end") - F.length("segment"))
    reply = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "turn_no",
        "segment",
        "seg_start",
        "seg_end",
        F.when(reply, F.col("seg_start") + F.col("head_chars")).alias("loss_start"),
        F.when(reply, F.col("seg_end") - len(CLOSE)).alias("loss_end"),
    )


def expand_examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its context is [0, context_end), its text [0, end), its loss [loss_start, loss_end)."""
    return turns.where("loss_start is not null").select(
        "conv_id", F.col("turn_no").alias("target_turn"), F.col("seg_start").alias("context_end"), F.col("seg_end").alias("end"), "loss_start", "loss_end"
    )


def materialise_examples(turns: DataFrame) -> DataFrame:
    """Each example with its whole text. Its size is that of the expansion, quadratic in a conversation's turns."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.array_join(F.collect_list("segment").over(by_turn), "")
    return turns.withColumn("text", text).where("loss_start is not null").select(
        "conv_id", F.col("turn_no").alias("target_turn"), "text", "loss_start", "loss_end"
    )


def conversations(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its segments in order, and its examples (those of :func:`expand_examples`) in order.

    Both sides keep the partitioning by conversation that :func:`format_turns` made, so nothing is shuffled again. A
    conversation's text is in one row here; :func:`format_turns` and :func:`expand_examples` do without.
    """
    order = lambda rows, field: F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[field])
    texts = turns.groupBy("conv_id").agg(order(F.struct("turn_no", "segment"), "segment").alias("segments"))
    ranges = F.struct("target_turn", "context_end", "end", "loss_start", "loss_end")
    made = examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(ranges)).alias("examples")).withColumnRenamed("conv_id", "of")
    return texts.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", "segments", F.coalesce("examples", F.array()).alias("examples"))


def read_turn(segment: Column) -> Column:
    """Role and text of a formatted segment."""
    inner = F.substr(segment, F.lit(len(OPEN) + 1), F.length(segment) - (len(OPEN) + len(CLOSE)))
    cut = F.instr(inner, ROLE_END)
    return F.struct(unescape(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + len(ROLE_END))).alias("text"))


def read_losses(segments: Column, examples: Column) -> Column:
    """The trained text of every example, unescaped: its loss range, cut out of the segment that follows its context."""

    def trained(e: Column) -> Column:
        # a code point of the range is found from its segment's start, not the conversation's
        target = F.get(segments, e["target_turn"])
        return unescape(F.substr(target, (e["loss_start"] - e["context_end"] + 1).cast("int"), (e["loss_end"] - e["loss_start"]).cast("int")))

    return F.transform(examples, trained)
