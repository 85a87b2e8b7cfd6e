"""Transcripts as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import content as C
from threadloom.functions import fixed as X
from threadloom.functions import text as T


def section(messages: DataFrame) -> Column:
    """A message under its heading."""
    return F.concat(F.lit("## "), C.message_heading(F.col("role"), F.col("author_name")), F.lit("\n\n"), F.col("markdown"))


def in_order(value: Column, *order: Column, sep: str) -> Column:
    """Aggregate: values joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def bodies(visible: DataFrame) -> DataFrame:
    """conv_id and body: the messages joined by blank lines."""
    return visible.groupBy("conv_id").agg(in_order(section(visible), F.col("idx"), sep="\n\n").alias("body"))


def render_messages(visible: DataFrame) -> DataFrame:
    """conv_id and fragment of the given messages; conversations without any are not there."""
    b = bodies(visible)
    return b.select("conv_id", F.when(C.blank(F.col("body")), F.lit("")).otherwise(T.safe_lines(F.col("body"))).alias("fragment"))


def transcripts(conversations: DataFrame, visible: DataFrame, empty: bool = True) -> DataFrame:
    """conv_id and transcript of every conversation given, or without ``empty`` of those with shown messages."""
    head = F.concat(
        F.lit("# "), T.collapse_whitespace(C.display_title(F.col("title"))), F.lit("\n\nConversation ID: "), C.display_id(F.col("conv_id")),
        F.lit("\nCreated: "), T.format_time(F.col("create_time")), F.lit("\nUpdated: "), T.format_time(F.col("update_time")), F.lit("\n\n---\n\n"),
    )
    out = conversations.join(bodies(visible), "conv_id", "left" if empty else "inner")
    return out.select("conv_id", T.safe_lines(F.concat(head, F.coalesce("body", F.lit(X.EMPTY_BRANCH)))).alias("transcript"))
