"""Which messages of a branch are shown, and the tail that is kept verbatim."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.graph import KEY, Branches
from threadloom.operators.ordered import numbered


@dataclass(frozen=True)
class Options:
    """Flags of roles, size of the verbatim tail; times are shown in the session's zone."""

    include_system: bool = False
    include_tools: bool = False
    include_developer: bool = False
    include_hidden: bool = False
    recent_messages: int = 30
    recent_chars: int | None = None


def is_included(o: Options):
    """Empty messages never show, hidden ones by flag; other roles go with tools."""
    role = F.coalesce("role", F.lit("unknown"))
    by_role = F.when(role.isin("user", "assistant"), True).when(role == "system", o.include_system).when(role == "developer", o.include_developer).otherwise(o.include_tools)
    return (~F.coalesce("hidden", F.lit(False)) | F.lit(o.include_hidden)) & ~F.coalesce("is_empty", F.lit(True)) & by_role


def visible_messages(nodes: DataFrame, branches: Branches, options: Options = Options()) -> DataFrame:
    """Shown messages of each branch with idx (from 0), n (how many) and size (clusters of plain text).  Places are
    counted on keys; texts travel once, to meet them."""
    shown = nodes.where("has_message").where(is_included(options))
    keys = numbered(shown.select(*KEY).join(branches.path, KEY), ["conv_id"], [F.col("pos").asc()])
    places = keys.select(*KEY, "pos", (F.col("rn") - 1).alias("idx"), "n")
    return shown.join(places, KEY).withColumn("size", T.grapheme_count(F.col("plain_text")))


def tail(visible: DataFrame, max_messages: int = 30, max_chars: int | None = None) -> DataFrame:
    """The last messages up to either limit; the very last one always stays unless ``max_messages`` is 0."""
    back = F.col("n") - F.col("idx")
    last = visible.where(back <= max_messages)
    if max_chars is None:
        return last
    # of a group no more than max_messages rows are left here, so a window over keys is small
    w = Window.partitionBy("conv_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = last.select("conv_id", "idx", "n", F.sum("size").over(w).alias("total")).where((back == 1) | (F.col("total") <= max_chars))
    return last.join(keys.select("conv_id", "idx"), ["conv_id", "idx"], "left_semi")


def recent_selection(visible: DataFrame, max_messages: int = 30, max_chars: int | None = None) -> DataFrame:
    """conv_id, start_index, message_count and characters of the tail, for conversations with shown messages."""
    kept = tail(visible, max_messages, max_chars).groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum("size").cast("bigint").alias("characters"))
    sizes = visible.groupBy("conv_id").agg(F.count("*").alias("n"))
    out = sizes.join(kept, "conv_id", "left").na.fill(0, ["message_count", "characters"])
    return out.select("conv_id", (F.col("n") - F.col("message_count")).alias("start_index"), "message_count", "characters")
