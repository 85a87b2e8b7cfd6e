"""Counts of a conversation: its graph, and the messages of its active branch (hidden and empty ones too)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.graph import KEY, Branches, children_counts, linked

ROLES = ("user", "assistant", "system", "developer", "tool")


def graph_stats(nodes: DataFrame, branches: Branches) -> DataFrame:
    """total_nodes, nodes_with_messages, broken_parents, branch_points, alternative_branches, branch_depth and
    unreachable_nodes (their chain dies at a missing parent or in a cycle, and they aren't on the branch)."""
    up = linked(nodes.select(*KEY, "parent", "has_message"))
    own = up.groupBy("conv_id").agg(F.count("*").alias("total_nodes"), F.count_if("has_message").alias("nodes_with_messages"), F.count_if(F.col("parent").isNotNull() & F.col("up").isNull()).alias("broken_parents"))
    forks = children_counts(nodes).groupBy("conv_id").agg(F.count_if(F.col("children") > 1).alias("branch_points"), F.sum(F.col("children") - 1).alias("alternative_branches"))
    depth = branches.path.groupBy("conv_id").agg(F.count("*").alias("branch_depth"))
    lost = branches.chains.where("not grounded").join(branches.path, KEY, "left_anti").groupBy("conv_id").agg(F.count("*").alias("unreachable_nodes"))
    out = own.join(forks, "conv_id", "left").join(depth, "conv_id", "left").join(lost, "conv_id", "left")
    return out.na.fill(0, ["branch_points", "alternative_branches", "branch_depth", "unreachable_nodes"])


def message_stats(messages: DataFrame) -> DataFrame:
    """Counts over branch messages (conv_id, role, plain_text)."""
    role = F.col("role")
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("active_branch_messages"),
        *(F.count_if(role == r).alias(f"{r}_messages") for r in ROLES),
        F.count_if(~F.coalesce(role, F.lit("unknown")).isin(*ROLES)).alias("other_messages"),
        F.sum(T.grapheme_count(F.col("plain_text"))).cast("bigint").alias("characters"),
        F.sum(T.word_count(F.col("plain_text"))).cast("bigint").alias("words"),
    )


def conversation_stats(nodes: DataFrame, branches: Branches) -> DataFrame:
    """All counters, a row for each conversation with nodes."""
    out = graph_stats(nodes, branches).join(message_stats(branch_messages(nodes, branches)), "conv_id", "left")
    return out.na.fill(0)


def branch_messages(nodes: DataFrame, branches: Branches) -> DataFrame:
    """Nodes of the branch that carry a message, with pos."""
    return nodes.where("has_message").join(branches.path, KEY)
