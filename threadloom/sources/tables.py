"""Conversation graphs from flat tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import content as C


def identifiers(turns: DataFrame) -> DataFrame:
    return turns.withColumn("conv", F.col("conv_id").cast("string")).withColumn("node", F.lpad(F.col("turn").cast("string"), 4, "0"))


def as_nodes(turns: DataFrame, parent) -> DataFrame:
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"))
    none = F.lit(None).cast("string")
    code = F.col("code") if "code" in turns.columns else F.lit(False)
    kind, parts = F.when(code, "code").otherwise("text"), F.array(part)
    content = F.struct(kind.alias("kind"), kind.alias("content_type"), F.when(code, "python").alias("language"), F.when(code, F.col("text")).alias("text"), F.when(code, F.slice(parts, 1, 0)).otherwise(parts).alias("parts"))
    hidden = F.col("hidden") if "hidden" in turns.columns else F.lit(False)
    message = F.struct(F.col("role").alias("role"), none.alias("author_name"), hidden.alias("hidden"), content.alias("content"))
    rows = identifiers(turns).select(F.col("conv").alias("conv_id"), F.col("node").alias("node_id"), parent.alias("parent"), F.array().cast("array<string>").alias("children"), message.alias("message"))
    return C.flat_nodes(rows)


def as_conversations(turns: DataFrame, current) -> DataFrame:
    """Title: the start of the first turn; times grow with the id."""
    by = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min_by(F.substring("text", 1, 40), "turn").alias("title"))
    created = F.lit(1.7e9) + F.col("conv_id") * 60
    return by.select(F.col("conv_id").cast("string").alias("conv_id"), "title", created.alias("create_time"), (created + F.col("last") * 30).alias("update_time"), current.alias("current_node"))


def linear(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations and nodes of threads without forks."""
    turn = F.col("turn")
    parent = F.when(turn > 0, F.lpad((turn - 1).cast("string"), 4, "0"))
    return as_conversations(turns, F.lpad(F.col("last").cast("string"), 4, "0")), as_nodes(turns, parent)


def damaged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with forks, orphans, cycles and pointers that are missing or dangle, by arithmetic on ids."""
    turn, conv = F.col("turn"), F.col("conv_id")
    parent = F.when((turn == 0) & (conv % 11 == 0), F.lit("0001")).when(turn == 0, F.lit(None)).when((conv % 7 == 0) & (turn == 3), F.lit("0999")).when(turn % 3 == 2, F.lpad((turn - 2).cast("string"), 4, "0")).otherwise(F.lpad((turn - 1).cast("string"), 4, "0"))
    current = F.when(conv % 13 == 0, F.lit(None)).when(conv % 5 == 0, F.lit("-001")).otherwise(F.lpad(F.col("last").cast("string"), 4, "0"))
    return as_conversations(turns, current), as_nodes(turns, parent)


#: Sentences that every cue-based section and every kind of term is found by; {} is a number that makes them distinct.
PLANTED = (
    "I prefer small modules in part {}.",
    "We decided to use plan {}.",
    "Therefore the store of part {} is local.",
    "We tried Redis {} but it didn't work.",
    "Which file comes after number {}?",
    "Please ask Ada Lovelace about `item {}` today.",
)


def planted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The linear view with sentences added, and with hidden, tool and code messages, by arithmetic on ids."""
    k = F.col("conv_id") * 5 + F.col("turn")
    text = F.col("text")
    for i, sentence in enumerate(PLANTED):
        before, after = sentence.split("{}")
        text = F.when(k % 12 == i, F.concat("text", F.lit("\n" + before), k.cast("string"), F.lit(after))).otherwise(text)
    changed = turns.withColumns({"text": text, "role": F.when(k % 29 == 7, "tool").otherwise(F.col("role")), "hidden": k % 31 == 5, "code": k % 13 == 6})
    return linear(changed)


def deep(events: DataFrame, width: int = 16, ring: int = 3) -> DataFrame:
    """Nodes of a few very deep graphs: each event follows the one ``width`` ids before it; graph ``ring`` is a cycle."""
    at, conv = F.col("event_id"), F.col("event_id") % width
    ends = events.groupBy(conv.alias("c")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    rows = events.select("event_id", conv.alias("c")).join(F.broadcast(ends), "c")  # a row for each graph
    parent = F.when(at > F.col("first"), at - width).when(F.col("c") == ring, F.col("last"))
    return rows.select(F.col("c").cast("string").alias("conv_id"), at.cast("string").alias("node_id"), parent.cast("string").alias("parent"), (at % 3 == 0).alias("has_message"))


def export_files(turns: DataFrame, files: int = 8) -> DataFrame:
    """path, length and content of JSON exports: every sixth conversation twice (an older copy first), every ninth
    followed by an element that can't be read."""
    conversations, nodes = linear(turns)
    t = identifiers(turns)
    message = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    parent = F.when(F.col("turn") > 0, F.lpad((F.col("turn") - 1).cast("string"), 4, "0"))
    node = F.struct(F.col("node"), F.struct(F.col("node").alias("id"), parent.alias("parent"), F.array().cast("array<string>").alias("children"), message.alias("message")))
    mapping = t.groupBy(F.col("conv").alias("conv_id")).agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))
    c = conversations.join(mapping, "conv_id").withColumn("number", F.col("conv_id").cast("bigint"))
    own = F.to_json(F.struct(F.col("conv_id").alias("id"), "title", "create_time", "update_time", "current_node", "mapping"))
    older = F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("an older copy").alias("title"), "create_time", (F.col("update_time") - 1).alias("update_time"), F.create_map().cast("map<string,string>").alias("mapping")))
    odd = F.to_json(F.struct(F.concat("conv_id", F.lit("-odd")).alias("id"), F.lit(7).alias("title")))
    some = F.filter(F.array(F.when(F.col("number") % 6 == 0, older), own, F.when(F.col("number") % 9 == 0, odd)), lambda x: x.isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("number", some.alias("some"))))
    body = F.concat(F.lit("["), F.array_join(F.flatten(F.transform(listed, lambda x: x["some"])), ","), F.lit("]"))
    out = c.groupBy((F.col("number") % files).alias("file")).agg(body.alias("body"))
    return out.select(F.concat(F.lit("/exports/"), F.col("file").cast("string"), F.lit(".json")).alias("path"), F.octet_length("body").cast("bigint").alias("length"), F.encode("body", "UTF-8").alias("content"))
