"""Packages: the files of a handoff for every conversation, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import content as C
from threadloom.functions import fixed as X
from threadloom.functions import text as T
from threadloom.operators.graph import Branches, active_branch
from threadloom.operators.messages import Options, recent_selection, visible_messages
from threadloom.operators.stats import conversation_stats
from threadloom.plans.sections import context_sections, render_documents
from threadloom.plans.transcript import transcripts
from threadloom.session import checkpointed

GENERATED_BY = "threadloom 1.0.0"


def prompt_stats(visible: DataFrame) -> DataFrame:
    return visible.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(T.word_count(F.col("plain_text"))).cast("bigint").alias("words"))


def prompts(conversations: DataFrame, visible: DataFrame) -> DataFrame:
    """conv_id and prompt: instructions for a summary that any model can write."""
    c = conversations.join(prompt_stats(visible), "conv_id", "left").na.fill(0, ["messages", "words"])
    fill: dict[str, Column] = {
        "title": T.collapse_whitespace(C.display_title(F.col("title"))),
        "id": T.sanitize_display(F.col("conv_id")),
        "created": T.format_time(F.col("create_time")),
        "updated": T.format_time(F.col("update_time")),
        "messages": F.col("messages").cast("string"),
        "words": F.col("words").cast("string"),
    }
    fixed = X.PROMPT.replace("{empty}", X.EMPTY_BODY).replace("{headings}", "\n".join(f"## {h}" for h in X.SECTIONS)).replace("{continuation}", X.CONTINUATION)
    parts: list[Column] = []
    for name, column in fill.items():
        before, fixed = fixed.split("{" + name + "}", 1)
        parts += [F.lit(before), column]
    return c.select("conv_id", F.concat(*parts, F.lit(fixed)).alias("prompt"))


def metadata(conversations: DataFrame, stats: DataFrame, branches: Branches, selection: DataFrame, source: str, mode: str) -> DataFrame:
    """conv_id and the fields of metadata.json, in its order."""
    c = conversations.join(stats, "conv_id").join(branches.meta, "conv_id").join(selection, "conv_id", "left")
    return c.select(
        F.col("conv_id").alias("conversation_id"), "title", T.format_time(F.col("create_time")).alias("created_at"), T.format_time(F.col("update_time")).alias("updated_at"),
        "active_branch_messages", "total_nodes", "user_messages", "assistant_messages", F.col("characters").alias("approx_characters"), F.col("words").alias("approx_words"),
        "alternative_branches", F.col("strategy").alias("branch_strategy"), F.lit(mode).alias("context_mode"), F.coalesce("message_count", F.lit(0)).alias("recent_messages_preserved"),
        F.lit(source).alias("source"), F.lit(GENERATED_BY).alias("generated_by"), "warnings",
    )


def json_value(c: Column) -> Column:
    """A scalar as JSON."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, 6, F.length(whole) - 6)


def pretty(df: DataFrame) -> Column:
    """A row as indented JSON with sorted keys and a line end; arrays hold strings."""
    lines = []
    for name in sorted(df.columns):
        value = json_value(F.col(name))
        if df.schema[name].dataType.typeName() == "array":
            many = F.concat(F.lit("[\n    "), F.array_join(F.transform(name, json_value), ",\n    "), F.lit("\n  ]"))
            value = F.when(F.size(name) > 0, many).otherwise("[]")
        lines.append(F.concat(F.lit(f'  "{name}": '), value))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def packages(conversations: DataFrame, nodes: DataFrame, options: Options = Options(), mode: str = "deterministic", source: str = "", raw: DataFrame | None = None) -> DataFrame:
    """conv_id, filename and contents for every conversation that has a branch; ``raw``: conv_id and raw elements."""
    branches = active_branch(conversations, nodes)
    usable = conversations.join(branches.meta.where("status = 'ok'").select("conv_id"), "conv_id", "left_semi")
    visible = checkpointed(visible_messages(nodes, branches, options))  # read by every section
    selection = recent_selection(visible, options.recent_messages, options.recent_chars).select("conv_id", "message_count")
    stats = conversation_stats(nodes, branches)
    meta = metadata(usable, stats, branches, selection, source, mode)
    record = pretty(meta)
    files = [
        ("context.md", render_documents(context_sections(usable, visible, options, mode)), "document"),
        ("transcript.md", transcripts(usable, visible), "transcript"),
        ("metadata.json", meta.select(F.col("conversation_id").alias("conv_id"), record.alias("record")), "record"),
    ]
    if mode == "prompt":
        files.append(("summarization-prompt.md", prompts(usable, visible), "prompt"))
    if raw is not None:
        files.append(("raw-conversation.json", raw.join(usable.select("conv_id"), "conv_id", "left_semi"), "raw"))
    out = None
    for name, df, column in files:
        one = df.select("conv_id", F.lit(name).alias("filename"), F.col(column).alias("contents"))
        out = one if out is None else out.unionByName(one)
    return out


def show_records(conversations: DataFrame, nodes: DataFrame, branches: Branches) -> DataFrame:
    """All counters with identity, times, strategy and warnings, a row for each conversation with a branch."""
    stats = conversation_stats(nodes, branches)
    c = conversations.join(branches.meta.where("status = 'ok'"), "conv_id").join(stats, "conv_id")
    return c.select(F.col("conv_id").alias("conversation_id"), "title", T.format_time(F.col("create_time")).alias("created_at"), T.format_time(F.col("update_time")).alias("updated_at"), F.col("strategy").alias("branch_strategy"), "warnings", *(x for x in stats.columns if x != "conv_id"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
