"""Message contents as text and Markdown.

A content is a tag (kind) with the fields of its arm: text (parts), multimodal (parts), code (language, text),
tool_output (text), other (text or parts that could be saved) and empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T


def blank(s: Column) -> Column:
    return T.trim(s) == ""


def part_text(p: Column) -> Column:
    """A part as Markdown; what is no text becomes a short marker."""
    audio = F.when(p["text"].isNotNull() & ~blank(p["text"]), F.concat(F.lit("[audio transcript] "), p["text"])).otherwise("[audio attachment]")
    file = F.when(p["name"].isNotNull(), F.concat(F.lit("[file attachment: "), T.sanitize_display(p["name"]), F.lit("]"))).otherwise("[file attachment]")
    unknown = F.concat(F.lit("[unsupported content: "), T.sanitize_display(p["name"]), F.lit("]"))
    return F.when(p["kind"] == "text", p["text"]).when(p["kind"] == "image", F.lit("[image attachment]")).when(p["kind"] == "audio", audio).when(p["kind"] == "file", file).otherwise(unknown)


def rendered_parts(c: Column) -> Column:
    return F.transform(c["parts"], part_text)


def saved(c: Column) -> Column:
    """Text that an unknown content carries, null if it is blank."""
    own = F.when(c["text"].isNotNull(), c["text"]).when(F.size(c["parts"]) > 0, F.array_join(rendered_parts(c), "\n\n"))
    return F.when(~blank(own), own)


def effective_kind(c: Column) -> Column:
    """Text whose parts are all blank is empty."""
    hollow = (c["kind"] == "text") & F.forall(rendered_parts(c), blank)
    return F.when(c.isNull() | hollow, F.lit("empty")).otherwise(c["kind"])


def content_type(c: Column) -> Column:
    return F.when(effective_kind(c) == "empty", F.lit("empty")).otherwise(c["content_type"])


def plain_text(c: Column) -> Column:
    """Words only: markers of attachments don't count."""
    spoken = F.filter(c["parts"], lambda p: p["kind"].isin("text", "audio") & p["text"].isNotNull())
    kind = effective_kind(c)
    return (
        F.when(kind == "text", F.array_join(rendered_parts(c), "\n\n"))
        .when(kind == "multimodal", F.array_join(F.transform(spoken, lambda p: p["text"]), "\n\n"))
        .when(kind.isin("code", "tool_output"), c["text"])
        .when(kind == "other", F.coalesce(saved(c), F.lit("")))
        .otherwise("")
    )


def fence_language(language: Column) -> Column:
    word = F.regexp_extract(T.sanitize_display(T.collapse_whitespace(language)), r"^([^ \t\n]*)", 1)
    return T.truncate_graphemes(F.regexp_replace(word, r"[^\p{IsAlphabetic}\p{N}\-_+#.]", ""), 24)


def fenced(language: Column, body: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), 0), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(2)) + 1)
    return F.concat(fence, fence_language(F.coalesce(language, F.lit(""))), F.lit("\n"), T.trim_end(body), F.lit("\n"), fence)


def markdown(c: Column) -> Column:
    shown = F.filter(F.transform(rendered_parts(c), T.trim_end), lambda p: p != "")
    kind = effective_kind(c)
    omitted = F.concat(F.lit("["), T.sanitize_display(c["content_type"]), F.lit(" content omitted]"))
    return (
        F.when(kind.isin("text", "multimodal"), F.array_join(shown, "\n\n"))
        .when(kind == "code", fenced(c["language"], c["text"]))
        .when(kind == "tool_output", F.when(blank(c["text"]), F.lit("[tool output omitted]")).otherwise(fenced(F.lit(""), c["text"])))
        .when(kind == "other", F.coalesce(T.trim_end(saved(c)), omitted))
        .otherwise("")
    )


def role_heading(role: Column) -> Column:
    """Title case; of other roles the first letter, 40 clusters at most."""
    cut = T.truncate_graphemes(T.collapse_whitespace(role), 40)
    other = F.when(cut == "", F.lit("Unknown")).otherwise(F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(cut, 2, 1_000_000)))
    known = F.when(role.isin("user", "assistant", "system", "developer", "tool"), F.initcap(role))
    return F.coalesce(known, other)


def message_heading(role: Column, author_name: Column) -> Column:
    """Tools carry their name."""
    name = T.collapse_whitespace(T.sanitize_display(author_name))
    return F.when((role == "tool") & (name != ""), F.concat(F.lit("Tool ("), T.truncate_graphemes(name, 40), F.lit(")"))).otherwise(role_heading(role))


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their message as columns: conv_id, node_id, parent, n_children, has_message, role, author_name,
    hidden, kind, content_type, language, plain_text, markdown, is_empty."""
    m, c = F.col("message"), F.col("message.content")
    if_message = lambda x: F.when(m.isNotNull(), x)
    out = nodes.select(
        "conv_id", "node_id", "parent", F.size("children").alias("n_children"), m.isNotNull().alias("has_message"),
        F.col("message.role").alias("role"), F.col("message.author_name").alias("author_name"), F.col("message.hidden").alias("hidden"),
        if_message(effective_kind(c)).alias("kind"), if_message(content_type(c)).alias("content_type"), F.col("message.content.language").alias("language"),
        if_message(plain_text(c)).alias("plain_text"), if_message(markdown(c)).alias("markdown"),
    )
    return out.withColumn("is_empty", F.when(F.col("has_message"), (F.col("kind") == "empty") | blank(F.col("markdown"))))


def display_title(title: Column) -> Column:
    shown = T.sanitize_display(T.collapse_whitespace(title))
    return F.coalesce(F.when(T.trim(shown) != "", shown), F.lit("(untitled)"))


def display_id(conv_id: Column) -> Column:
    shown = T.sanitize_display(T.collapse_whitespace(conv_id))
    return F.coalesce(F.when(T.trim(shown) != "", shown), F.lit("(unnamed)"))
