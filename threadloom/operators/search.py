"""Fuzzy search over titles, ids and contents of all conversations, and the listing of conversations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import content as C
from threadloom.functions import text as T

CLAMP = 4096  # characters of either side that are compared
#: Points of the affine-gap matching family: a match, its bonus by what stands before it, and gaps.
MATCH, GAP_START, GAP_MORE, BOUNDARY, WHITE, CAMEL, CONSECUTIVE, FIRST = 16, 3, 1, 8, 10, 7, 4, 2
ID_EXACT, ID_PREFIX, ID_PREFIX_LEAST, EXCERPT = 100, 95, 4, 120
FIELD_RANK = {"title": 0, "id": 1, "content": 2}


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 20
    search_content: bool = False
    min_score: int = 30


def plain(text: str) -> str:
    """Lower case without accents, one character for one."""
    if text.isascii():
        return text.lower()
    return "".join(unicodedata.normalize("NFD", c)[0].lower()[:1] or c for c in text)


def bonus(before: str, c: str) -> int:
    if before == "" or before.isspace():
        return WHITE if not c.isspace() else 0
    if c.isalnum() and not before.isalnum():
        return BOUNDARY
    return CAMEL if (c.isupper() and before.islower()) or (c.isdigit() and not before.isdigit()) else 0


def raw_score(haystack: str, needle: str) -> int | None:
    """Best alignment of the needle as a subsequence; None if it is none."""
    hay, pin = plain(haystack), plain(needle)
    at = -1
    for c in pin:
        at = hay.find(c, at + 1)
        if at < 0:
            return None
    bonuses = [bonus(haystack[i - 1] if i else "", haystack[i]) for i in range(len(haystack))]
    low = -(10**6)
    ended: list[int] = []  # best with the last needle character matched here
    held: list[int] = []  # the bonus that a run up to here goes on with
    for j, c in enumerate(pin):
        now, run = [low] * len(hay), [0] * len(hay)
        best = low  # over earlier ends, less the gap since
        for i, h in enumerate(hay):
            if j and i >= 2:
                best = max(best - GAP_MORE, ended[i - 2] - GAP_START)
            if h != c:
                continue
            if j == 0:
                now[i], run[i] = MATCH + bonuses[i] * FIRST, bonuses[i]
                continue
            jump = best + MATCH + bonuses[i]
            now[i], run[i] = jump, bonuses[i]
            if i and ended[i - 1] > low // 2:
                kept = max(held[i - 1], CONSECUTIVE, bonuses[i])
                if (step := ended[i - 1] + MATCH + kept) >= jump:
                    now[i], run[i] = step, max(held[i - 1], bonuses[i])
        ended, held = now, run
    return max(0, max(ended, default=0))


def scorer(needle: str):
    """A column function: 0 to 100 against the needle's score with itself, null where it doesn't match."""
    pin = needle[:CLAMP]
    perfect = raw_score(pin, pin) or 0

    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in s:
            found = [raw_score(h[:CLAMP], pin) if h else None for h in batch]
            yield pd.Series([None if r is None else min(100, r * 100 // perfect) for r in found], dtype="Int32")

    score.__annotations__ = {"s": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "int") if perfect else lambda _: F.lit(None).cast("int")


def might_match(text: Column, needle: str) -> Column:
    """Does the text hold the needle's characters in their order?  A plain filter, in linear time, that keeps most rows
    away from Python; rows whose characters may fold to others are let through."""
    parts = [c for c in plain(needle) if c.isascii() or (c == unicodedata.normalize("NFD", c) and c.lower() == c.upper())]
    folds = ~text.rlike(r"^\p{ASCII}*$") if needle.isascii() else text.rlike(r"[\x{C0}-\x{24F}\x{1E00}-\x{1FFF}\x{FB00}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return folds | F.lower(text).rlike("(?s)^" + "".join(f"[^\\x{{{ord(c):x}}}]*+\\x{{{ord(c):x}}}" for c in parts))


def search(conversations: DataFrame, nodes: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """conv_id, title, score, field, excerpt and rank of the best hits: the best field of each conversation, then by
    score, newest update, id.  Contents are those of all nodes, on the branch or not."""
    q = query.strip()
    spark = conversations.sparkSession
    if not q or options.limit == 0:
        return spark.createDataFrame([], "conv_id string, title string, score int, field string, excerpt string, rank int")
    score = scorer(q)
    title = C.display_title(F.col("title"))
    base = conversations.select("conv_id", "title", "update_time", title.alias("shown"))
    none = F.lit(None).cast("string")
    by_title = base.where(might_match(F.col("shown"), q)).select("conv_id", score("shown").alias("score"), F.lit("title").alias("field"), none.alias("excerpt"))
    low = F.lower("conv_id")
    exact = F.when(low == q.lower(), F.lit(ID_EXACT)).when(F.lit(len(q) >= ID_PREFIX_LEAST) & F.startswith(low, F.lit(q.lower())), F.lit(ID_PREFIX))
    by_id = base.where(might_match(F.col("conv_id"), q)).select("conv_id", F.coalesce(exact, score("conv_id")).alias("score"), F.lit("id").alias("field"), none.alias("excerpt"))
    hits = by_title.unionByName(by_id)
    if options.search_content:
        own = nodes.where(F.col("has_message") & ~C.blank(F.col("plain_text")) & might_match(F.col("plain_text"), q))
        scored = own.select("conv_id", "node_id", "plain_text", score(F.substring("plain_text", 1, CLAMP)).alias("score")).where("score is not null")
        first = F.min(F.struct((-F.col("score")).alias("score"), "node_id", "plain_text")).alias("b")
        best = scored.groupBy("conv_id").agg(first).select("conv_id", (-F.col("b.score")).alias("score"), "b.plain_text")
        excerpt = T.truncate_graphemes(T.collapse_whitespace(F.col("plain_text")), EXCERPT)
        hits = hits.unionByName(best.select("conv_id", "score", F.lit("content").alias("field"), excerpt.alias("excerpt")))
    rank = F.create_map(*(F.lit(x) for pair in FIELD_RANK.items() for x in pair))[F.col("field")]
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), rank)
    one = hits.where(F.col("score") >= options.min_score).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    order = [F.desc("score"), F.coalesce("update_time", F.lit(float("-inf"))).desc(), F.col("conv_id")]
    found = one.join(base.drop("shown"), "conv_id").orderBy(*order).limit(options.limit)
    return found.select("conv_id", "title", "score", "field", "excerpt", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def list_conversations(conversations: DataFrame, sort: str = "updated", reverse: bool = False, limit: int | None = None) -> DataFrame:
    """conversations in order: newest update or creation first (missing times last), or by title; then by id."""
    least = F.lit(-1.7976931348623157e308)
    key = {"updated": (F.coalesce("update_time", least), True), "created": (F.coalesce("create_time", least), True), "title": (C.display_title(F.col("title")), False)}[sort]
    down = key[1] != reverse
    out = conversations.orderBy(key[0].desc() if down else key[0].asc(), F.desc("conv_id") if reverse else F.col("conv_id"))
    return out if limit is None else out.limit(limit)
