"""Finding the conversation that a selector means: tiers from exact id to fuzzy title, the first with a hit decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import errors as E
from threadloom.functions import content as C
from threadloom.functions import text as T
from threadloom.operators.search import might_match, scorer

PREFIX_LEAST, FUZZY_LEAST, CONFIDENT, LEAD, EXACT, SHOWN = 8, 50, 85, 20, 100, 10
TIERS = ("exact id", "id prefix", "exact title", "title ignoring case", "fuzzy title")


@dataclass(frozen=True)
class Selector:
    query: str | None = None
    id: str | None = None
    title: str | None = None

    def is_empty(self) -> bool:
        return self.id is None and self.title is None and self.query is None

    def describe(self) -> str:
        for name, value in (("conversation id", self.id), ("title", self.title), ("query", self.query)):
            if value is not None:
                return f"{name} {quoted(value)}"
        return "no selector"

    def lanes(self) -> tuple[str, str]:
        """What is looked for among ids and among titles; empty where there is nothing."""
        by_id = self.id if self.id is not None else self.query if self.title is None else None
        by_title = self.title if self.title is not None else self.query if self.id is None else None
        return (by_id or "").strip(), (by_title or "").strip()


def quoted(s: str) -> str:
    """With double quotes and escapes for what could not be read."""
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\", "\0": "\\0"}
    return '"' + "".join(plain.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in s) + '"'


def candidates(conversations: DataFrame, selector: Selector) -> DataFrame:
    """Conversations of the first tier with a hit: conv_id, title (as shown), tier, score, place and unique.

    The plain tiers take one pass; titles are scored only where these have no hit, and only those that hold the needle.
    """
    by_id, by_title = selector.lanes()
    shown = C.display_title(F.col("title"))
    exact = F.lit(None).cast("int")
    if by_title:
        low = by_title.lower()
        exact = F.when((F.col("title") == by_title) | (F.col("shown") == by_title), 2).when((F.lower("title") == low) | (F.lower("shown") == low), 3)
    if by_id:
        exact = F.when(F.col("conv_id") == by_id, 0).when(F.lit(len(by_id) >= PREFIX_LEAST) & F.startswith(F.col("conv_id"), F.lit(by_id)), 1).otherwise(exact)
    rows = conversations.select("conv_id", "title", "update_time", shown.alias("shown")).withColumn("tier", exact)
    hits = rows.where("tier is not null").withColumn("score", F.lit(EXACT))
    if by_title and not hits.limit(1).count():
        scored = rows.where(might_match(F.col("shown"), by_title)).withColumn("score", scorer(by_title)(F.col("shown")))
        hits = scored.where(F.col("score") >= FUZZY_LEAST).withColumn("tier", F.lit(len(TIERS) - 1))
    first = hits.agg(F.min("tier").alias("tier"), F.count("*").alias("all_hits"))
    hits = hits.join(F.broadcast(first.select("tier")), "tier", "left_semi")  # one row
    order = [F.desc("score"), F.coalesce("update_time", F.lit(float("-inf"))).desc(), F.col("conv_id")]
    # the first ones and how many there are, without a sort of all hits
    best = hits.orderBy(*order).limit(SHOWN)
    w = Window.orderBy(*order)
    best = best.withColumn("place", F.row_number().over(w) - 1).withColumn("lead", F.max(F.when(F.col("place") == 1, F.col("score"))).over(Window.partitionBy()))
    best = best.withColumn("hits", F.count("*").over(Window.partitionBy()))
    sure = (F.col("tier") == 4) & (F.col("score") >= CONFIDENT) & (F.col("score") - F.coalesce("lead", F.lit(0)) >= LEAD)
    return best.select("conv_id", F.col("shown").alias("title"), "tier", F.col("score").cast("int").alias("score"), F.col("place").cast("int").alias("place"), ((F.col("place") == 0) & ((F.col("hits") == 1) | sure)).alias("unique"))


def resolve(conversations: DataFrame, selector: Selector) -> list[tuple[str, str, int]]:
    """One conversation (id, title, score), or up to ten candidates; raises if there is none."""
    if conversations.limit(1).count() == 0:
        raise E.EmptyExport
    if selector.is_empty():
        raise E.NoSelector
    rows = candidates(conversations, selector).orderBy("place").collect() if any(selector.lanes()) else []
    if not rows:
        raise E.NotFound(selector.describe())
    return [(r.conv_id, r.title, r.score) for r in rows[: 1 if rows[0].unique else SHOWN]]


def resolve_unique(conversations: DataFrame, selector: Selector) -> str:
    found = resolve(conversations, selector)
    if len(found) == 1:
        return found[0][0]
    spark = conversations.sparkSession
    shown = spark.createDataFrame([(i, *f) for i, f in enumerate(found)], "i int, id string, title string, score int").orderBy("i")
    texts = shown.select(T.truncate_graphemes(F.col("id"), 12), T.sanitize_display(F.col("title"))).collect()
    raise E.Ambiguous(selector.describe(), found, [tuple(t) for t in texts])
