"""Conversation graphs for all conversations at once: walks to the root, longest chains, active branches.

Nodes are rows (conv_id, node_id, parent, has_message).  Pointer doubling follows parents 1, 2, 4, ... steps at a time,
so a chain of depth d takes log d rounds with one join on (conv_id, node_id) each, whatever the number of conversations
and however the nodes spread over them; a very large conversation is dealt over tasks like everything else.  Each round
is written, so its plan doesn't hold the rounds before it.  A walk stops at a node without parent, at a parent that
doesn't exist, or where it would meet a node twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import contraction
from threadloom.operators.ordered import numbered
from threadloom.session import written

KEY = ["conv_id", "node_id"]
DEEP = 4096  # nodes of a graph beyond which chains are found by contraction


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``up``: the parent if it exists, else null."""
    ids = nodes.select("conv_id", F.col("node_id").alias("up"))
    return nodes.join(ids, (nodes["conv_id"] == ids["conv_id"]) & (nodes["parent"] == ids["up"]), "left").select(nodes["*"], "up")


def doubled(one: DataFrame, largest: int) -> list[DataFrame]:
    """Tables of jumps of 1, 2, 4, ... steps from ``one`` (conv_id, node_id, parent, jump, length, messages, top, low):
    length and messages count the nodes that a jump passes, low is the least id among these, top the last of them."""
    tables = [written(one)]
    reach = 1
    while reach < largest and tables[-1].where("jump is not null").limit(1).count():
        t = tables[-1]
        further = t.select("conv_id", F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("length").alias("length2"), F.col("messages").alias("messages2"), F.col("top").alias("top2"), F.col("low").alias("low2"))
        more = t.join(further, ["conv_id", "jump"], "left")
        own = {"length": F.col("length") + F.coalesce("length2", F.lit(0)), "messages": F.col("messages") + F.coalesce("messages2", F.lit(0)), "top": F.coalesce("top2", "top"), "low": F.least("low", "low2")}
        tables.append(written(more.select(*KEY, "parent", F.col("jump2").alias("jump"), *(c.alias(k) for k, c in own.items()))))
        reach *= 2
    return tables


class Chains:
    """Jump tables of a set of graphs, and what they say about every node."""

    def __init__(self, nodes: DataFrame, deep: int = DEEP):
        self.given, self.deep = nodes, deep
        self.largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0

    @cached_property
    def tables(self) -> list[DataFrame]:
        base = linked(self.given.select("conv_id", "node_id", "parent", F.coalesce("has_message", F.lit(False)).alias("has_message")))
        one = base.select(*KEY, "parent", F.col("up").alias("jump"), F.lit(1).cast("bigint").alias("length"), F.col("has_message").cast("bigint").alias("messages"), F.col("node_id").alias("top"), F.col("node_id").alias("low"))
        return doubled(one, self.largest)

    def steps(self, starts: DataFrame, extra: list[str]) -> DataFrame:
        """Every node on the walks from ``starts`` (conv_id, node_id, length and ``extra``), with distance d."""
        own = [*extra, "conv_id", "length"]
        path = written(starts.select(*own, "node_id", F.lit(0).cast("bigint").alias("d")))
        most = path.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
        for k, t in enumerate(self.tables):
            if 2**k >= most:
                break
            jumps = t.where("jump is not null").select("conv_id", "node_id", "jump")
            further = path.where(F.col("d") + 2**k < F.col("length")).join(jumps, KEY)
            path = written(path.unionByName(further.select(*own, F.col("jump").alias("node_id"), (F.col("d") + 2**k).alias("d"))))
        return path.drop("length")

    def nodes(self) -> DataFrame:
        """conv_id, node_id, parent, length and messages of the chain to the root, grounded (it ends at a node
        without parent).  Where a graph has more than ``deep`` nodes, rounds of all nodes would be many."""
        if self.largest > self.deep:
            return contraction.chains(self.given)
        last = self.tables[-1]
        parents = self.tables[0].select("conv_id", F.col("node_id").alias("top"), F.col("parent").alias("top_parent"))
        plain = last.where("jump is null").join(parents, ["conv_id", "top"]).select(*KEY, "parent", "length", "messages", F.col("top_parent").isNull().alias("grounded"))
        looping = last.where("jump is not null")
        if not looping.limit(1).count():
            return plain
        return plain.unionByName(self.looping(looping))

    def looping(self, last: DataFrame) -> DataFrame:
        """The same for nodes whose walk ends in a cycle; each node of it counts once.

        The last jumps are longer than any walk without repeats, so they end in cycles and reach each of their nodes;
        a cycle is named by its least node.  What hangs on a cycle adds to it by jumps of its own.
        """
        inside = written(last.select("conv_id", F.col("jump").alias("node_id")).distinct().join(last.select(*KEY, F.col("low").alias("cycle")), KEY))
        first = self.tables[0].join(last.select(*KEY), KEY, "left_semi")
        sizes = first.select(*KEY, "messages").join(inside, KEY).groupBy("conv_id", "cycle").agg(F.count("*").alias("size"), F.sum("messages").alias("held"))
        members = written(inside.join(sizes, ["conv_id", "cycle"]).select(*KEY, "size", "held"))
        within = self.tables[0].select(*KEY, "parent").join(members, KEY).select(*KEY, "parent", F.col("size").alias("length"), F.col("held").alias("messages"), F.lit(False).alias("grounded"))
        outside = first.join(members, KEY, "left_anti")
        entries = members.select("conv_id", F.col("node_id").alias("jump"), F.lit(True).alias("enters"))
        cut = outside.join(entries, ["conv_id", "jump"], "left").select(*KEY, "parent", F.when(F.col("enters").isNull(), F.col("jump")).alias("jump"), "length", "messages", "top", "low")
        tails = doubled(cut, self.largest)[-1]
        tops = self.tables[0].select("conv_id", F.col("node_id").alias("top"), F.col("parent").alias("entry"))
        hung = tails.join(tops, ["conv_id", "top"]).join(members.withColumnRenamed("node_id", "entry"), ["conv_id", "entry"])
        return within.unionByName(hung.select(*KEY, "parent", (F.col("length") + F.col("size")).alias("length"), (F.col("messages") + F.col("held")).alias("messages"), F.lit(False).alias("grounded")))


def deepest(chains: DataFrame) -> DataFrame:
    """The start of the longest chain of each conversation: more messages, then the smaller id, decide ties."""
    best = F.min(F.struct((-F.col("length")).alias("length"), (-F.col("messages")).alias("messages"), "node_id")).alias("b")
    return chains.groupBy("conv_id").agg(best).select("conv_id", "b.node_id", (-F.col("b.length")).alias("length"), (-F.col("b.messages")).alias("messages"))


class Branches:
    """meta: conv_id, status, strategy, warnings; path: conv_id, pos (from 0 at the root), node_id."""

    def __init__(self, meta: DataFrame, path: DataFrame, chains: DataFrame):
        self.meta, self.path, self.chains = meta, path, chains


def broken_parent(node: Column, parent: Column) -> Column:
    return F.format_string("node `%s` points at missing parent `%s`; treated `%s` as the root", node, parent, node)


class Strategy(Protocol):
    """How a branch is chosen: ``prefers_current`` says for a conversation whether its own pointer may end the branch;
    where it doesn't, or can't, the node that ``fallback`` gives for the conversation does."""

    name: str
    prefers_current: bool

    def fallback(self, chains: DataFrame) -> DataFrame:
        """conv_id, node_id, length and messages of one start for each conversation."""
        ...


@dataclass(frozen=True)
class LongestPath:
    name: str = "longest-path"
    prefers_current: bool = False

    def fallback(self, chains: DataFrame) -> DataFrame:
        return deepest(chains)


@dataclass(frozen=True)
class CurrentNode(LongestPath):
    name: str = "current-node"
    prefers_current: bool = True


#: By name; others can be added.
STRATEGIES: dict[str, Strategy] = {s.name: s for s in (CurrentNode(), LongestPath())}


def active_branch(conversations: DataFrame, nodes: DataFrame, strategy: str | Strategy = "current-node") -> Branches:
    """The branch that ends at ``current_node``, or the longest path where that can't be used.

    status is ok, empty_mapping or no_messages; the last two have no path.  ``strategy`` longest-path takes the longest
    path everywhere; an object of one's own (see :class:`Strategy`) does as well as a name.
    """
    if isinstance(strategy, str):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy: one of {', '.join(STRATEGIES)}")
        strategy = STRATEGIES[strategy]
    pointed = F.lit(strategy.prefers_current)
    walker = Chains(nodes)
    chains = written(walker.nodes())
    totals = nodes.groupBy("conv_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.coalesce("has_message", F.lit(False))).alias("n_messages"))
    current = F.when(pointed & (F.col("current_node") != ""), F.col("current_node"))
    conv = conversations.select("conv_id", current.alias("current")).join(totals, "conv_id", "left")
    at = chains.select("conv_id", F.col("node_id").alias("current"), F.lit(True).alias("found"), F.col("messages").alias("current_messages"), F.col("length").alias("current_length"))
    long = strategy.fallback(chains).select("conv_id", F.col("node_id").alias("longest"), F.col("messages").alias("longest_messages"), F.col("length").alias("longest_length"))
    conv = conv.join(at, ["conv_id", "current"], "left").join(long, "conv_id", "left")
    status = F.when(F.col("n_nodes").isNull(), "empty_mapping").when(F.col("n_messages") == 0, "no_messages").otherwise("ok")
    walked = F.col("found").isNotNull()
    used = walked & (F.col("current_messages") > 0)
    conv = written(conv.withColumn("status", status).withColumn("walked", walked).withColumn("used", used))

    ok = conv.where("status = 'ok'")
    starts = ok.where("walked").select("conv_id", F.lit("current").alias("kind"), F.col("current").alias("node_id"), F.col("current_length").alias("length"))
    starts = starts.unionByName(ok.where("not used").select("conv_id", F.lit("longest").alias("kind"), F.col("longest").alias("node_id"), F.col("longest_length").alias("length")))
    paths = walker.steps(starts, ["kind"])

    # what stopped each walk shows at its top
    top = paths.groupBy("conv_id", "kind").agg(F.max_by("node_id", "d").alias("node_id"))
    top = top.join(linked(nodes.select(*KEY, "parent")), KEY)
    stop = F.when(F.col("parent").isNull(), F.lit(None)).when(F.col("up").isNull(), broken_parent(F.col("node_id"), F.col("parent"))).otherwise(F.format_string("parent chain loops back to node `%s`; stopped the walk there", F.col("parent")))
    stops = top.select("conv_id", "kind", stop.alias("stop")).groupBy("conv_id").pivot("kind", ["current", "longest"]).agg(F.first("stop"))
    stops = stops.withColumnsRenamed({"current": "current_stop", "longest": "longest_stop"})

    guess = pointed & ~F.col("used")
    missing = F.when(guess & ~F.col("walked"), F.when(F.col("current").isNull(), F.lit("export has no `current_node`; guessed the active branch")).otherwise(F.format_string("`current_node` `%s` is not in the conversation mapping; guessed the active branch", F.col("current"))))
    bare = F.lit("the reconstructed branch carries no messages")
    partial = F.format_string("guessed branch recovered only %d of %d messages in the graph; the export's parent links look incomplete", F.col("longest_messages"), F.col("n_messages"))
    warnings = F.array(
        missing,
        F.col("current_stop"),
        F.when(guess & F.col("walked"), bare),
        F.when(guess, F.lit("fell back to the longest path in the conversation graph")),
        F.when(~F.col("used"), F.col("longest_stop")),
        F.when(~F.col("used") & (F.col("longest_messages") == 0), bare),
        F.when(guess & (F.col("longest_messages") * 2 < F.col("n_messages")), partial),
    )
    warnings = F.when(F.col("status") == "ok", F.filter(warnings, lambda w: w.isNotNull())).otherwise(F.array().cast("array<string>"))
    name = F.when(F.col("status") == "ok", F.when(F.col("used"), "current-node").otherwise("longest-path" if strategy.prefers_current else strategy.name))
    meta = conv.join(stops, "conv_id", "left").select("conv_id", "status", name.alias("strategy"), warnings.alias("warnings"))

    chosen = conv.where("status = 'ok'").select("conv_id", F.when(F.col("used"), "current").otherwise("longest").alias("kind"))
    path = paths.join(chosen, ["conv_id", "kind"])
    depth = F.max("d").over(Window.partitionBy("conv_id"))
    return Branches(meta, path.select("conv_id", (depth - F.col("d")).alias("pos"), "node_id"), chains)


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes without an existing parent: conv_id, node_id."""
    return linked(nodes.select(*KEY, "parent")).where("up is null").select(*KEY)


def children_counts(nodes: DataFrame) -> DataFrame:
    """Nodes that others name as parent, with how many: conv_id, node_id, children.  The children lists of an export
    play no part."""
    up = linked(nodes.select(*KEY, "parent")).where("up is not null")
    return up.groupBy("conv_id", F.col("up").alias("node_id")).agg(F.count("*").alias("children"))


def node_listing(nodes: DataFrame, branches: Branches) -> DataFrame:
    """Nodes with their place: those on the branch in its order, then the others by id.  Only keys are numbered."""
    keys = nodes.select(*KEY).join(branches.path, KEY, "left")
    ord_ = numbered(keys, ["conv_id"], [F.col("pos").asc_nulls_last(), F.col("node_id").asc()]).select(*KEY, "pos", (F.col("rn") - 1).alias("ord"))
    return nodes.join(ord_, KEY).withColumn("on_active_branch", F.col("pos").isNotNull())
