"""Chains of very deep graphs by contraction, with work in proportion to the nodes whatever their depth.

Nodes are numbered; edges are rows (v, up, length, messages, end): length and messages count the nodes from v up to, but
without, ``up``.  A top has no ``up``; its ``end`` says what it is: GROUNDED, BROKEN, or the head of a cycle, which is a
node of it.  Each round takes out about a quarter of what is left: nodes on heads whose parent is on tails, or missing,
by coins that both can see.  So no two neighbours go at once, and their children are tied to what lies above them.  A
cycle shrinks to a node that points at itself.  What remains of a few thousand rows is walked in the driver, and rounds
are gone through backwards: a node that went takes the result of the node above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import discard, written

GROUNDED, BROKEN = -1, -2
FEW = 20_000  # rows that the driver walks
EDGE = "v bigint, up bigint, length bigint, messages bigint, end bigint"
RESULT = "v bigint, length bigint, messages bigint, end bigint"
RING = "v bigint, ring bigint, size bigint, held bigint"


def heads(x: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(k)), F.lit(2)) == 1


def goes(k: int) -> Column:
    return heads(F.col("v"), k) & (F.col("up").isNull() | ~heads(F.col("up"), k))


def shrunk(level: DataFrame, k: int) -> DataFrame:
    """What a round leaves, with ``over``: the node that v's edge now passes over, if it does."""
    level = level.select("v", "up", "length", "messages", "end")
    out = level.where(goes(k)).select(F.col("v").alias("up"), F.col("v").alias("over"), F.col("up").alias("up2"), F.col("length").alias("length2"), F.col("messages").alias("messages2"), F.col("end").alias("end2"))
    stay = level.where(~goes(k))
    below = F.col("up").isNotNull() & heads(F.col("up"), k)
    tied, closed = F.col("over").isNotNull(), F.col("up2") == F.col("v")
    near = stay.where(below).join(out, "up", "left").select(
        "v", F.when(~tied, F.col("up")).when(closed, F.lit(None)).otherwise(F.col("up2")).alias("up"),
        *((F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in ("length", "messages")),
        F.when(closed, F.col("v")).otherwise(F.col("end2")).alias("end"), "over",
    )
    return written(near.unionByName(stay.where(~below).withColumn("over", F.lit(None).cast("bigint"))))


def walked(rows: list) -> tuple[list[tuple], list[tuple]]:
    """Results of a few edges, and the nodes of cycles among them."""
    edges, done, rings = {r.v: r for r in rows}, {}, []
    for start in edges:
        path, on, at = [], set(), start
        while at not in done and at not in on and edges[at].up is not None:
            path.append(at)
            on.add(at)
            at = edges[at].up
        if at in on:
            cycle = path[path.index(at) :]
            size, held = (sum(edges[v][c] for v in cycle) for c in ("length", "messages"))
            rings += [(v, min(cycle), size, held) for v in cycle]
            done |= {v: (size, held, min(cycle)) for v in cycle}
            path = path[: path.index(at)]
        elif at not in done:
            done[at] = (edges[at].length, edges[at].messages, edges[at].end)
        for v in reversed(path):
            length, messages, end = done[edges[v].up]
            done[v] = (length + edges[v].length, messages + edges[v].messages, end)
    return [(v, *d) for v, d in done.items()], rings


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def ranked(edges: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None]:
    """v, length, messages and end of every node; and the nodes of cycles (v, ring, size, held), if there are any.  Of
    what hangs on a cycle, length and messages may hold a part of it."""
    spark = edges.sparkSession
    levels, left = [written(edges.withColumn("over", F.lit(None).cast("bigint")))], []
    left.append(levels[0].count())
    while left[-1] > few:
        levels.append(shrunk(levels[-1], len(levels)))
        left.append(levels[-1].count())
    rows, cycles = walked(levels[-1].collect())
    results = [written(spark.createDataFrame(rows, RESULT))]
    for k in range(len(levels) - 1, 0, -1):
        gone = levels[k - 1].where(goes(k))
        above = union(results).where(~heads(F.col("v"), k)).select(F.col("v").alias("up"), F.col("length").alias("length2"), F.col("messages").alias("messages2"), F.col("end").alias("end2"))
        found = gone.where("up is not null").join(above, "up").select("v", (F.col("length") + F.col("length2")).alias("length"), (F.col("messages") + F.col("messages2")).alias("messages"), F.col("end2").alias("end"))
        found = found.unionByName(gone.where("up is null").select("v", "length", "messages", "end"))
        if left[k - 1] * 16 < left[0]:  # small tables become one
            before, results = results, [written(union([found, *results]))]
            discard(*before)
        else:
            results.append(written(found))

    # each round's cycles have the nodes of the next one's and what their edges pass over there
    closed = union([t.where((F.col("end") == F.col("v")) & (F.col("over").isNotNull() if k else F.lit(True))) for k, t in enumerate(levels)])
    rings = written(closed.select("v", F.col("v").alias("ring"), F.col("length").alias("size"), F.col("messages").alias("held")).unionByName(spark.createDataFrame(cycles, RING)))
    if rings.limit(1).count():
        for t in reversed(levels[1:]):
            passed = t.where("over is not null").select("v", "over").join(rings, "v").select(F.col("over").alias("v"), "ring", "size", "held")
            before, rings = rings, written(rings.unionByName(passed))
            discard(before)
    else:
        rings = None
    discard(*levels)
    return union(results), rings


def chains(nodes: DataFrame, few: int = FEW) -> DataFrame:
    """conv_id, node_id, parent, length and messages of the chain to the root, grounded, as Chains.nodes gives them, of
    nodes (conv_id, node_id, parent, has_message)."""
    named = written(nodes.select("conv_id", "node_id", "parent", F.coalesce("has_message", F.lit(False)).cast("bigint").alias("messages")).withColumn("v", F.monotonically_increasing_id()))
    ids = named.select("conv_id", F.col("node_id").alias("parent"), F.col("v").alias("up"))
    linked = named.where("parent is not null").select("v", "conv_id", "parent", "messages").join(ids, ["conv_id", "parent"], "left")
    itself = F.col("up") == F.col("v")
    below = linked.select("v", F.when(~itself, F.col("up")).alias("up"), F.lit(1).cast("bigint").alias("length"), "messages", F.when(itself, F.col("v")).when(F.col("up").isNull(), F.lit(BROKEN).cast("bigint")).alias("end"))
    tops = named.where("parent is null").select("v", F.lit(None).cast("bigint").alias("up"), F.lit(1).cast("bigint").alias("length"), "messages", F.lit(GROUNDED).cast("bigint").alias("end"))
    edges = written(below.unionByName(tops))
    found, rings = ranked(edges, few)
    out = found.where("end < 0").select("v", "length", "messages", (F.col("end") == GROUNDED).alias("grounded"))
    if rings is not None:
        inside = rings.select("v", F.col("size").alias("length"), F.col("held").alias("messages"), F.lit(False).alias("grounded"))
        out = out.unionByName(inside)
        if found.where("end >= 0").count() > rings.count():  # what hangs on cycles is counted up to them, and they are added
            hung = edges.join(found.where("end >= 0").select("v"), "v", "left_semi").join(rings.select("v"), "v", "left_anti")
            entries = rings.select(F.col("v").alias("up"), "ring")
            hung = hung.drop("end").join(entries, "up", "left").select("v", F.when(F.col("ring").isNull(), F.col("up")).alias("up"), "length", "messages", F.col("ring").alias("end"))
            each = rings.select(F.col("ring").alias("end"), "size", "held").distinct()
            tails = ranked(hung, few)[0].join(each, "end")
            out = out.unionByName(tails.select("v", F.col("length") + F.col("size"), F.col("messages") + F.col("held"), F.lit(False)).toDF("v", "length", "messages", "grounded"))
    discard(edges)
    return named.drop("messages").join(out, "v").select("conv_id", "node_id", "parent", "length", "messages", "grounded")
