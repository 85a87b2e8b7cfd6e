import random

import pytest
from pyspark.sql import functions as F

from exports import expected_branch, walk
from threadloom.operators import contraction
from threadloom.operators import graph as G
from threadloom.operators.ordered import numbered
from threadloom.operators.stats import graph_stats

NODES = "conv_id string, node_id string, parent string, has_message boolean"


def tables(spark, graphs):
    conv = [(k, g[2]) for k, g in graphs.items()]
    nodes = [(k, n, p, g[1][n]) for k, g in graphs.items() for n, p in g[0].items()]
    return spark.createDataFrame(conv, "conv_id string, current_node string"), spark.createDataFrame(nodes, NODES)


def random_graphs(seed, count):
    r = random.Random(seed)
    out = {}
    for i in range(count):
        ids = [*"abcde", "ghost"] if i % 2 else [f"{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
        keys = r.sample(ids, r.randrange(0, 6) if i % 2 else r.randrange(8, 20))
        nodes = {k: r.choice([None, *ids, *ids]) for k in keys}
        out[f"g{i}"] = (nodes, {k: r.random() < 0.6 for k in keys}, r.choice([None, "", *ids]))
    return out


@pytest.fixture(scope="module")
def many(spark):
    graphs = random_graphs(11, 120)
    graphs["chain"] = ({f"n{i:03}": f"n{i - 1:03}" if i else None for i in range(150)}, {f"n{i:03}": True for i in range(150)}, "n149")
    conversations, nodes = tables(spark, graphs)
    return graphs, nodes, G.active_branch(conversations, nodes)


def test_branches_are_those_of_a_walk(many):
    graphs, _, branches = many
    meta = {r.conv_id: r for r in branches.meta.collect()}
    paths: dict = {}
    for r in branches.path.orderBy("conv_id", "pos").collect():
        paths.setdefault(r.conv_id, []).append(r.node_id)
    for k, (nodes, has, current) in graphs.items():
        status, strategy, path = expected_branch(nodes, has, current or None)
        assert (meta[k].status, meta[k].strategy, paths.get(k, [])) == (status, strategy, path), k
        assert len(set(path)) == len(path)


def test_chains(many):
    graphs, _, branches = many
    got = {(r.conv_id, r.node_id): (r.length, r.messages, r.grounded) for r in branches.chains.collect()}
    for k, (nodes, has, _) in graphs.items():
        for n in nodes:
            path, why = walk(nodes, n)
            assert got[k, n] == (len(path), sum(has[m] for m in path), why == "root")
    assert len(got) == sum(len(g[0]) for g in graphs.values())


@pytest.mark.parametrize("few", [0, 3, 200])
def test_chains_by_contraction(spark, many, few):
    """Trees, cycles, what hangs on them, nodes that point at themselves or at nothing."""
    graphs, nodes, _ = many
    got = [((r.conv_id, r.node_id), (r.parent, r.length, r.messages, r.grounded)) for r in contraction.chains(nodes, few).collect()]
    want = []
    for k, (g, has, _) in graphs.items():
        for n, parent in g.items():
            path, why = walk(g, n)
            want.append(((k, n), (parent, len(path), sum(has[m] for m in path), why == "root")))
    assert sorted(got, key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])


def test_large_cycle_by_contraction(spark):
    """A cycle of 300 with tails of 40 and 7, one of which ends in a fork."""
    g = {f"c{i}": f"c{(i + 1) % 300}" for i in range(300)} | {f"t{i}": f"t{i - 1}" if i else "c5" for i in range(40)} | {f"u{i}": f"u{i - 1}" if i else "t20" for i in range(7)} | {"me": "me", "on": "me"}
    has = {n: len(n) % 2 == 0 for n in g}
    _, nodes = tables(spark, {"c": (g, has, None)})
    got = {r.node_id: (r.length, r.messages, r.grounded) for r in contraction.chains(nodes, 5).collect()}
    assert got == {n: (len(p), sum(has[m] for m in p), False) for n in g for p in [walk(g, n)[0]]}


def test_rows_written_for_deep_graphs_grow_with_nodes(spark, monkeypatch):
    """Rounds that write all nodes would write 17 times a chain of 50,000, and once more each time it doubles."""
    rows = []
    for module in (G, contraction):
        plain = module.written
        monkeypatch.setattr(module, "written", lambda df, plain=plain: (out := plain(df), rows.append(out.count()))[0])
    n = 50_000
    at = F.col("id")
    chain = spark.range(n).select(F.lit("c").alias("conv_id"), at.cast("string").alias("node_id"), F.when(at > 0, at - 1).cast("string").alias("parent"), F.lit(True).alias("has_message"))
    assert G.Chains(chain).nodes().agg(F.max("length")).first()[0] == n
    assert sum(rows) < 9 * n


def test_stats_recomputed(many):
    graphs, nodes, branches = many
    got = {r.conv_id: r for r in graph_stats(nodes, branches).collect()}
    for k, (g, has, current) in graphs.items():
        if not g:
            assert k not in got
            continue
        path = expected_branch(g, has, current or None)[2]
        kids: dict = {}
        for p in g.values():
            if p in g:
                kids[p] = kids.get(p, 0) + 1
        r = got[k]
        assert r.total_nodes == len(g) and r.nodes_with_messages == sum(has.values())
        assert r.broken_parents == sum(p is not None and p not in g for p in g.values())
        assert (r.branch_points, r.alternative_branches) == (sum(c > 1 for c in kids.values()), sum(c - 1 for c in kids.values()))
        assert r.branch_depth == len(path)
        assert r.unreachable_nodes == sum(walk(g, n)[1] != "root" and n not in path for n in g)


@pytest.mark.parametrize(
    ("nodes", "current", "warnings"),
    [
        ({"a": None, "b": "a"}, "b", []),
        ({"a": None, "b": "a"}, None, ["export has no `current_node`; guessed the active branch", "fell back to the longest path in the conversation graph"]),
        ({"a": "x", "b": "a"}, "b", ["node `a` points at missing parent `x`; treated `a` as the root"]),
        ({"a": "b", "b": "a", "c": "b"}, "c", ["parent chain loops back to node `b`; stopped the walk there"]),
        ({"a": "a"}, "a", ["parent chain loops back to node `a`; stopped the walk there"]),
        (
            {"a": None, "b": "x", "c": "y", "d": "z", "e": "w"},
            "q",
            ["`current_node` `q` is not in the conversation mapping; guessed the active branch", "fell back to the longest path in the conversation graph", "guessed branch recovered only 1 of 5 messages in the graph; the export's parent links look incomplete"],
        ),
    ],
)
def test_warnings(spark, nodes, current, warnings):
    conversations, rows = tables(spark, {"c": (nodes, dict.fromkeys(nodes, True), current)})
    assert G.active_branch(conversations, rows).meta.first().warnings == warnings


def test_branch_without_messages_falls_back(spark):
    graphs = {"c": ({"a": None, "b": None, "d": "b"}, {"a": False, "b": True, "d": True}, "a")}
    meta = G.active_branch(*tables(spark, graphs)).meta.first()
    assert meta.strategy == "longest-path"
    assert meta.warnings == ["the reconstructed branch carries no messages", "fell back to the longest path in the conversation graph"]


def test_longest_path_everywhere(spark):
    graphs = {"c": ({"a": None, "b": "a", "d": None}, dict.fromkeys("abd", True), "d")}
    branches = G.active_branch(*tables(spark, graphs), strategy="longest-path")
    assert [r.node_id for r in branches.path.orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="strategy"):
        G.active_branch(*tables(spark, graphs), strategy="guess")


def test_deep_chains_and_large_cycles(spark):
    """A chain of 100,000 nodes and a cycle of 10,000 with a tail of 50: rounds, not nodes, make the plan."""
    at = F.col("id")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    chain = spark.range(100_000).select(F.lit("chain").alias("conv_id"), name(at).alias("node_id"), F.when(at > 0, name(at - 1)).alias("parent"), (at % 2 == 0).alias("has_message"))
    cycle = spark.range(10_050).select(F.lit("cycle").alias("conv_id"), name(at).alias("node_id"), name(F.when(at < 10_000, (at + 1) % 10_000).otherwise(at - 1)).alias("parent"), F.lit(True).alias("has_message"))
    nodes = chain.unionByName(cycle)
    walker = G.Chains(nodes)
    assert walker.tables[-1]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    chains = walker.nodes()
    assert chains._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    got = {r.node_id: tuple(r)[3:] for r in chains.where("conv_id = 'chain' and node_id in ('n0', 'n7', 'n99999')").collect()}
    assert got == {"n0": (1, 1, True), "n7": (8, 4, True), "n99999": (100_000, 50_000, True)}
    lengths = chains.where("conv_id = 'cycle'").groupBy("length", "grounded").count().collect()
    assert sorted(map(tuple, lengths)) == [(10_000, False, 10_000), *((10_000 + k, False, 1) for k in range(1, 51))]
    conversations = spark.createDataFrame([("chain", "n99999"), ("cycle", "n5")], "conv_id string, current_node string")
    branches = G.active_branch(conversations, nodes)
    assert branches.path.groupBy("conv_id").agg(F.count("*"), F.count_distinct("node_id"), F.max("pos")).orderBy("conv_id").collect() == [("chain", 100_000, 100_000, 99_999), ("cycle", 10_000, 10_000, 9_999)]
    assert branches.meta.where("conv_id = 'cycle'").first().warnings == ["parent chain loops back to node `n5`; stopped the walk there"]


@pytest.mark.parametrize("one_task", [10**9, 10])
def test_numbers_and_totals_in_groups_of_any_size(spark, one_task):
    r = random.Random(3)
    rows = [("hot" if k % 3 else f"g{k % 40}", k, r.choice([None, *range(5)]), r.randrange(9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, o int, v int").repartition(5)
    got = numbered(df, ["g"], [F.col("o").asc_nulls_last(), F.col("id").desc()], one_task=one_task, total=F.col("v"))
    want, groups = [], {}
    for g, k, o, v in sorted(rows, key=lambda x: (x[0], x[2] is None, x[2] or 0, -x[1])):
        rn, total = groups.get(g, (0, 0))
        groups[g] = (rn + 1, total + v)
        want.append((g, k, rn + 1, total + v))
    assert sorted((x.g, x.id, x.rn, x.total) for x in got.collect()) == sorted(want)
    assert all(x.n == groups[x.g][0] for x in got.collect())


def test_a_strategy_of_ones_own(spark):
    class First(G.LongestPath):
        def fallback(self, chains):
            return chains.groupBy("conv_id").agg(F.min_by(F.struct("node_id", "length", "messages"), "node_id").alias("b")).select("conv_id", "b.*")

    graphs = {"c": ({"a": None, "b": "a", "d": "b"}, dict.fromkeys("abd", True), None)}
    branches = G.active_branch(*tables(spark, graphs), strategy=First(name="first"))
    assert [r.node_id for r in branches.path.collect()] == ["a"] and branches.meta.first().strategy == "first"


def test_roots_children_and_listing(spark):
    graphs = {"c": ({"a": None, "b": "a", "d": "a", "e": "gone"}, dict.fromkeys("abde", True), "d")}
    conversations, nodes = tables(spark, graphs)
    assert sorted(r.node_id for r in G.roots(nodes).collect()) == ["a", "e"]
    assert [tuple(r) for r in G.children_counts(nodes).collect()] == [("c", "a", 2)]
    listed = G.node_listing(nodes, G.active_branch(conversations, nodes)).orderBy("ord").collect()
    assert [(r.node_id, r.on_active_branch) for r in listed] == [("a", True), ("d", True), ("b", False), ("e", False)]


def test_empty_tables(spark):
    conversations, nodes = spark.createDataFrame([], "conv_id string, current_node string"), spark.createDataFrame([], NODES)
    branches = G.active_branch(conversations, nodes)
    assert branches.meta.count() == branches.path.count() == 0
    assert graph_stats(nodes, branches).select(F.count("*")).first()[0] == 0
