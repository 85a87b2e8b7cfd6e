"""Commands over one export: list, find, show, transcript, extract, prompt, inspect.

Each works on the same tables as the batch functions, narrowed to the conversation that a selector names.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import errors as E
from threadloom.functions import content as C
from threadloom.functions import text as T
from threadloom.operators import graph as G
from threadloom.operators.messages import Options, visible_messages
from threadloom.operators.search import SearchOptions, list_conversations, search
from threadloom.operators.selection import Selector, quoted, resolve_unique
from threadloom.operators.stats import conversation_stats
from threadloom.plans import packages as P
from threadloom.plans.transcript import transcripts
from threadloom.session import checkpointed
from threadloom.sources.export import MAX_UNPACKED, ExportSet, raw_conversation, read_export
from threadloom.sources.sink import Writer, write_atomic



def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--local-time", action="store_true")
    p.add_argument("--max-unpacked-bytes", type=int, default=MAX_UNPACKED)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *, selector: bool = True, roles: bool = False, output: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        if selector:
            c.add_argument("query", nargs="?")
            c.add_argument("--conversation")
            c.add_argument("--title")
        if roles:
            for role in ("system", "tools", "developer", "hidden"):
                c.add_argument(f"--include-{role}", action="store_true")
        if output:
            c.add_argument("--output")
            c.add_argument("--force", action="store_true")
        return c

    c = command("list", selector=False)
    c.add_argument("--sort", choices=("updated", "created", "title"), default="updated")
    c.add_argument("--reverse", action="store_true")
    c.add_argument("--limit", type=int)
    c.add_argument("--json", action="store_true")
    c = command("find", selector=False)
    c.add_argument("query")
    c.add_argument("--content", action="store_true")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--json", action="store_true")
    command("show").add_argument("--json", action="store_true")
    command("transcript", roles=True, output=True)
    c = command("extract", roles=True)
    c.add_argument("-o", "--output", default="./handoff")
    c.add_argument("--context-mode", choices=("deterministic", "prompt"), default="deterministic")
    c.add_argument("--recent-messages", type=int, default=30)
    c.add_argument("--recent-chars", type=int)
    c.add_argument("--raw", action="store_true")
    c.add_argument("--force", action="store_true")
    c.add_argument("--json", action="store_true")
    command("prompt", roles=True, output=True).add_argument("--recent-messages", type=int, default=30)
    c = command("inspect")
    c.add_argument("--nodes", action="store_true")
    c.add_argument("--json", action="store_true")
    return p


def print_json(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


class One:
    """A conversation of an export and its branch."""

    def __init__(self, found: ExportSet, args: argparse.Namespace):
        selector = Selector(args.query, args.conversation, args.title)
        if selector.is_empty():
            raise E.NoSelector
        self.id = resolve_unique(found.conversations, selector)
        own = F.col("conv_id") == self.id
        self.conversations, self.nodes = checkpointed(found.conversations.where(own)), checkpointed(found.nodes.where(own))
        self.branches = G.active_branch(self.conversations, self.nodes)
        self.meta = self.branches.meta.collect()[0]
        if self.meta.status != "ok":
            raise E.GraphError(self.id, self.meta.status)
        for w in self.meta.warnings:
            print(f"warning: {w}", file=sys.stderr)

    def row(self, df: DataFrame) -> dict:
        return df.collect()[0].asDict(recursive=True)

    def shown(self) -> dict:
        return self.row(self.conversations.select("title", "current_node", C.display_title(F.col("title")).alias("display_title"), C.display_id(F.col("conv_id")).alias("display_id")))

    def record(self) -> dict:
        return self.row(P.show_records(self.conversations, self.nodes, self.branches))


def options(args: argparse.Namespace) -> Options:
    return Options(args.include_system, args.include_tools, args.include_developer, args.include_hidden, getattr(args, "recent_messages", 30), getattr(args, "recent_chars", None))


def run_list(found: ExportSet, args: argparse.Namespace) -> None:
    sizes = found.nodes.groupBy("conv_id").agg(F.count("*").alias("total_nodes"))
    # joined before the sort, which has the last word on order
    rows = list_conversations(found.conversations.join(sizes, "conv_id", "left").na.fill(0, ["total_nodes"]), args.sort, args.reverse, args.limit)
    if args.json:
        picked = rows.select(F.col("conv_id").alias("id"), "title", T.format_time(F.col("create_time")).alias("created_at"), T.format_time(F.col("update_time")).alias("updated_at"), "total_nodes")
        print_json({"source": found.source, "conversations": [r.asDict() for r in picked.collect()]})
        return
    lines = rows.select(F.format_string("%-36s  %-16s  %s", C.display_id(F.col("conv_id")), T.format_time(F.col("update_time"), short=True), C.display_title(F.col("title"))).alias("line")).collect()
    if not lines:
        print(f"No conversations found in {found.source}.")
        return
    print(f"{'ID':<36}  {'UPDATED':<16}  TITLE")
    for r in lines:
        print(r.line)
    print(f"\n{len(lines)} conversation(s).")


def run_find(found: ExportSet, args: argparse.Namespace) -> None:
    hits = search(found.conversations, found.nodes, args.query, SearchOptions(args.limit, args.content))
    if args.json:
        rows = hits.orderBy("rank").select(F.col("conv_id").alias("id"), "title", "score", F.col("field").alias("matched"), "excerpt").collect()
        print_json({"query": args.query, "matches": [r.asDict() for r in rows]})
        return
    rows = hits.orderBy("rank").select("score", T.truncate_graphemes(C.display_id(F.col("conv_id")), 8).alias("id"), C.display_title(F.col("title")).alias("title"), T.sanitize_display(F.col("excerpt")).alias("excerpt")).collect()
    if not rows:
        print(f"No conversation matches {quoted(args.query)}.")
    for r in rows:
        print(f"{r.score:>3}  {r.id}  {r.title}")
        if r.excerpt is not None:
            print(f"     {r.excerpt}")


def run_show(one: One, args: argparse.Namespace) -> None:
    r = one.record()
    if args.json:
        print_json(r)
        return
    other = sum(r[k] for k in ("system_messages", "developer_messages", "tool_messages", "other_messages"))
    shown = one.shown()
    lines = [
        ("Title", shown["display_title"]), ("Conversation ID", shown["display_id"]), ("Created", r["created_at"]), ("Updated", r["updated_at"]), ("Branch strategy", r["branch_strategy"]), None,
        ("Active-branch messages", r["active_branch_messages"]), ("Total graph nodes", r["total_nodes"]), ("User messages", r["user_messages"]), ("Assistant messages", r["assistant_messages"]),
        *([("Other messages", f"{other} (system {r['system_messages']}, developer {r['developer_messages']}, tool {r['tool_messages']}, other {r['other_messages']})")] if other else []),
        ("Approx. characters", r["characters"]), ("Approx. words", r["words"]), ("Branch depth", r["branch_depth"]), ("Alternative branches", f"{r['alternative_branches']} (at {r['branch_points']} branch point(s))"),
        *([("Graph damage", f"{r['broken_parents']} broken parent(s), {r['unreachable_nodes']} unreachable node(s)")] if r["broken_parents"] or r["unreachable_nodes"] else []),
    ]
    for line in lines:
        print("" if line is None else f"{line[0] + ':':<24}{line[1]}")


def deliver(text: str, args: argparse.Namespace) -> None:
    if args.output is None:
        print(text, end="")
    else:
        write_atomic(Path(args.output), text, args.force)
        print(f"Wrote {args.output}", file=sys.stderr)


def run_transcript(one: One, args: argparse.Namespace) -> None:
    deliver(one.row(transcripts(one.conversations, visible_messages(one.nodes, one.branches, options(args))))["transcript"], args)


def run_prompt(one: One, args: argparse.Namespace) -> None:
    deliver(one.row(P.prompts(one.conversations, visible_messages(one.nodes, one.branches, options(args))))["prompt"], args)


def run_extract(one: One, args: argparse.Namespace, found: ExportSet) -> None:
    files = P.packages(one.conversations, one.nodes, options(args), args.context_mode, found.source).select("filename", "contents").collect()
    writer = Writer(args.output, args.force)
    for f in files:
        writer.stage(f.filename, f.contents)
    if args.raw and (raw := raw_conversation(found.scanned, one.id)) is not None:
        writer.stage("raw-conversation.json", json.dumps(json.loads(raw), ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    written = writer.commit()
    meta = json.loads(next(f.contents for f in files if f.filename == "metadata.json"))
    if args.json:
        print_json({"output_dir": args.output, "files": [str(w) for w in written], "metadata": meta})
        return
    print("Created handoff package:\n")
    for w in written:
        print(f"  {w}")
    print(f"\nConversation:\n  {one.shown()['display_title']}\n\nActive branch:\n  {meta['active_branch_messages']} messages\n\nRecent context preserved:\n  {meta['recent_messages_preserved']} messages")


def run_inspect(one: One, args: argparse.Namespace) -> None:
    stats = one.row(conversation_stats(one.nodes, one.branches).drop("conv_id"))
    path = [r.node_id for r in one.branches.path.orderBy("pos").collect()]
    roots = [r.node_id for r in G.roots(one.nodes).orderBy("node_id").collect()]
    shown = one.shown()
    nodes = []
    if args.nodes:
        listed = G.node_listing(one.nodes, one.branches).orderBy("ord")
        size = F.coalesce(T.grapheme_count(F.col("plain_text")), F.lit(0))
        nodes = [r.asDict() for r in listed.select(F.col("node_id").alias("id"), "role", "has_message", "parent", F.col("n_children").alias("children"), size.alias("characters"), "on_active_branch").collect()]
    if args.json:
        out = {"conversation_id": one.id, "title": shown["title"], "current_node": shown["current_node"], "roots": roots, "branch_strategy": one.meta.strategy, "branch_node_ids": path, "warnings": one.meta.warnings, "stats": stats}
        if args.nodes:
            out["nodes"] = [{k: v for k, v in n.items() if k != "has_message"} | {"role": n["role"] if n["has_message"] else "(no message)"} for n in nodes]
        print_json(out)
        return
    print(f"Conversation ID: {shown['display_id']}\nTitle:           {shown['display_title']}\ncurrent_node:    {shown['current_node'] or '(absent)'}\nRoots:           {', '.join(roots)}\nBranch strategy: {one.meta.strategy}")
    print(f"Branch nodes:    {len(path)} of {stats['total_nodes']} total\nBranch points:   {stats['branch_points']} ({stats['alternative_branches']} alternative branch(es))\nDamage:          {stats['broken_parents']} broken parent(s), {stats['unreachable_nodes']} unreachable node(s)")
    print("Warnings:" if one.meta.warnings else "Warnings:        none")
    for w in one.meta.warnings:
        print(f"  - {w}")
    if args.nodes:
        print(f"\n{'NODE':<38} {'ROLE':<12} {'CHILD':>6} {'CHARS':>8}  ON BRANCH")
        for n in nodes:
            print(f"{n['id']:<38} {n['role'] if n['has_message'] else '-':<12} {n['children']:>6} {n['characters']:>8}  {'yes' if n['on_active_branch'] else ''}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("threadloom").getOrCreate()
    T.LOCAL_TIMES.set(args.local_time)
    spark.sparkContext.setLogLevel({0: "ERROR", 1: "INFO"}.get(args.verbose, "DEBUG"))
    try:
        found = read_export(spark, args.input, args.max_unpacked_bytes)
        for r in found.warnings.orderBy("path", "ord").collect():
            print(f"warning: {r.warning}", file=sys.stderr)
        if args.command == "list":
            run_list(found, args)
        elif args.command == "find":
            run_find(found, args)
        elif args.command == "extract":
            run_extract(One(found, args), args, found)
        else:
            {"show": run_show, "transcript": run_transcript, "prompt": run_prompt, "inspect": run_inspect}[args.command](One(found, args), args)
    except (E.ExportError, E.SelectError, E.GraphError, E.OutputExists) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
