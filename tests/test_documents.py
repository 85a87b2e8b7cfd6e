import json

import pytest
from pyspark.sql import functions as F

from exports import archive, text, thread
from threadloom import cli
from threadloom import errors as E
from threadloom.functions import fixed as X
from threadloom.operators.graph import active_branch
from threadloom.operators.messages import Options, recent_selection, visible_messages
from threadloom.operators.search import SearchOptions, raw_score, search
from threadloom.operators.selection import Selector, resolve, resolve_unique
from threadloom.plans import sections as D
from threadloom.plans.packages import packages
from threadloom.plans.transcript import transcripts
from threadloom.session import checkpointed
from threadloom.sources.export import read_export
from threadloom.sources.sink import Writer

TALK = thread(
    "conv-0001",
    text("system", "hidden rules"),
    text("user", "Please build the parser for me. I prefer small modules and you must never skip tests. What about `Foo Bar`?"),
    text("assistant", "We decided to use SQLite. Therefore the store is local."),
    text("user", "The data set has forty thousand rows of orders and grows daily. We tried Redis but it didn't work. Please ask Ada Lovelace about it."),
    {"author": {"role": "assistant"}, "content": {"content_type": "code", "language": "python", "text": "import os"}},
    text("assistant", "# Plan\n$ git commit -m x\nsee src/main.py and https://example.com/a. Version v1.2.3 works.\n```\n# kept\n```"),
    text("tool", "noise"),
    text("user", "If it won't work, tell me. Which file is next? Is orders ready?", metadata={"is_visually_hidden_from_conversation": False}),
    title="Parser work",
)
OTHER = [thread(f"conv-{i:04}", text("user", f"hello {i}"), title=t, update=float(i)) for i, t in ((2, "Meeting notes 2026-03-01"), (3, "Meeting notes 2026-03-02"), (4, None))]


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("export") / "export.zip"
    path.write_bytes(archive({"conversations.json": [TALK, *OTHER]}))
    return str(path)


@pytest.fixture(scope="module")
def found(spark, export):
    f = read_export(spark, export)
    f.conversations, f.nodes = checkpointed(f.conversations), checkpointed(f.nodes)
    return f


@pytest.fixture(scope="module")
def branches(found):
    return active_branch(found.conversations, found.nodes)


@pytest.fixture(scope="module")
def bodies(found, branches):
    v = checkpointed(visible_messages(found.nodes, branches))
    rows = D.context_sections(found.conversations, v, Options(recent_messages=2)).where("conv_id = 'conv-0001'").collect()
    assert [r.heading for r in sorted(rows, key=lambda r: r.ord)] == list(X.SECTIONS)
    return {r.heading: r.body for r in rows}


def test_list_sections(bodies):
    assert bodies["Purpose"].startswith("Please build the parser for me.")
    assert bodies["User Preferences and Constraints"] == "- I prefer small modules and you must never skip tests."
    assert bodies["Decisions Already Made"] == "- We decided to use SQLite."
    assert bodies["Key Conclusions"] == "- Therefore the store is local."
    assert bodies["Rejected / Superseded Approaches"] == "- We tried Redis but it didn't work."
    assert bodies["Established Facts"] .splitlines() == [
        "- Please build the parser for me.",  # 31 clusters, six words, no cue
        "- The data set has forty thousand rows of orders and grows daily.",
        "- We tried Redis but it didn't work.",
        "- Please ask Ada Lovelace about it.",
    ]
    assert bodies["Open Questions"] == "- Which file is next?\n- Is orders ready?\n- What about `Foo Bar`?"


def test_terms_and_details(bodies):
    assert "- **Quoted terms:** `Foo Bar`" in bodies["Terminology and Entities"]
    assert "- **Named entities:** Foo Bar, Ada Lovelace" in bodies["Terminology and Entities"]
    assert bodies["Important Technical Details"] == "- **Code languages:** python\n- **Files and paths:** src/main.py\n- **Commands:** git commit -m x\n- **Links:** https://example.com/a\n- **Versions:** v1.2.3"


def test_tail_and_digest(bodies):
    assert bodies["Recent Conversation"].startswith("_Preserved verbatim: the last 2 of 6 message(s) on the active branch (")
    assert "\n### Plan\n" in bodies["Recent Conversation"] and "\n# kept\n" in bodies["Recent Conversation"] and "### User" in bodies["Recent Conversation"]
    assert "**Earlier conversation digest** (the 4 message(s) before the verbatim tail):\n\n- **User:** Please" in bodies["Important Background"]
    assert bodies["Current State"].count("\n") == 4 and "- **Assistant:** import os" in bodies["Current State"]
    assert "- **Messages on the active branch:** 6\n" in bodies["Conversation"]


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("if it won't work tell me", False), ("if we tried it and it won't fit", True), ("when it didn't work we left", True), ("it won't fit", True),
        ("we moved to b instead of a", True), ("use a rather than b", False), ("כשזה לא עבד", True), ("fine", False),
    ],
)
def test_rejection_rule(spark, sentence, expected):
    assert spark.range(1).select(D.is_rejection(F.lit(sentence))).first()[0] is expected


def test_tail_budgets(spark):
    sizes = [5, 50, 7, 3]
    v = spark.createDataFrame([("c", i, len(sizes), s) for i, s in enumerate(sizes)], "conv_id string, idx int, n long, size int")
    got = lambda *a: tuple(recent_selection(v, *a).first())[1:]
    assert got(30) == (0, 4, 65) and got(2) == (2, 2, 10) and got(0) == (4, 0, 0)
    assert got(30, 10) == (2, 2, 10) and got(30, 1) == (3, 1, 3) and got(30, 59) == (2, 2, 10) and got(30, 60) == (1, 3, 60)


def test_order_preserving_dedup(spark):
    rows = spark.createDataFrame([("c", i, t, t.lower()) for i, t in enumerate(["B", " ", "a", "b", "A", "c"])], "conv_id string, o int, text string, key string")
    kept = D.dedup_capped(rows, ["conv_id"], ["o"], 2).orderBy("place").collect()
    assert [r.text for r in kept] == ["B", "a"]


def test_transcript(found, branches):
    v = visible_messages(found.nodes, branches, Options(include_tools=True, include_system=True))
    rows = {r.conv_id: r.transcript for r in transcripts(found.conversations, v).collect()}
    assert rows["conv-0002"] == "# Meeting notes 2026-03-01\n\nConversation ID: conv-0002\nCreated: 2025-09-05T11:16:40Z\nUpdated: 1970-01-01T00:00:02Z\n\n---\n\n## User\n\nhello 2\n"
    assert "## System\n\nhidden rules\n" in rows["conv-0001"] and "## Tool\n\nnoise\n" in rows["conv-0001"] and "```python\nimport os\n```" in rows["conv-0001"]


def test_selection(found):
    c = found.conversations
    assert resolve_unique(c, Selector(id="conv-0003")) == resolve_unique(c, Selector(query="conv-0003")) == "conv-0003"
    assert resolve_unique(c, Selector(query="parser WORK")) == "conv-0001"
    assert resolve_unique(c, Selector(title="(untitled)")) == "conv-0004"
    assert [r[0] for r in resolve(c, Selector(title="meeting notes"))] == ["conv-0003", "conv-0002"]
    with pytest.raises(E.Ambiguous, match=r'title "meeting notes" is ambiguous; 2 candidates matched:\n  +100  conv-0003  Meeting'):
        resolve_unique(c, Selector(title="meeting notes"))
    with pytest.raises(E.NotFound, match='conversation id "conv-00" '.strip()):
        resolve(c, Selector(id="conv-00"))
    with pytest.raises(E.NoSelector):
        resolve(c, Selector())
    with pytest.raises(E.EmptyExport):
        resolve(c.limit(0), Selector(query="x"))


def test_search(found):
    hits = search(found.conversations, found.nodes, " meeting ").collect()
    assert [(h.conv_id, h.field) for h in hits] == [("conv-0003", "title"), ("conv-0002", "title")] and hits[0].score >= 80
    assert [(h.conv_id, h.score, h.field) for h in search(found.conversations, found.nodes, "CONV-0002", SearchOptions(limit=1)).collect()] == [("conv-0002", 100, "id")]
    inside = search(found.conversations, found.nodes, "forty thousand rows", SearchOptions(search_content=True)).collect()
    assert inside[0].field == "content" and inside[0].excerpt.startswith("The data set")
    assert search(found.conversations, found.nodes, "  ").count() == 0 and search(found.conversations, found.nodes, "zzqq").count() == 0


def test_scores():
    assert raw_score("abc", "abd") is None and raw_score("", "a") is None
    assert raw_score("Café", "cafe") == raw_score("cafe", "cafe")
    assert raw_score("foo bar", "bar") > raw_score("foobar", "bar") > raw_score("xbxaxr", "bar")


def test_packages(spark, found, tmp_path):
    rows = packages(found.conversations, found.nodes, Options(), "prompt", found.source).where("conv_id = 'conv-0001'").collect()
    files = {r.filename: r.contents for r in rows}
    assert set(files) == {"context.md", "transcript.md", "metadata.json", "summarization-prompt.md"}
    meta = json.loads(files["metadata.json"])
    assert len(meta) == 17 and list(meta) == sorted(meta) and meta["active_branch_messages"] == 8 and meta["context_mode"] == "prompt" and meta["warnings"] == []
    assert files["context.md"].startswith("# Conversation Handoff\n\n## Conversation\n\n- **Title:** Parser work\n") and X.PROMPT_MODE_NOTE in files["context.md"]
    assert "- Size: 6 messages, roughly " in files["summarization-prompt.md"] and "{" not in files["summarization-prompt.md"]
    writer = Writer(tmp_path / "out")
    for name, contents in files.items():
        writer.stage(name, contents)
    assert len(writer.commit()) == 4
    with pytest.raises(E.OutputExists):
        writer.commit()


def test_commands(spark, export, tmp_path, capsys):
    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr()

    code, out = run("list", export, "--limit", "2")
    assert code == 0 and out.out.splitlines()[0].startswith("ID ") and "conv-0001" in out.out.splitlines()[1] and out.out.endswith("2 conversation(s).\n")
    code, out = run("show", export, "--conversation", "conv-0001", "--json")
    assert json.loads(out.out)["user_messages"] == 3
    code, out = run("find", export, "meeting")
    assert code == 0 and "conv-000" in out.out
    code, out = run("transcript", export, "Parser work")
    assert out.out.startswith("# Parser work\n")
    code, out = run("inspect", export, "Parser work", "--nodes")
    assert "Roots:           root" in out.out and "ON BRANCH" in out.out
    code, out = run("extract", export, "Parser work", "-o", str(tmp_path / "h"), "--raw")
    assert code == 0 and (tmp_path / "h" / "raw-conversation.json").exists() and "Created handoff package:" in out.out
    code, out = run("extract", export, "Parser work", "-o", str(tmp_path / "h"))
    assert code == 1 and "already exists" in out.err
    assert run("show", export)[0] == 1
