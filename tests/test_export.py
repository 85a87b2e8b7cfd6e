import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from exports import archive, text, thread
from threadloom import errors as E
from threadloom.sources import parse
from threadloom.sources.export import PIECE, pieces, raw_conversation, read_export, scan
from threadloom.streaming.landing import stream_exports


def write(path, body):
    path.write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())
    return str(path)


def one(content):
    return thread("c", {"author": {"role": "assistant"}, "content": content})


@pytest.fixture(scope="module")
def contents(spark, tmp_path_factory):
    part = lambda kind, **more: {"content_type": kind, **more}
    cases = {
        "text": ({"content_type": "text", "parts": ["a ", "", "b"]}, "text", "a \n\n\n\nb", "a\n\nb", False),
        "blank": ({"content_type": "text", "parts": [" "]}, "empty", "", "", True),
        "bare": ("hello", "text", "hello", "hello", False),
        "null": (None, "empty", "", "", True),
        "none": ({}, "empty", "", "", True),
        "object part": ({"content_type": "text", "parts": [part("image_asset_pointer")]}, "text", "[image attachment]", "[image attachment]", False),
        "multimodal": (
            {"content_type": "multimodal_text", "parts": ["see", part("image_asset_pointer", asset_pointer="p"), part("audio_transcription", text="hi"), part("audio_asset_pointer"), part("file", name="a\x1b.pdf"), part("file"), part("odd")]},
            "multimodal_text", "see\n\nhi", "see\n\n[image attachment]\n\n[audio transcript] hi\n\n[audio attachment]\n\n[file attachment: a.pdf]\n\n[file attachment]\n\n[unsupported content: odd]", False,
        ),
        "no parts": ({"content_type": "multimodal_text", "parts": []}, "empty", "", "", True),
        "code": ({"content_type": "code", "language": "unknown", "text": ""}, "code", "", "```\n\n```", False),
        "tool": ({"content_type": "execution_output", "text": " "}, "execution_output", " ", "[tool output omitted]", False),
        "saved": ({"content_type": "quote", "text": "kept "}, "quote", "kept ", "kept", False),
        "saved parts": ({"content_type": "quote", "parts": ["a", "b"]}, "quote", "a\n\nb", "a\n\nb", False),
        "lost": ({"content_type": "state", "n": 1}, "state", "", "[state content omitted]", False),
    }
    path = tmp_path_factory.mktemp("contents") / "conversations.json"
    found = read_export(spark, write(path, [one(c) | {"id": k} for k, (c, *_) in cases.items()]))
    return cases, {r.conv_id: r for r in found.nodes.where("has_message").collect()}


def test_contents(contents):
    cases, rows = contents
    for k, (_, *want) in cases.items():
        r = rows[k]
        assert [r.content_type, r.plain_text, r.markdown, r.is_empty] == want, k


def test_duplicates_skips_and_identity(spark, tmp_path):
    doc = [
        thread("a", text("user", "old"), update=1.0),
        thread("b", text("user", "x")),
        thread("a", text("user", "new"), update=2.0, title="newer"),
        thread(None, text("user", "y"), conversation_id="other"),
        thread("", text("user", "z"), conversation_id="unused"),
        thread("bad", text("user", "q"), title=7),
        5,
        thread("null mapping", mapping=None),
        thread("a", text("user", "tie"), update=2.0),
    ]
    path = write(tmp_path / "conversations.json", doc)
    found = read_export(spark, path)
    rows = found.conversations.orderBy("pos").collect()
    assert [(r.conv_id, r.title) for r in rows] == [("a", "newer"), ("b", "A thread"), ("other", "A thread"), ("unknown-4", "A thread")]
    assert [r.warning for r in found.warnings.orderBy("ord").collect()] == [f"skipped 3 malformed conversation entries in {path}", f"collapsed 2 duplicate conversation ids in {path}; kept the copy with the newest update_time"]
    assert found.source == path
    assert {r.node_id for r in found.nodes.where("conv_id = 'b'").collect()} == {"root", "n0"}
    assert json.loads(raw_conversation(found.scanned, "bad"))["title"] == 7
    assert json.loads(raw_conversation(found.scanned, "a"))["title"] == "newer"
    assert raw_conversation(found.scanned, "nothing") is None


def test_shapes(spark, tmp_path):
    assert read_export(spark, write(tmp_path / "a.json", {"conversations": [thread("w", text("user", "x"))]})).conversations.count() == 1
    assert read_export(spark, write(tmp_path / "b.json", b"\xef\xbb\xbf[]")).conversations.count() == 0
    for body, kind in ((b"{", E.InvalidJson), (b"[NaN]", E.InvalidJson), ({"x": 1}, E.UnexpectedShape), (b"PK\x03\x04junk", E.BadArchive), (archive({"readme.txt": b"x"}), E.NoConversationsInArchive)):
        with pytest.raises(kind):
            read_export(spark, write(tmp_path / "c.bin", body))
    with pytest.raises(E.InputTooLarge):
        read_export(spark, write(tmp_path / "d.json", [1] * 100), max_unpacked_bytes=10)


def test_archives(spark, tmp_path):
    a, b = thread("a", text("user", "1"), update=5.0), thread("a", text("user", "2"), update=6.0)
    body = archive({"x/conversations-2.json": [b], "x/Conversations-1.JSON": [a, thread("c", text("user", "3"))], "__MACOSX/conversations.json": b"junk", "../evil.txt": b"", "chat.html": b""})
    path = write(tmp_path / "export.bin", body)
    found = read_export(spark, path)
    assert [(r.conv_id, r.update_time) for r in found.conversations.orderBy("pos").collect()] == [("a", 6.0), ("c", 1757071924.421)]
    assert [r.warning for r in found.warnings.orderBy("ord").collect()] == [
        "ignored 1 archive entry with unsafe paths: ../evil.txt",
        f"collapsed 1 duplicate conversation id in {path}; kept the copy with the newest update_time",
        "merged 2 conversation files from the archive: x/Conversations-1.JSON, x/conversations-2.json",
    ]
    assert found.source == f"{path}!2 files"
    with pytest.raises(E.UnsafeArchivePath):
        read_export(spark, write(tmp_path / "u.zip", archive({"../conversations.json": []})))
    with pytest.raises(E.ArchiveEntryTooLarge):
        read_export(spark, write(tmp_path / "l.zip", archive({"conversations.json": [1] * 1000})), max_unpacked_bytes=100)
    assert read_export(spark, [path, write(tmp_path / "bad.json", b"{")], on_error="keep").conversations.count() == 2


def whole(body):
    """A document's conversations as json reads them at once, or the error."""
    try:
        v = json.loads(body.removeprefix(b"\xef\xbb\xbf").decode(), parse_constant=parse.refuse)
        json.dumps(v, ensure_ascii=False).encode()
    except (ValueError, RecursionError):
        return E.InvalidJson
    v = v.get("conversations") if isinstance(v, dict) else v
    return v if isinstance(v, list) else E.UnexpectedShape


@pytest.mark.parametrize("window", [1, 2, 3, 7, 1 << 18])
def test_windows_give_what_the_whole_document_gives(monkeypatch, window):
    monkeypatch.setattr(parse, "WINDOW", window)
    bodies = ['[]', '', ' ', '5', '{}', '[1.5e+30]', '[123.25, -1e5, 12]', '["\\ud83d\\ude00é😀", {"k": [true, null]}]', '["\\ud83d"]', '[NaN]', '[-Infinity]', '[1,]', '[1 2]', '[1]x', '[1] \n', '{"a": 1,}', '{"a" 1}', '["\x01"]', '[12', '["a', '[1}']
    bodies += ['{"conversations": [1, "x"], "a": [2]}', '{"a": {"b": 1}, "conversations": []}', '{"conversations": [1], "conversations": 5}', '{"conversations": 5, "conversations": [2]}', '{"conversations": [1], "conversations": [2, 3]}', '{"conversations": [1], "\\ud800": 1}', '{"conversations": null}']
    for body in [*(b.encode() for b in bodies), b"\xef\xbb\xbf[1]", b"\xef\xbb\xbf" * 2 + b"[1]", b"[\xff]", b"\xef"]:
        try:
            n = parse.checked(io.BytesIO(body), "x")
            got = [v for what, k, v in parse.values(io.BytesIO(body)) if (what, k) == ("element", n)]
        except E.ExportError as e:
            got = type(e)
        assert got == whole(body), body


def test_large_files_are_not_held(spark):
    """30 MB in 3,000 elements: about one window and one element at a time, and pieces between the JVM and Python."""
    body = json.dumps([thread(f"c{i}", text("user", "x" * 10_000)) for i in range(3000)]).encode()
    tracemalloc.start()
    assert sum(r["idx"] >= 0 for r in parse.file_rows("x.json", io.BytesIO(body), 1 << 30)) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    files = spark.createDataFrame([("a", body), ("b", b""), ("c", b"[]")], "path string, content binary").coalesce(1)
    cut = pieces(files)
    assert cut.agg(F.max(F.octet_length("piece"))).first()[0] <= PIECE
    assert {r.path: r.n for r in cut.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"a": -(-len(body) // PIECE), "b": 1, "c": 1}
    got = {(r.path, r.error.code if r.error else None): r.n for r in scan(files).groupBy("path", "error").agg(F.count_if(F.col("idx") >= 0).alias("n")).collect()}
    assert got == {("a", None): 3000, ("b", "InvalidJson"): 0, ("c", None): 0}


def test_entry_names():
    assert all(map(parse.conversations_entry, ("conversations.json", "a/b/CONVERSATIONS-001.json", "my-conversations.json", "a\\conversations.json")))
    assert not any(map(parse.conversations_entry, ("conversations.txt", "__macosx/conversations.json", "a/.conversations.json", "conversation.json", "conversations.json/x", "")))
    assert all(map(parse.safe_entry, ("a", "a/b", "..a/b..")))
    assert not any(map(parse.safe_entry, ("", "/a", "\\a", "C:a", "a//b", "a/../b", "a\x07")))


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    write(folder / "a.json", [thread("s", text("user", "x"))])
    write(folder / "bad.json", b"{")
    rows = stream_exports(spark, str(folder)).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    assert rows.awaitTermination(120)
    got = spark.table("landed").collect()
    assert {r.conversation.conv_id for r in got if r.conversation} == {"s"} and {r.error.code for r in got if r.error} == {"InvalidJson"}
