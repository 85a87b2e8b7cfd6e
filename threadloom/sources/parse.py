"""One export file, from bytes to conversations: archives, document shapes and strict typing of known fields.

Runs inside a scan task, a file at a time, an element at a time.  A field of a wrong type spoils its conversation, never the file.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from typing import Any, BinaryIO

from threadloom import errors as E

ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
NAMED_UNSAFE = 3
WINDOW = 1 << 18  # bytes read at a time
WHITESPACE = re.compile(r"[ \t\n\r]*")
UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f‪-‮⁦-⁩]")
MISSING = object()


class WrongType(Exception):
    pass


def is_zip(data: bytes) -> bool:
    return data[:4] in ZIP_MAGIC


def display_name(name: str) -> str:
    """An entry name that is safe to show, 120 clusters at most."""
    import regex

    found = regex.findall(r"\X", UNSAFE.sub("", name))
    return "".join(found) if len(found) <= 120 else "".join(found[:120]).rstrip() + "…"


def safe_entry(name: str) -> bool:
    if not name or re.search("[\x00-\x1f\x7f-\x9f]", name) or name[0] in "/\\" or re.match("[A-Za-z]:", name):
        return False
    return all(part and part != ".." for part in re.split(r"[/\\]", name))


def conversations_entry(name: str) -> bool:
    parts = [p for p in re.split(r"[/\\]", name) if p]
    if not parts or any(p.lower() == "__macosx" for p in parts) or parts[-1].startswith("."):
        return False
    last = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in parts[-1])
    stem = last.removesuffix(".json")
    return stem != last and (stem.startswith("conversations") or stem.endswith("conversations"))


def entries(path: str, f: BinaryIO, limit: int) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo], list[str]]:
    """An archive, its conversation files by name and place, read through once, and warnings."""
    try:
        archive = zipfile.ZipFile(f)
    except zipfile.BadZipFile:
        raise E.BadArchive(path) from None
    wanted: list[tuple[str, int, zipfile.ZipInfo]] = []
    odd: list[str] = []
    for i, info in enumerate(archive.infolist()):
        if info.is_dir():
            continue
        name, ok = info.filename, safe_entry(info.orig_filename)
        if not conversations_entry(name):
            if not ok:
                odd.append(display_name(info.orig_filename))
        elif not ok:
            raise E.UnsafeArchivePath(display_name(info.orig_filename))
        else:
            wanted.append((name, i, info))
    if not wanted:
        raise E.NoConversationsInArchive(path)
    warnings = []
    if odd:
        some = ", ".join(odd[:NAMED_UNSAFE]) + (", …" if len(odd) > NAMED_UNSAFE else "")
        warnings.append(f"ignored {len(odd)} archive {'entry' if len(odd) == 1 else 'entries'} with unsafe paths: {some}")
    out = []
    for name, _, info in sorted(wanted, key=lambda w: w[:2]):
        if info.file_size > limit:
            raise E.ArchiveEntryTooLarge(display_name(name), info.file_size, limit)
        size = 0
        try:
            with archive.open(info) as body:
                while size <= limit and (some := body.read(min(WINDOW, limit + 1 - size))):
                    size += len(some)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            raise E.BadArchive(path) from None
        if size > limit:
            raise E.ArchiveEntrySizeMismatch(display_name(name), info.file_size, limit)
        out.append(info)
    return archive, out, warnings


def refuse(constant: str) -> Any:
    raise ValueError(constant)


class Text:
    """The text of a JSON document, decoded a window at a time; what has been parsed is let go."""

    decoder = json.JSONDecoder(parse_constant=refuse)

    def __init__(self, f: BinaryIO):
        self.f, self.decode = f, codecs.getincrementaldecoder("utf-8-sig")().decode
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads on, as much again as is left, so that a long value is tried a few times only."""
        if self.ended:
            return False
        some = self.f.read(max(WINDOW, len(self.text) - self.at))
        self.ended = not some
        self.text, self.at = self.text[self.at :] + self.decode(some, self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no white space, nothing at the end."""
        while True:
            self.at = WHITESPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += len(c)
        return c

    def value(self) -> Any:
        self.peek()
        while True:
            try:
                v, end = self.decoder.raw_decode(self.text, self.at)
                if end + 2 < len(self.text) or self.ended:  # behind the window a number may go on, even from 1e+
                    self.at = end
                    return v
            except json.JSONDecodeError as e:
                cut = e.msg.startswith("Unterminated") or e.pos > len(self.text) - 16  # no escape or word is as long
                if self.ended or not cut:
                    raise
            self.more()


def values(f: BinaryIO) -> Iterator[tuple[str, int, Any]]:
    """What a document holds, one value at a time, without building it: list (one begins, with its number), element (of
    that list) or other.  Lists are the document itself or ``conversations`` of an object, each time it occurs."""
    text, n = Text(f), 0

    def elements() -> Iterator[tuple[str, int, Any]]:
        text.take()
        yield "list", n, None
        if text.peek() == "]":
            text.take()
            return
        while True:
            yield "element", n, text.value()
            c = text.take()
            if c == "]":
                return
            if c != ",":
                raise ValueError(c)

    first = text.peek()
    if first == "[":
        yield from elements()
    elif first == "{":
        text.take()
        c = "," if text.peek() != "}" else text.take()
        while c == ",":
            if text.peek() != '"':
                raise ValueError(text.peek())
            key = text.value()
            yield "other", -1, key
            if text.take() != ":":
                raise ValueError(key)
            n += key == "conversations"
            if key == "conversations" and text.peek() == "[":
                yield from elements()
            else:
                yield "other", n if key == "conversations" else -1, text.value()
            c = text.take()
        if c != "}":
            raise ValueError(c)
    else:
        yield "other", -1, text.value()
    if text.peek():
        raise ValueError(text.peek())


def checked(f: BinaryIO, origin: str) -> int:
    """Reads a document through; the number of the list that counts, which is the last as for any key that is repeated."""
    last = None
    try:
        for what, n, v in values(f):
            if what != "element" and n >= 0:
                last = n if what == "list" else None
            json.dumps(v, ensure_ascii=False).encode()  # half of a surrogate pair is no text
    except (ValueError, RecursionError):
        raise E.InvalidJson(origin) from None
    if last is None:
        raise E.UnexpectedShape(origin)
    return last


def text_or_none(of: dict, key: str) -> str | None:
    v = of.get(key)
    if v is not None and not isinstance(v, str):
        raise WrongType(key)
    return v


def number_or_none(of: dict, key: str) -> float | None:
    v = of.get(key)
    if v is not None and (isinstance(v, bool) or not isinstance(v, int | float)):
        raise WrongType(key)
    return None if v is None else float(v)


def typed(of: dict, key: str, kind: type, default: Any) -> Any:
    v = of.get(key, MISSING)
    if v is MISSING:
        return default
    if not isinstance(v, kind):
        raise WrongType(key)
    return v


def part(v: Any) -> dict[str, str | None]:
    """A part of a message: kind, its text, and a file's name or an unknown content type as name."""
    if isinstance(v, str):
        return {"kind": "text", "text": v, "name": None}
    of = v if isinstance(v, dict) else {}
    get = lambda k: of[k] if isinstance(of.get(k), str) else None
    kind = get("content_type") or ("unknown" if not isinstance(of.get("content_type"), str) else "")
    if kind == "text":
        return {"kind": "text", "text": get("text") or "", "name": None}
    if kind == "image_asset_pointer":
        return {"kind": "image", "text": None, "name": get("asset_pointer")}
    if kind == "audio_transcription":
        return {"kind": "audio", "text": get("text"), "name": None}
    if kind in ("audio_asset_pointer", "real_time_user_audio_video_asset_pointer"):
        return {"kind": "audio", "text": None, "name": None}
    if kind in ("file", "video_container_asset_pointer"):
        return {"kind": "file", "text": None, "name": get("name") if "name" in of else get("file_name")}
    return {"kind": "unknown", "text": None, "name": kind}


def content(v: Any) -> dict[str, Any]:
    """A message's content as a tag (kind) and the fields of its arm; object parts of plain text stay parts."""
    empty = {"kind": "empty", "content_type": "empty", "language": None, "text": None, "parts": []}
    if not isinstance(v, dict):
        return empty | {"kind": "text", "content_type": "text", "parts": [part(v)]} if isinstance(v, str) and v else empty
    kind = v.get("content_type") if isinstance(v.get("content_type"), str) else ""
    text = v["text"] if isinstance(v.get("text"), str) else None
    parts = [part(p) for p in v["parts"]] if isinstance(v.get("parts"), list) else []
    if kind == "text":
        return empty | {"kind": "text", "content_type": "text", "parts": parts} if parts else empty
    if kind == "multimodal_text":
        return empty | {"kind": "multimodal", "content_type": kind, "parts": parts} if parts else empty
    if kind == "code":
        language = v["language"] if isinstance(v.get("language"), str) and v["language"] not in ("", "unknown") else None
        return empty | {"kind": "code", "content_type": kind, "language": language, "text": text or ""}
    if kind == "execution_output":
        return empty | {"kind": "tool_output", "content_type": kind, "text": text or ""}
    return empty | {"kind": "other", "content_type": kind, "text": text, "parts": [] if text is not None else parts} if kind else empty


def message(v: Any) -> dict[str, Any] | None:
    if v is None:
        return None
    if not isinstance(v, dict):
        raise WrongType("message")
    author = typed(v, "author", dict, {})
    meta = typed(v, "metadata", dict, {})
    text_or_none(v, "recipient")
    return {
        "id": text_or_none(v, "id"),
        "role": typed(author, "role", str, "unknown"),
        "author_name": text_or_none(author, "name"),
        "create_time": number_or_none(v, "create_time"),
        "recipient": text_or_none(v, "recipient"),
        "hidden": typed(meta, "is_visually_hidden_from_conversation", bool, False),
        "model_slug": text_or_none(meta, "model_slug"),
        "content": content(v.get("content")),
    }


def node(key: str, v: Any) -> dict[str, Any]:
    if not isinstance(v, dict):
        raise WrongType("node")
    typed(v, "id", str, "")
    children = typed(v, "children", list, [])
    if not all(isinstance(c, str) for c in children):
        raise WrongType("children")
    return {"node_id": key, "parent": text_or_none(v, "parent"), "children": children, "message": message(v.get("message"))}


def conversation(v: Any, index: int) -> dict[str, Any]:
    if not isinstance(v, dict):
        raise WrongType("conversation")
    conv_id = text_or_none(v, "id")
    other = text_or_none(v, "conversation_id")
    return {
        "conv_id": (conv_id if conv_id is not None else other) or f"unknown-{index}",
        "title": text_or_none(v, "title"),
        "create_time": number_or_none(v, "create_time"),
        "update_time": number_or_none(v, "update_time"),
        "current_node": text_or_none(v, "current_node") or None,
        "nodes": [node(k, n) for k, n in typed(v, "mapping", dict, {}).items()],
    }


def raw_facts(v: Any) -> dict[str, Any]:
    """What finding an untouched element needs, readable or not."""
    of = v if isinstance(v, dict) else {}
    t = of.get("update_time")
    return {
        "raw_id": of["id"] if isinstance(of.get("id"), str) else None,
        "raw_other_id": of["conversation_id"] if isinstance(of.get("conversation_id"), str) else None,
        "raw_time": float(t) if isinstance(t, int | float) and not isinstance(t, bool) else None,
        "raw": json.dumps(v, ensure_ascii=False),
    }


def file_rows(path: str, f: BinaryIO, limit: int) -> Iterator[dict[str, Any]]:
    """A row for each element of a file; a last one for each document with its warnings.  All documents are read through
    before the first row, and no more of them than a window or one element is held."""
    if is_zip(f.read(4)):
        archive, found, warnings = entries(path, f, limit)
        documents = [(info.filename, f"{path}!{display_name(info.filename)}", partial(archive.open, info)) for info in found]
    else:
        size = f.seek(0, io.SEEK_END)
        if size > limit:
            raise E.InputTooLarge(path, size, limit)
        documents, warnings = [(None, path, lambda: f)], []
    lists = []
    for _, origin, opened in documents:
        body = opened()
        body.seek(0)
        lists.append(checked(body, origin))
    for k, (name, origin, opened) in enumerate(documents):
        body, i = opened(), 0
        body.seek(0)
        for what, n, v in values(body):
            if what != "element" or n != lists[k]:
                continue
            at = {"path": path, "entry": name, "entry_no": k, "idx": i, "origin": origin} | raw_facts(v)
            try:
                yield at | {"conversation": conversation(v, i)}
            except WrongType:
                yield at | {"conversation": None}
            i += 1
        yield {"path": path, "entry": name, "entry_no": k, "idx": -1, "origin": origin, "warnings": warnings if k == 0 else []}
