"""Inputs of the tests: export documents, and graphs as small as they are nasty."""

from __future__ import annotations

import io
import json
import zipfile


def text(role: str, *parts, **more) -> dict:
    return {"author": {"role": role}, "content": {"content_type": "text", "parts": list(parts)}, **more}


def thread(conv_id: str | None, *messages, title: str | None = "A thread", update: float | None = 1757071924.421, **more) -> dict:
    """A conversation whose root has no message, with one node for each message below the one before."""
    mapping = {"root": {"id": "root", "message": None, "parent": None, "children": ["n0"]}}
    for i, m in enumerate(messages):
        mapping[f"n{i}"] = {"id": "stale", "message": m, "parent": f"n{i - 1}" if i else "root", "children": [f"n{i + 1}"] if i + 1 < len(messages) else []}
    out = {"id": conv_id, "title": title, "create_time": 1757071000.0, "update_time": update, "current_node": f"n{len(messages) - 1}", "mapping": mapping}
    return {k: v for k, v in (out | more).items() if k != "id" or v is not None}


def archive(entries: dict[str, bytes | list]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body if isinstance(body, bytes) else json.dumps(body))
    return out.getvalue()


def walk(nodes: dict[str, str | None], start: str) -> tuple[list[str], str]:
    """Root-first walk with a guard, and why it stopped: root, broken or cycle."""
    path, seen, at = [], set(), start
    while True:
        path.append(at)
        seen.add(at)
        up = nodes[at]
        if up is None:
            return path[::-1], "root"
        if up not in nodes:
            return path[::-1], "broken"
        if up in seen:
            return path[::-1], "cycle"
        at = up


def expected_branch(nodes: dict[str, str | None], has: dict[str, bool], current: str | None) -> tuple[str, str | None, list[str]]:
    """status, strategy and path, node by node."""
    if not nodes:
        return "empty_mapping", None, []
    if not any(has.values()):
        return "no_messages", None, []
    if current in nodes:
        path = walk(nodes, current)[0]
        if any(has[n] for n in path):
            return "ok", "current-node", path
    paths = {n: walk(nodes, n)[0] for n in nodes}
    best = min(nodes, key=lambda n: (-len(paths[n]), -sum(has[m] for m in paths[n]), n))
    return "ok", "longest-path", paths[best]
