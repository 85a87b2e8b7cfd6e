"""What can go wrong.  The wording is fixed: users and their scripts see it."""

from __future__ import annotations


class ExportError(Exception):
    """An input that can't be read as an export."""


class ReadFailed(ExportError):
    def __init__(self, path: str):
        super().__init__(f"failed to read {path}")


class InvalidJson(ExportError):
    def __init__(self, origin: str):
        super().__init__(f"{origin} is not valid ChatGPT export JSON")


class UnexpectedShape(ExportError):
    def __init__(self, origin: str):
        super().__init__(f"{origin} does not look like a ChatGPT export: expected a JSON array of conversations or an object with a `conversations` array")


class BadArchive(ExportError):
    def __init__(self, path: str):
        super().__init__(f"failed to read archive {path}")


class NoConversationsInArchive(ExportError):
    def __init__(self, path: str):
        super().__init__(f"no `conversations.json` found in archive {path}; is this really a ChatGPT data export?")


class InputTooLarge(ExportError):
    def __init__(self, path: str, size: int, limit: int):
        super().__init__(f"{path} is {size} bytes, over the {limit} byte safety limit (raise it with --max-unpacked-bytes)")


class ArchiveEntryTooLarge(ExportError):
    def __init__(self, entry: str, declared: int, limit: int):
        super().__init__(f"archive entry `{entry}` declares {declared} bytes uncompressed, over the {limit} byte safety limit (raise it with --max-unpacked-bytes)")


class ArchiveEntrySizeMismatch(ExportError):
    def __init__(self, entry: str, declared: int, limit: int):
        super().__init__(f"archive entry `{entry}` declared only {declared} bytes but delivered more than the {limit} byte safety limit; the archive is corrupt or hostile")


class UnsafeArchivePath(ExportError):
    def __init__(self, entry: str):
        super().__init__(f"archive entry `{entry}` has an unsafe path and was refused")


class OutputExists(Exception):
    def __init__(self, path: str):
        super().__init__(f"{path} already exists\nhint: pass --force to overwrite")


class GraphError(Exception):
    """A conversation without any branch; status is as in Branches.meta."""

    def __init__(self, conv_id: str, status: str):
        what = {"empty_mapping": "has an empty node mapping", "no_messages": "contains no messages on any branch"}[status]
        super().__init__(f"conversation `{conv_id}` {what}")
        self.status = status


class SelectError(Exception):
    pass


class NotFound(SelectError):
    def __init__(self, query: str):
        super().__init__(f"no conversation matches {query}")


class EmptyExport(SelectError):
    def __init__(self):
        super().__init__("the export contains no conversations")


class NoSelector(SelectError):
    def __init__(self):
        super().__init__("no conversation selected\nhint: pass --conversation ID, --title TITLE, or a query")


class Ambiguous(SelectError):
    """candidates: (id, title, score) in order; ids and titles as they are shown."""

    def __init__(self, query: str, candidates: list[tuple[str, str, int]], shown: list[tuple[str, str]]):
        listed = "\n".join(f"  {c[2]:>3}  {i}  {t}" for c, (i, t) in zip(candidates, shown, strict=True))
        if len({c[0] for c in candidates}) == len(candidates):
            hint = "hint: re-run with --conversation ID, or --pick to choose interactively"
        else:
            hint = "hint: these candidates share a conversation id; select with --title TITLE, or --pick to choose interactively"
        super().__init__(f"{query} is ambiguous; {len(candidates)} candidates matched:\n{listed}\n{hint}")
        self.candidates = candidates


#: By the code that a scan reports for a file.
BY_CODE = {c.__name__: c for c in ExportError.__subclasses__()}
