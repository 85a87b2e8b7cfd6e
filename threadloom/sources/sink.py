"""Packages as files: all or nothing unless forced, each file in one step."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.errors import OutputExists
from threadloom.functions import text as T

SPACE = "\t-\r \x85   -     　"


def sanitize_filename(name: str) -> str:
    """Same rule as the column function, for names that the driver makes."""
    import regex

    safe = re.sub("-+", "-", re.sub('[\x00-\x1f\x7f-\x9f/\\\\:*?"<>|]', "-", name))
    kept = re.sub(f"^[.{SPACE}-]+|[.{SPACE}-]+$", "", safe)
    found = regex.findall(r"\X", kept)
    return ("".join(found[:120]).rstrip() + "…" if len(found) > 120 else kept) or "untitled"


class Writer:
    """Files of one package in a folder: staged by name, a later one of the same name replaces the first."""

    def __init__(self, folder: str | Path, force: bool = False):
        self.folder, self.force = Path(folder), force
        self.staged: dict[str, str] = {}

    def stage(self, name: str, contents: str) -> None:
        self.staged[sanitize_filename(name)] = contents

    def commit(self) -> list[Path]:
        targets = [self.folder / n for n in self.staged]
        if not self.force:
            for t in targets:
                if t.exists():
                    raise OutputExists(str(t))
        self.folder.mkdir(parents=True, exist_ok=True)
        for t, contents in zip(targets, self.staged.values(), strict=True):
            write_atomic(t, contents)
        return targets


def write_atomic(path: Path, contents: str, force: bool = True) -> None:
    """A temporary file beside the target takes its place in one step."""
    if not force and path.exists():
        raise OutputExists(str(path))
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=".staged-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(contents)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_package(package: DataFrame, conv_id: str, folder: str | Path, force: bool = False) -> list[Path]:
    """Writes one conversation's files from the rows of ``packages``."""
    writer = Writer(folder, force)
    for row in package.where(F.col("conv_id") == conv_id).select("filename", "contents").collect():  # five files at most
        writer.stage(row.filename, row.contents)
    return writer.commit()


def write_packages(package: DataFrame, path: str, force: bool = False) -> None:
    """Writes all conversations' files as a table, dealt by file name; the write is committed as a whole."""
    out = package.withColumn("folder", T.sanitize_filename(F.col("conv_id")))
    out.write.mode("overwrite" if force else "errorifexists").partitionBy("filename").parquet(path)
