"""Exports as tables: conversations, nodes, warnings and the untouched elements."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.errors import BY_CODE, ExportError, InputTooLarge, ReadFailed
from threadloom.functions import content as C
from threadloom.operators.dedup import dedup_latest
from threadloom.session import checkpointed
from threadloom.sources.parse import file_rows, is_zip

MAX_UNPACKED = 512 << 20
PIECE = 1 << 20
PART = "struct<kind: string, text: string, name: string>"
MESSAGE = f"struct<id: string, role: string, author_name: string, create_time: double, recipient: string, hidden: boolean, model_slug: string, content: struct<kind: string, content_type: string, language: string, text: string, parts: array<{PART}>>>"
NODE = f"struct<node_id: string, parent: string, children: array<string>, message: {MESSAGE}>"
CONVERSATION = f"struct<conv_id: string, title: string, create_time: double, update_time: double, current_node: string, nodes: array<{NODE}>>"
SCANNED = f"path string, entry string, entry_no int, idx int, origin string, raw string, raw_id string, raw_other_id string, raw_time double, conversation {CONVERSATION}, warnings array<string>, error struct<code: string, message: string>"


@dataclass
class ExportSet:
    """conversations (with pos, their order), nodes, warnings (ord, warning) and scanned rows."""

    conversations: DataFrame
    nodes: DataFrame
    warnings: DataFrame
    scanned: DataFrame

    @property
    def source(self) -> str:
        """A label of what was read, made when it is asked for."""
        return source_label(self.scanned)


class Source(Protocol):
    """Where files come from: path, length and content of each, of which only those asked for are read."""

    def files(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class Paths:
    """Files of any file system that Spark reads, by path, folder or pattern."""

    paths: tuple[str, ...]

    def files(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.format("binaryFile").load(list(self.paths))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "DATA_SOURCE_NOT_FOUND"):
                raise
            raise ReadFailed(", ".join(self.paths)) from None


def too_large(files: DataFrame, limit: int) -> list[str]:
    """Paths of files over the limit that aren't archives (their entries are measured one by one).  Only lengths are
    listed, and the first bytes read of what is too long."""
    spark = files.sparkSession
    out = []
    for row in files.where(F.col("length") > limit).select("path", "length").orderBy("path").collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            start = bytes(max(0, stream.read()) for _ in range(4))
        finally:
            stream.close()
        if not is_zip(start):
            out.append((row.path, row.length))
    return out


def pieces(files: DataFrame) -> DataFrame:
    """Contents cut to pieces, those of a file one after the other (path, piece, last), so that no task holds a file in
    Python."""
    local = F.regexp_replace("path", "^file:/+", "/")  # as local_path
    most = F.greatest(F.lit(0), F.floor((F.octet_length("content") - 1) / PIECE).cast("int"))
    cut = files.select(local.alias("path"), "content", most.alias("most")).select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("k"))
    return cut.select("path", F.substring("content", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"), (F.col("k") == F.col("most")).alias("last"))


def scan(files: DataFrame, max_unpacked_bytes: int = MAX_UNPACKED) -> DataFrame:
    """Rows of files (path, content), one element each; a file that can't be read gives one row with its error.  A task
    keeps the file it is at on its disk, and parses it from there."""
    schema = to_arrow_schema(S.StructType.fromDDL(SCANNED))

    def rows(path: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        try:
            for row in file_rows(path, f, max_unpacked_bytes):
                some.append(row)
                size += len(row.get("raw") or "")
                if size > PIECE:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)
                    some, size = [], 0
        except ExportError as e:
            some = [{"path": path, "entry_no": 0, "idx": -1, "origin": path, "error": {"code": type(e).__name__, "message": str(e)}}]
        yield pa.RecordBatch.from_pylist(some, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            for path, piece, last in zip(batch.column("path"), batch.column("piece"), batch.column("last"), strict=True):
                f = f or tempfile.TemporaryFile()
                f.write(piece.as_buffer())
                if last.as_py():
                    with f:
                        f.seek(0)
                        yield from rows(path.as_py(), f)
                    f = None

    return pieces(files).mapInArrow(run, SCANNED)


def local_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def as_error(code: str, message: str) -> ExportError:
    kind = BY_CODE.get(code, ExportError)
    e = kind.__new__(kind)
    Exception.__init__(e, message)
    return e


def read_export(spark: SparkSession, path: str | list[str] | Source, max_unpacked_bytes: int = MAX_UNPACKED, on_error: str = "raise") -> ExportSet:
    """Reads JSON or ZIP exports, told apart by their first bytes.

    ``path``: one or several, or a source of one's own.  Several files make one set.  ``on_error``: raise the first error of a file, or keep what could be read (errors stay
    in ``scanned``).
    """
    source = Paths((path,) if isinstance(path, str) else tuple(path)) if isinstance(path, str | list | tuple) else path
    files = source.files(spark)
    large = too_large(files, max_unpacked_bytes)
    scanned = scan(files.where(~F.col("path").isin([p for p, _ in large])) if large else files, max_unpacked_bytes)
    if large:
        failed = [{"path": local_path(p), "entry_no": 0, "idx": -1, "origin": local_path(p), "error": {"code": "InputTooLarge", "message": str(InputTooLarge(local_path(p), n, max_unpacked_bytes))}} for p, n in large]
        scanned = scanned.unionByName(spark.createDataFrame(failed, scanned.schema))
    try:
        scanned = checkpointed(scanned)
    except Exception as e:  # files that went or can't be opened; anything else keeps its own face
        if "FAILED_READ_FILE" not in str(e) and "FileNotFoundException" not in str(e) and "AccessControlException" not in str(e):
            raise
        raise ReadFailed(", ".join(source.paths) if isinstance(source, Paths) else str(source)) from e
    if on_error == "raise":
        bad = scanned.where("error is not null").orderBy("path").select("error.code", "error.message").limit(1).collect()
        if bad:
            raise as_error(*bad[0])
    return assemble(scanned)


def assemble(scanned: DataFrame) -> ExportSet:
    """Keeps of each id the copy with the newest update_time (the first of equal ones) at the place of its first copy."""
    read = scanned.where("conversation is not null").select("path", "entry_no", "idx", "conversation.*")
    order = ["path", "entry_no", "idx"]
    kept = dedup_latest(read, ["conv_id"], "update_time", order)
    conversations = kept.select("conv_id", "title", "create_time", "update_time", "current_node", "pos")
    nodes = kept.select("conv_id", F.explode("nodes").alias("n")).select("conv_id", "n.node_id", "n.parent", "n.children", "n.message")
    return ExportSet(conversations, C.flat_nodes(nodes), load_warnings(scanned, read), scanned)


def counted(n, one: str, many: str):
    return F.when(n == 1, F.lit(one)).when(n > 1, F.concat(n.cast("string"), F.lit(many)))


def load_warnings(scanned: DataFrame, read: DataFrame) -> DataFrame:
    """path, ord and warning: of archives, skipped elements, collapsed copies and merged files."""
    own = scanned.where("idx = -1").select("path", "entry_no", F.lit(0).alias("part"), F.explode("warnings").alias("warning")).withColumn("entry_no", F.lit(-1))
    skips = scanned.where("idx >= 0 and conversation is null").groupBy("path", "entry_no", "origin").agg(F.count("*").alias("n"))
    n = F.col("n")
    skipped = skips.select("path", "entry_no", F.lit(1).alias("part"), F.concat(F.lit("skipped "), counted(n, "1 malformed conversation entry", " malformed conversation entries"), F.lit(" in "), F.col("origin")).alias("warning"))
    copies = read.groupBy("path").agg((F.count("*") - F.count_distinct("conv_id")).alias("n")).where("n > 0")
    last = F.lit(2**31 - 1)
    collapsed = copies.select("path", last.alias("entry_no"), F.lit(2).alias("part"), F.concat(F.lit("collapsed "), counted(n, "1 duplicate conversation id", " duplicate conversation ids"), F.lit(" in "), F.col("path"), F.lit("; kept the copy with the newest update_time")).alias("warning"))
    shown = F.substring("origin", F.length("path") + 2, F.length("origin"))
    many = scanned.where("idx = -1 and entry is not null").groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", shown.alias("name")))), lambda x: x["name"]), ", ").alias("names")).where("n > 1")
    merged = many.select("path", last.alias("entry_no"), F.lit(3).alias("part"), F.concat(F.lit("merged "), n.cast("string"), F.lit(" conversation files from the archive: "), F.col("names")).alias("warning"))
    all_ = own.unionByName(skipped).unionByName(collapsed).unionByName(merged)
    order = Window.partitionBy("path").orderBy("entry_no", "part")
    return all_.select("path", (F.row_number().over(order) - 1).alias("ord"), "warning")


def source_label(scanned: DataFrame) -> str:
    """path, path!entry, or path!N files; several paths are joined by commas."""
    rows = scanned.where("idx = -1").groupBy("path").agg(F.count("entry").alias("n"), F.max("origin").alias("origin"))
    label = F.when(F.col("n") == 0, F.col("path")).when(F.col("n") == 1, F.col("origin")).otherwise(F.concat("path", F.lit("!"), F.col("n").cast("string"), F.lit(" files")))
    return rows.agg(F.array_join(F.array_sort(F.collect_list(F.struct("path", label.alias("label"))))["label"], ", ")).first()[0] or ""


def raw_conversation(scanned: DataFrame, conv_id: str) -> str | None:
    """The untouched element with this id (either field): the newest, the first of equal ones."""
    hits = scanned.where((F.col("idx") >= 0) & ((F.col("raw_id") == conv_id) | (F.col("raw_other_id") == conv_id)))
    row = hits.orderBy(F.coalesce("raw_time", F.lit(float("-inf"))).desc(), "path", "entry_no", "idx").select("raw").limit(1).collect()
    return row[0].raw if row else None
