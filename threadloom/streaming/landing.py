"""Exports that arrive in a folder, read as a stream with the same scan as single files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.export import MAX_UNPACKED, scan

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_exports(spark: SparkSession, folder: str, max_unpacked_bytes: int = MAX_UNPACKED, files_a_batch: int = 16) -> DataFrame:
    """Scanned rows of new files; errors of a file are rows, so one bad file doesn't stop the stream.  In
    foreachBatch, ``assemble`` turns a batch into conversations and nodes."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return scan(files, max_unpacked_bytes)
