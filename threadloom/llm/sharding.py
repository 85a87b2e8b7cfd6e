"""Contiguous shards of near-equal byte size (operator 5).

Rows are put in order once and written; from then on only totals of partitions reach the driver.  Running totals of
these give every partition the bytes that lie before it, so each task can place its own rows: a row goes to the shard
in whose equal share of all bytes its middle byte falls.  A second total, of rows by partition and shard, gives slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpointed

SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint"


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deals all rows into ``shards`` contiguous shards of near-equal bytes, in order of id, checksum and size.

    A row's size is its text's UTF-8 bytes plus ``overhead``.  Returns a row for each input row: doc_id, size,
    text_crc32 (unsigned), shard (from 0) and slot (its place in the shard, from 0, without gaps).  A shard differs
    from an equal share by less than the largest row.  Null texts count no bytes and have the checksum of an empty
    text; null ids come first; equal rows are neighbours.  Where rows are few or large, shards may stay empty.  Only
    these three values of a row travel, never its text; other columns are not read.  Empty table: no rows.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("shards and overhead: 1 at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"))
    key = ["doc_id", "text_crc32", "size"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(rows.repartitionByRange(tasks, *key).sortWithinPartitions(*key))
    ordered = ordered.withColumn("part", F.spark_partition_id())

    totals = sorted(ordered.groupBy("part").agg(F.sum("size")).collect())  # a row for each partition
    whole = sum(t for _, t in totals)
    ends = np.cumsum([t for _, t in totals], dtype=np.int64)
    before = {p: int(e - t) for (p, t), e in zip(totals, ends, strict=True)}
    # a shard begins at the first row whose middle, doubled, reaches this
    begins = np.array([-(-2 * whole * s // shards) for s in range(1, shards)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if len(batch) == 0:
                continue
            if done is None:
                done = before[batch.column("part")[0].as_py()]
            size = batch.column("size").to_numpy()
            end = done + np.cumsum(size)
            shard = np.searchsorted(begins, 2 * end - size, side="right").astype(np.int32)
            done = int(end[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "part")), pa.array(shard)], names=[*key, "part", "shard"])

    placed = ordered.mapInArrow(place, "doc_id bigint, text_crc32 bigint, size bigint, part int, shard int")
    first: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for part, shard, n in sorted(tuple(r) for r in placed.groupBy("part", "shard").agg(F.count("*")).collect()):  # partitions + shards rows
        first[part, shard] = seen.get(shard, 0)
        seen[shard] = first[part, shard] + n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            if len(batch) == 0:
                continue
            part, shard = batch.column("part")[0].as_py(), batch.column("shard").to_numpy()
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                own = np.nonzero(shard == s)[0]
                start = at.setdefault(s, first[part, s])
                slot[own] = start + np.arange(len(own))
                at[s] = start + len(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("shard"), pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(number, SCHEMA)
