"""Repeated byte strings by a difference cover (operator 7).

This is the engine of operator 3 over bytes: 20-byte anchors at cover positions modulo 31, then the 50-byte windows
around shared ones.  Only equality of the first 50 bytes of suffixes matters to the result, so suffixes are never sorted
to their ends: there is no recursion on names and no comparison of neighbours in a suffix array.  README says what a
full suffix array costs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.repeats import BYTES, remove_repeats
from threadloom.llm.substring import SPAN, by_document

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """Removes bytes covered by ``window`` bytes that also start in a document with a smaller id.

    Returns a row for each input row: doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes of UTF-8) and
    kept (what stays, as bytes: a cut may fall inside a character).  Null text: empty.  Null id: the row comes back
    whole and is no evidence against others.  Rows with one id are not earlier than each other.  Other columns are
    not read.  Empty table: no rows.
    """

    def rows(block, copies, runs, offsets):
        spans = by_document(block, copies, runs, offsets, window)
        kept = []
        for i, gone in enumerate(spans):
            text = block.text(i)
            edges = [0, *(x for span in gone for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64(), mask=~block.known),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPAN),
            "kept": pa.array(kept, pa.binary()),
        })

    if window < 38:
        raise ValueError("window: 38 bytes at least, a cover period of 31 and an anchor of eight bytes")
    return remove_repeats(docs, id_col, text_col, BYTES(window), rows, SCHEMA, block_bytes)
