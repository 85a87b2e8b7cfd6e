"""Substring removal over words: difference-cover anchors (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.repeats import WORDS, remove_repeats

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def by_document(block, copies: np.ndarray, runs: tuple, offsets: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """Removed runs of each document, counted from its own first unit."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(block))]
    for d, a, b in zip(*(x.tolist() for x in runs), strict=True):
        out[d].append((a - int(offsets[d]), b - int(offsets[d])))
    n = np.diff(offsets)
    for d in np.nonzero(copies & (n >= window))[0].tolist():
        out[d] = [(0, int(n[d]))]
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """Removes words covered by ``window`` words that also start in a document with a smaller id.

    Returns a row for each input row: doc_id, n_words, n_removed, spans (removed runs, in words) and kept (the words
    that stay, joined by one space).  Null text: no words.  Null id: the row comes back whole and is no evidence
    against others.  Rows with one id are not earlier than each other.  Fewer words than ``window``: nothing goes.
    Other columns are not read.  Empty table: no rows.
    """

    def rows(block, copies, runs, offsets):
        spans = by_document(block, copies, runs, offsets, window)
        n = np.diff(offsets)
        kept = []
        for i, gone in enumerate(spans):
            words = block.text(i).split()
            for a, b in reversed(gone):
                del words[a:b]
            kept.append(b" ".join(words))
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64(), mask=~block.known),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPAN),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    if window < 8:
        raise ValueError("window: 8 words at least, a cover period of 7 and an anchor of two words")
    return remove_repeats(docs, id_col, text_col, WORDS(window), rows, SCHEMA, block_bytes)
