"""Benchmark decontamination by a generalised suffix automaton of test items (operator 8).

Items and documents are lower-cased (A-Z) and cut to words.  The automaton accepts every word sequence inside an
item.  Training words are streamed through it, keeping the length of the longest match that ends at each word; where
that reaches ``window`` words, or a whole shorter item, the words under it are hit.

The automaton's size follows the benchmark, not the corpus.  Items are dealt to parts of at most ``part_words``
words, in order of their ids, and each part has an automaton of its own (a bounded broadcast).  A task takes up some
documents and meets them with one automaton after the other, each loaded when its turn comes and let go after it, so a
larger benchmark costs passes, but a task never holds more than one automaton and the documents it took up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.batches import lean, small

#: Fixed by the contract: what separates words, after A-Z are lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, text string"


def words(text: str) -> list[bytes]:
    """Words in UTF-8, where lower() changes A-Z only and the pattern takes all of a character beyond ASCII."""
    return WORD.findall(text.encode().lower())


class Automaton:
    """States of the generalised suffix automaton: length, link, and next states by word number."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(item, [self.number.setdefault(w, len(self.number)) for w in ws]) for item, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self.extend(last, w)
        # items by the state and length of their windows
        self.items: dict[tuple[int, int], set[str]] = {}
        for item, ws in coded:
            n = min(window, len(ws))
            state = size = 0
            for w in ws:
                state, size = self.step(state, size, w)
                if size >= n:
                    self.items.setdefault((self.at_length(state, n), n), set()).update([] if item is None else [item])
        self.short = sorted({n for _, n in self.items if n < window})
        self.reach: dict[int, int] = {}
        pairs = np.array(sorted({(a << 32) | b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)}), np.int64)
        self.pairs = pairs

    def extend(self, last: int, w: int) -> int:
        """Adds a word behind state ``last``; several items share states."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self.split(last, w, q)
        new = self.state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[q := nxt[p][w]] == length[p] + 1:
            link[new] = q
        else:
            link[new] = self.split(p, w, q)
        return new

    def state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append({})
        return len(self.length) - 1

    def split(self, p: int, w: int, q: int) -> int:
        clone = self.state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """State and length of the longest match that ends at ``w``."""
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, size + 1)

    def at_length(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that is as long at least."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Windows of items in a document, as word ranges, and the items they are of."""
        code = np.fromiter(map(self.number.get, ws, [-1] * len(ws)), np.int64, len(ws))
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in self.runs(code):
            state = size = 0
            for i, w in enumerate(code[a:b].tolist(), a):
                state, size = self.step(state, size, w)
                if size >= self.window:
                    found.append((i + 1 - self.window, i + 1))
                    items |= self.items[self.at_length(state, self.window), self.window]
                for n in self.short:
                    if n > size:
                        break
                    if (of := self.items.get((self.at_length(state, n), n))) is not None:
                        found.append((i + 1 - n, i + 1))
                        items |= of
        return found, items

    def runs(self, code: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches whose neighbouring words are neighbours in some item, long enough for a window: no match of
        two words or more leaves such a stretch."""
        least = min([self.window, *self.short])
        if least < 2:
            yield 0, len(code)
            return
        if len(code) < least or not len(self.pairs):
            return
        key = (code[:-1] << 32) | code[1:]
        slot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[slot] == key) & (code[:-1] >= 0) & (code[1:] >= 0)
        edge = np.nonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))[0]
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + 1 >= least:
                yield a, b + 1


TAKEN_UP = 32 << 20  # bytes of text that meet an automaton at a time, where there are several


def parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_words: int) -> Iterator[Automaton]:
    """One after the other; the driver holds one at a time, and a partition of the items."""
    chunk: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        ws = words(row["t"])
        if ws:
            if chunk and size + len(ws) > part_words:
                yield Automaton(chunk, window)
                chunk, size = [], 0
            chunk.append((row["i"], ws))
            size += len(ws)
    yield Automaton(chunk, window)


def taken_up(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """Small batches, or joined up to ``TAKEN_UP``."""
    some: list[pa.RecordBatch] = []
    for batch in small(batches):
        if not several:
            yield batch
            continue
        some.append(batch)
        if sum(b.nbytes for b in some) >= TAKEN_UP:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_length: int = 0, max_coverage: float = 0.0, part_words: int = 500_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Finds words of documents inside benchmark windows and removes the spans that exceed the limits.

    A window is ``window`` consecutive words of an item, or a whole shorter item.  A document loses its hit spans
    (runs of hit words, with what lies between them) if a span has more than ``max_length`` words or hit words are
    more than ``max_coverage`` of all; both limits are 0 here, so any hit is removed.

    Returns a row for each input row: doc_id, n_words, n_hit, items (ids with occurring windows, sorted as strings),
    spans (hit runs, in words) and text (what is left).  Null texts have no words; the text comes back null.  Items
    with null id count as hits but are not listed; items with the same id count once.  The columns named in ``carry`` come along
    as c_ and their name; others are not read.  Empty tables: no rows, or no hits.
    """
    sc = docs.sparkSession.sparkContext
    kept = [f"c_{c}" for c in carry]
    more = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, carry, strict=True))
    shared = [sc.broadcast(a) for a in parts(benchmark, item_col, item_text, window, part_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken_up(batches, len(shared) > 1):
            texts = batch.column("text").to_pylist()
            n = [0] * len(texts)
            flat: list[list[int]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            for b in shared:
                automaton = b.value
                for i, t in enumerate(texts):
                    ws = words(t or "")
                    n[i] = len(ws)
                    found, of = automaton.scan(ws)
                    flat[i] += (x for span in found for x in span)
                    items[i] |= of
                if len(shared) > 1:
                    del automaton, b._value  # it is read from the task's own copy of the broadcast when it is needed again
            spans = [union(f) for f in flat]
            left = [cut(t, s, k, max_length, max_coverage) for t, s, k in zip(texts, spans, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPAN), pa.array(left, pa.string()), *(batch.column(c) for c in kept)],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "text", *kept],
            )

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in zip(kept, carry, strict=True)))
    return own.mapInArrow(lean(run), SCHEMA + more)


def cut(text: str | None, spans: list[tuple[int, int]], n_words: int, max_length: int, max_coverage: float) -> str | None:
    """The text without its hit spans, if they exceed the limits."""
    if not spans or (max(b - a for a, b in spans) <= max_length and sum(b - a for a, b in spans) <= max_coverage * n_words):
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    edges = [0, *(x for a, b in spans for x in (at[a][0], at[b - 1][1])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()


def union(flat: list[int]) -> list[tuple[int, int]]:
    """Runs of words under ranges that come as start, end, start, end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
