"""Exact removal of windows that also start in a document with a smaller id.

A text is a sequence of units (words or bytes).  A unit goes if a window of ``window`` consecutive units covers it
whose sequence also starts in a document with a smaller id.  The work is bounded by a difference cover D modulo a
period v: for any two positions there is a shift below v that brings both to residues in D.  So whenever two
documents share a window, they share a shorter anchor of ``window - v + 1`` units that starts at cover positions of
both, and only |D| of v positions need to be compared over the whole corpus.  Windows are formed just where such an
anchor, met in two documents, can lie inside them, and only these are compared in full.

Steps, each a step over blocks of documents (``blocks.py``):
 1. whole texts: copies of an earlier text are settled at once and take no further part;
 2. anchors at cover positions, cut to few bits, against all other blocks: false hits only cost work;
 3. windows around shared anchors against earlier blocks;
 4. the answers are united to maximal runs of units.

Whole texts are compared by 128 bits.  Windows are compared by twice as many bits as the number of bytes in the table
has, and eight more: whatever the size of the table, the chance that a single window of it is taken for another is
under 1 in 500.  Words are 128-bit hashes throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from threadloom.llm import blocks as B

#: Perfect difference sets (fixed mathematical values): residues and their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all of them."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def in_parts(hashes: Callable, units: np.ndarray, at: np.ndarray, n: int, more: int = 0, part: int = 1 << 19) -> np.ndarray:
    """``hashes`` of many positions without arrays as long as these on the way; ``more``: so many bytes of the second."""
    out = np.empty(len(at), B.second(more) if more else np.uint64)
    for i in range(0, len(at), part):
        h = hashes(units, at[i : i + part], n, int(more > 0))
        out[i : i + part] = h & np.uint64((1 << 8 * more) - 1) if more else h
    return out


@dataclass(frozen=True)
class Spec:
    """window: units; period: of the cover; units: from a block to its units and where each document's begin;
    hashes: of so many units from each of some positions, in two lanes that are independent of each other."""

    window: int
    period: int
    units: Callable[[B.Block], tuple[np.ndarray, np.ndarray]]
    hashes: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def word_units(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash for each word, in two lanes; words end at ASCII white space, which is where bytes.split() cuts."""
    h = xxhash.xxh3_128_digest
    out, counts = [], [0]
    for i in range(len(block)):
        words = block.text(i).split()
        out.append(b"".join(map(h, words)))
        counts.append(len(words))
    return np.ascontiguousarray(np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2).T), np.cumsum(counts)


def word_hashes(units: np.ndarray, at: np.ndarray, n: int, lane: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += units[lane][at + j] * MIX[j]
        h ^= h >> np.uint64(29)
    return scramble(h)


def byte_units(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.offsets


def byte_hashes(units: np.ndarray, at: np.ndarray, n: int, lane: int) -> np.ndarray:
    """n is 8 at least: eight bytes at a time, the last ones overlapping."""
    words = np.ndarray((max(0, len(units) - 7),), np.uint64, units, 0, (1,))
    h = np.zeros(len(at), np.uint64)
    for j, k in enumerate([*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]):
        h += words[at + k] * MIX[128 * lane + j]
        h ^= h >> np.uint64(29)
        h *= MIX[128 * lane + 64 + j]
    return scramble(h)


WORDS = lambda window: Spec(window, 7, word_units, word_hashes)
BYTES = lambda window: Spec(window, 31, byte_units, byte_hashes)


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals whose starts and ends both rise."""
    if not len(starts):
        return starts, ends
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.nonzero(new)[0][1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of disjoint intervals."""
    n = ends - starts
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


class Work:
    """One block's share; the same calls give the same keys in every step."""

    def __init__(self, spec: Spec, block: B.Block, key_bits: int, more: int):
        self.spec, self.block, self.bits, self.more = spec, block, key_bits, more

    def texts(self) -> B.Keys:
        """A hash of each whole text."""
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.block.text(i), 7) for i in range(len(self.block))), np.uint64).reshape(-1, 2)
        return B.Keys(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))

    def text_keys(self) -> B.Keys:
        return self.texts().distinct()

    def copies(self, answers: pa.Table, bounds: np.ndarray) -> np.ndarray:
        """Which documents have the text of an earlier one."""
        texts = self.texts()
        order = texts.order()
        new = texts.take(order).news()
        earlier = B.told(texts.take(order[new]), bounds, answers)
        start = np.nonzero(new)[0]
        count = np.diff(np.append(start, len(order)))
        ids = self.block.ids[order]
        out = np.zeros(len(order), bool)
        if len(order):
            out[order] = np.repeat(earlier, count) | (ids > np.repeat(np.minimum.reduceat(ids, start), count))
        return out

    def load(self, copies: np.ndarray) -> None:
        self.units, self.offsets = self.spec.units(self.block)
        n = np.diff(self.offsets)
        self.docs = np.nonzero((n >= self.spec.window) & ~copies)[0]
        self.first, self.end = self.offsets[self.docs], self.offsets[self.docs + 1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and their keys."""
        s = self.spec
        longest = int((self.end - self.first).max(initial=0))
        grid = np.nonzero(np.isin(np.arange(longest) % s.period, COVERS[s.period]))[0]
        fits = np.searchsorted(grid, self.end - self.first - s.anchor, side="right")
        at = np.concatenate([*(grid[:k] + a for a, k in zip(self.first, fits, strict=True)), np.zeros(0, np.int64)]).astype(np.int64)
        return at, in_parts(s.hashes, self.units, at, s.anchor) >> np.uint64(64 - self.bits)

    def windows(self, answers: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, B.Keys]:
        """Positions of windows that another document may have, and their keys."""
        s = self.spec
        at, keys = self.anchors()
        own, count = np.unique(keys, return_counts=True)
        wanted = own[B.told(B.Keys(own), bounds, answers) | (count > 1)]
        flags = np.zeros(1 << 20, bool)
        flags[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        near = np.nonzero(flags[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        if len(wanted):
            slot = np.minimum(np.searchsorted(wanted, keys[near]), len(wanted) - 1)
            near = near[wanted[slot] == keys[near]]
        at = at[near]
        doc = np.searchsorted(self.first, at, side="right") - 1
        lo, hi = np.maximum(at - s.period + 1, self.first[doc]), np.minimum(at, self.end[doc] - s.window) + 1
        keep = lo < hi
        p = spread(*united(lo[keep], hi[keep]))
        h = in_parts(s.hashes, self.units, p, s.window)
        if not self.more:
            return p, B.Keys(h)
        return p, B.Keys(h, in_parts(s.hashes, self.units, p, s.window, self.more))

    def removed(self, answers: pa.Table, windows: tuple, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of units to remove: which document, from, to (within the block's units)."""
        p, keys = windows
        del windows
        order = keys.order()  # positions rise with the ids, so the first of a run has the smallest
        keys = keys.take(order)
        start = np.nonzero(keys.news())[0]
        hit = B.told(keys.take(start), bounds, answers)
        del keys
        ids = self.block.ids[self.docs]
        own = ids[(np.searchsorted(self.first, p, side="right") - 1)[order]]
        count = np.diff(np.append(start, len(order)))
        gone = np.repeat(hit, count) | (own > np.repeat(own[start], count))
        p = np.sort(p[order[gone]])
        del order, own, gone
        doc = np.searchsorted(self.first, p, side="right") - 1
        if not len(p):
            return doc, p, p
        ends = p + self.spec.window
        new = np.append(True, (p[1:] > ends[:-1]) | (doc[1:] != doc[:-1]))
        last = np.append(np.nonzero(new)[0][1:] - 1, len(p) - 1)
        return self.docs[doc[new]], p[new], ends[last]


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, spec: Spec, rows: Callable, schema: str, block_bytes: int = 8 << 20) -> DataFrame:
    """``rows(block, copies, runs, offsets)`` makes the result of a block; runs: arrays of document, from and to."""
    lay = B.layout(docs, id_col, text_col, block_bytes)
    size = int(max(1, lay.total_bytes)).bit_length()
    bits = min(64, max(24, size + 9))
    more = min(8, max(0, -(-(2 * size + 8 - 64) // 8)))  # bytes of a window's second hash
    small, wide = lay.bounds(bits), lay.bounds(64)
    packed = B.pack(docs, id_col, text_col, lay)

    def work(block, same=None):
        w = Work(spec, block, bits, more)
        if same is not None:
            w.load(copies := w.copies(same, wide))
            return w, copies
        return w

    def send_texts(g, block):
        return B.lists(g, work(block).text_keys(), wide, 8)

    def send_anchors(g, block, same):
        w, _ = work(block, same)
        return B.lists(g, B.Keys(w.anchors()[1]).distinct(), small)

    def send_windows(g, block, same, near):
        w, _ = work(block, same)
        return B.lists(g, w.windows(near, small)[1].distinct(), wide, more)

    def finish(g, block, same, near, hits):
        w, copies = work(block, same)
        return rows(block, copies, w.removed(hits, w.windows(near, small), wide), w.offsets)

    def untouched(batches):
        for batch in batches:
            block = B.Block(pa.table({"id": batch.column(0), "t": batch.column(1).cast(pa.large_binary())}))
            none = np.zeros(0, np.int64)
            yield from rows(block, np.zeros(len(block), bool), (none, none, none), spec.units(block)[1]).to_batches()

    same = B.answer(B.per_block(packed, lay, send_texts, B.LISTS), lay, earlier=True, more=8)
    near = B.answer(B.per_block(packed, lay, send_anchors, B.LISTS, same), lay, earlier=False)
    hits = B.answer(B.per_block(packed, lay, send_windows, B.LISTS, same, near), lay, earlier=True, more=more)
    nameless = B.named(docs, id_col, text_col).where("id is null").mapInArrow(untouched, schema)
    return B.per_block(packed, lay, finish, schema, same, near, hits).unionByName(nameless)
