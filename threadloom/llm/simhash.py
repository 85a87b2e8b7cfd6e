"""SimHash near-duplicates through a Gray-order hierarchical index (operator 9).

Fingerprints come from word shingles.  Equal ones are one node from the start, however many documents share it.  Two
fingerprints that differ in 3 bits at most agree in one of four 16-bit blocks, so each is dealt to four keys; a key
that too many share is dealt again by the four parts of its other bits, and so on until the bits run out, by when no
key can have too many.  Within a task the fingerprints of a key are sorted by Gray rank, which puts neighbours in Hamming space together; runs of 16 and of 256 become nodes that keep
the bits all their members share (the parent's bits are left out of the child's), and a query walks down adding up
differences to such patterns, dropping whole runs once there are more than 3.  What a task finds leaves it as a
forest, not as pairs; alternating star steps join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.batches import small
from threadloom.session import checkpointed

BLOCKS = 4
BUSY = 20_000  # fingerprints of one key beyond which it is dealt again


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, with repeats; a shorter text is one run, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([h(joined, 42)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((h(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:], strict=False)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """As the contract has it: shingles with repeats, a bit is set if in over half of their hashes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place in the Gray code's order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Index over fingerprints of several keys; a query meets only runs of its own key."""

    def __init__(self, key: np.ndarray, fps: np.ndarray, sizes: tuple[int, int] = (256, 16)):
        order = np.lexsort((gray_rank(fps), key))
        self.key, self.fp = key[order], fps[order]
        n = len(fps)
        new = np.append(True, self.key[1:] != self.key[:-1])[:n]
        self.first = np.nonzero(new)[0]
        self.run = np.cumsum(new) - 1  # of which key each member is
        self.levels = [self.level(np.arange(n) - self.first[self.run], s) for s in sizes]
        # a child keeps only the bits that its parent doesn't share already
        upper, lower = self.levels
        parent = np.searchsorted(upper["start"], lower["start"], side="right") - 1
        lower["mask"] &= ~upper["mask"][parent]
        edge = np.searchsorted(lower["start"], np.append(upper["start"], n))
        upper["child"], upper["children"] = edge[:-1], np.diff(edge)
        lower["child"], lower["children"] = lower["start"], np.diff(np.append(lower["start"], n))
        top = np.searchsorted(upper["start"], np.append(self.first, n))
        self.top, self.tops = top[:-1], np.diff(top)

    def level(self, place: np.ndarray, size: int) -> dict[str, np.ndarray]:
        start = np.nonzero(place % size == 0)[0]
        if not len(start):
            return {"start": start, "mask": np.zeros(0, np.uint64), "bits": np.zeros(0, np.uint64)}
        ones = np.bitwise_and.reduceat(self.fp, start)
        some = np.bitwise_or.reduceat(self.fp, start)
        return {"start": start, "mask": ~(ones ^ some), "bits": ones}

    def pairs(self, within: int, batch: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of a key that differ in ``within`` bits at most, as places i < j."""
        n = len(self.fp)
        for a in range(0, n, batch):
            q = np.arange(a, min(n, a + batch))
            who, node = fan(q, self.top[self.run[q]], self.tops[self.run[q]])
            add = np.zeros(len(who), np.int64)
            for level in self.levels:
                ends = np.append(level["start"][1:], n)
                add = add + np.bitwise_count((self.fp[who] ^ level["bits"][node]) & level["mask"][node])
                live = (add <= within) & (ends[node] > who + 1)
                who, node, add = who[live], node[live], add[live]
                slot, kids = fan(np.arange(len(who)), level["child"][node], level["children"][node])
                who, node, add = who[slot], kids, add[slot]
            live = (node > who) & (np.bitwise_count(self.fp[who] ^ self.fp[node]) <= within)
            yield who[live], node[live]


def fan(who: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``who`` with first, first + 1, ... of so many."""
    total = int(count.sum())
    out = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(total) if total else np.zeros(0, np.int64)
    return np.repeat(who, count), out


def forest(fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs enough to connect all that the pairs connect: less than one for each fingerprint, found batch by batch."""
    nodes, slot = np.unique(fps, return_inverse=True)
    root = np.arange(len(nodes))
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in pairs:
        a, b = slot[i], slot[j]
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(root, high, low)
            hooked = np.nonzero(root[high] == low)[0]  # one of these pairs for each root that was hooked
            hooked = hooked[np.unique(high[hooked], return_index=True)[1]]
            kept.append((a[hooked], b[hooked]))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(k[x] for k in kept)]) for x in (0, 1))
    return nodes[a], nodes[b]


def links(nodes: DataFrame, within: int = 3) -> DataFrame:
    """A forest over distinct fingerprints ``fp`` for each table of a task: columns a and b, which are near pairs."""
    if within >= BLOCKS:
        raise ValueError(f"within: {BLOCKS - 1} at most, else no block need agree")
    # a key is a hash of all choices so far; ``rest`` are the bits that no choice has used, ``bits`` of them
    open_ = nodes.select("fp", F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest"))
    bits, ready = 64, None
    while True:
        cuts = [bits * i // BLOCKS for i in range(BLOCKS + 1)]

        def part(i: int):
            a, b = cuts[i], cuts[i + 1]  # noqa: B023
            value = F.shiftrightunsigned("rest", a).bitwiseAND((1 << b - a) - 1)
            below, above = F.col("rest").bitwiseAND((1 << a) - 1), F.shiftleft(F.shiftrightunsigned("rest", b), a) if b < 64 else F.lit(0).cast("bigint")
            return F.struct(F.xxhash64("key", F.lit(bits), F.lit(i), value).alias("key"), below.bitwiseOR(above).alias("rest"))  # noqa: B023

        dealt = open_.select("fp", F.explode(F.array(*map(part, range(BLOCKS)))).alias("k")).select("fp", "k.key", "k.rest")
        bits -= bits // BLOCKS  # what is left, at most
        busy = checkpointed(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUSY).select("key"))
        if bits <= 2 * BLOCKS or not busy.limit(1).count():
            ready = dealt.select("fp", "key") if ready is None else ready.unionByName(dealt.select("fp", "key"))
            break
        usual = dealt.join(busy, "key", "left_anti").select("fp", "key")
        ready = usual if ready is None else ready.unionByName(usual)
        open_ = dealt.join(busy, "key", "left_semi").select("fp", "key", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            index = GrayIndex(t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64))
            a, b = forest(index.fp, index.pairs(within))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows in order of their keys as tables of ``least`` rows or a little more that end where a key does."""
    some: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if held >= least and len(batch):
            key = batch.column("key").to_numpy()
            own = int(np.searchsorted(key, some[-1].column("key")[-1].as_py(), side="right"))
            some.append(batch.slice(0, own))
            if own == len(batch):
                held += own
                continue
            yield pa.Table.from_batches(some).combine_chunks()
            some, held, batch = [], 0, batch.slice(own)
        if len(batch):
            some.append(batch)
            held += len(batch)
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """Roots of connected nodes: columns node and root (the smallest node), without nodes that are roots.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared folder.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = signature(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        e = checkpointed(small.where("u != v").distinct())
        now = signature(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, within: int = 3) -> DataFrame:
    """Classes of documents whose fingerprints are linked, directly or through others.

    Returns a row for each input row: doc_id, fp (signed long) and component_id (smallest doc_id that can be reached).
    Null and empty texts have fingerprint zero and link like any other.  Rows with one id keep a row each.  Null ids
    stay null and are never a component's id, which is null only if all ids in it are.  Other columns are not read.
    Empty table: no rows.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), within))
    rooted = checkpointed(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")
