"""Document blocks and key exchanges shared by the repeat-removal operators.

Documents travel once, in blocks of neighbouring ids, as compressed payloads; every later step of an operator
reads the same shuffled blocks (Spark reuses the exchange).  What blocks tell each other are sorted key lists,
dealt over key buckets, and the answer to a list is one bit for each key:

    block g --(sorted keys of bucket b)--> bucket b --(one bit a key)--> block g

A block sends each key once however often it occurs, so a very frequent key costs a bucket at most one entry for
each block and no bucket or block grows with a group of copies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "g bigint, payload binary"
LISTS = "b bigint, g bigint, keys binary"
ANSWERS = "g bigint, b bigint, bits binary"
AT_ONCE = 1 << 20  # keys of a bucket that are sorted together


class Layout:
    """How documents are cut into blocks and keys into buckets; fixed by the size of the whole table.

    Blocks are ranges of ids; ``ways`` of a range is how many blocks share it, which is more than one only for a range
    that is a single id with very many rows.  A block's rank is the place of its range.
    """

    def __init__(self, cuts: list[int], ways: list[int], buckets: int, total_bytes: int):
        self.cuts, self.ways = np.array(cuts, np.int64), np.array(ways, np.int64)
        self.first = np.cumsum(self.ways) - self.ways
        self.blocks, self.buckets, self.total_bytes = int(self.ways.sum()), buckets, total_bytes

    def bounds(self, bits: int) -> np.ndarray:
        """First key of each bucket, in a key space of so many bits."""
        return np.array([-(-(i << bits) // self.buckets) for i in range(self.buckets)], np.uint64)

    def rank(self, blocks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, blocks, side="right") - 1


def layout(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 8 << 20) -> Layout:
    """Cut points over ``id_col`` so that blocks hold about ``block_bytes`` of text.

    ``block_bytes`` is a least size: it grows with the root of the table from 70 GB of text on (0.4 GB at 100 TB), which
    keeps the number of (block, bucket) lists in proportion to the input.  The driver holds a long for each block.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    size = max(block_bytes, math.isqrt(total * 1_000))
    blocks = max(1, -(-total // size))
    found: Counter[int] = Counter()
    if blocks > 1:
        at = [i / blocks for i in range(1, blocks)]
        row = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), at, max(10_000, 4 * blocks))).first()
        found.update(row[0] or [])
    # an id at several cut points has as many blocks to itself
    hot = {v: n + 1 for v, n in found.items() if n > 1}
    cuts = sorted({*found, *(v - 1 for v in hot)})
    return Layout(cuts, [*(hot.get(v, 1) for v in cuts), 1], max(1, -(-total // (4 * size))), total)


def pack(docs: DataFrame, id_col: str, text_col: str, lay: Layout) -> DataFrame:
    """Rows ``(g, payload)``: the documents of one input batch that belong to block ``g``, compressed; ids aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0)
            rank = np.searchsorted(lay.cuts, ids.to_numpy(zero_copy_only=False), side="left")
            g = lay.first[rank]
            for i in np.nonzero(lay.ways[rank] > 1)[0].tolist():
                g[i] += xxhash.xxh3_64_intdigest(batch.column(1)[i].as_py().encode()) % int(lay.ways[rank[i]])
            table = pa.table({"id": ids, "t": batch.column(1).cast(pa.large_binary())})
            order = np.argsort(g, kind="stable")
            edges = np.nonzero(np.diff(g[order], prepend=-1))[0]
            out_g, out_p = [], []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                part = table.take(pa.array(order[a:b])).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                out_g.append(int(g[order[a]]))
                out_p.append(z.compress(sink.getvalue().to_pybytes()))
            if out_g:
                yield pa.RecordBatch.from_arrays([pa.array(out_g, pa.int64()), pa.array(out_p, pa.binary())], names=["g", "payload"])

    return named(docs, id_col, text_col).where("id is not null").mapInArrow(run, PACKED).repartition(lay.blocks, "g")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


class Block:
    """Some documents, sorted by id and then text; a known id is one that isn't null."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("t", "ascending")]).combine_chunks()
        ids, text = (table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.column(c).type) for c in ("id", "t"))
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8) if len(text) else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def unpacked(payloads: pa.ChunkedArray) -> Block:
    z = zstandard.ZstdDecompressor()
    return Block(pa.concat_tables([pa.ipc.open_stream(z.decompress(p.as_py())).read_all() for p in payloads]))


class Keys:
    """Keys in order: a hash of 64 bits, and ``more`` bits in whole bytes of a second one that tell equal ones apart."""

    def __init__(self, h: np.ndarray, x: np.ndarray | None = None):
        self.h, self.x = h, x

    def __len__(self) -> int:
        return len(self.h)

    def order(self) -> np.ndarray:
        return np.argsort(self.h, kind="stable") if self.x is None else np.lexsort((self.x, self.h))

    def take(self, at: np.ndarray | slice) -> Keys:
        return Keys(self.h[at], None if self.x is None else self.x[at])

    def news(self) -> np.ndarray:
        """Of keys in order: which differ from the one before."""
        new = self.h[1:] != self.h[:-1]
        if self.x is not None:
            new |= self.x[1:] != self.x[:-1]
        return np.append(True, new)[: len(self.h)]

    def distinct(self) -> Keys:
        if self.x is None:  # numpy's own unique() hashes, which takes many times as long here
            s = Keys(np.sort(self.h))
        else:
            s = self.take(self.order())
        return s.take(s.news())


def second(more: int) -> type:
    """The smallest type for so many bytes of a second hash."""
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize >= more)


def joined(parts: list[Keys]) -> Keys:
    return Keys(np.concatenate([p.h for p in parts]), None if parts[0].x is None else np.concatenate([p.x for p in parts]))


def encode(keys: Keys, more: int) -> bytes:
    """Sorted keys as compressed byte planes: differences of the first hashes, ``more`` bytes of the second ones."""
    planes = [np.diff(keys.h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T]
    if more:
        planes.append(keys.x.view(np.uint8).reshape(len(keys), -1)[:, :more].T)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def decode(blob: bytes, more: int) -> Keys:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8 + more, -1)
    h = np.cumsum(np.ascontiguousarray(raw[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    if not more:
        return Keys(h)
    x = np.zeros((len(h), np.dtype(second(more)).itemsize), np.uint8)
    x[:, :more] = raw[8:].T
    return Keys(h, x.view(second(more)).ravel())


def lists(g: int, keys: Keys, bounds: np.ndarray, more: int = 0) -> pa.Table:
    """The lists that block ``g`` sends: ``keys`` are sorted and distinct."""
    at = np.append(np.searchsorted(keys.h, bounds), len(keys))
    some = [i for i in range(len(bounds)) if at[i] < at[i + 1]]
    return pa.table({
        "b": pa.array(some, pa.int64()),
        "g": pa.array([g] * len(some), pa.int64()),
        "keys": pa.array([encode(keys.take(slice(at[i], at[i + 1])), more) for i in some], pa.binary()),
    })


def answer(sent: DataFrame, lay: Layout, earlier: bool, more: int = 0) -> DataFrame:
    """One bit for each key sent: does a block of a lower rank (``earlier``) or any other block (else) have it too?

    Buckets are few and unequal in where their hashes fall, so there are four times as many tasks; most are empty.  A
    bucket's keys are looked at in ranges of about ``AT_ONCE``, so that besides the lists themselves only bits grow.
    """
    at_once = AT_ONCE

    def run(table: pa.Table) -> pa.Table:
        gs = table.column("g").to_numpy()
        blobs = table.column("keys").combine_chunks()
        rank = lay.rank(gs)
        order = np.argsort(rank, kind="stable")
        parts, rank = [decode(blobs[int(i)].as_py(), more) for i in order], rank[order]
        bits = [np.empty(len(p), bool) for p in parts]
        total = sum(map(len, parts))
        step = max(1, total // (64 * max(1, total // at_once)))
        some = np.sort(np.concatenate([p.h[::step] for p in parts]))
        cuts = some[63::64] if total > at_once else some[:0]
        edges = [np.concatenate([[0], np.searchsorted(p.h, cuts), [len(p)]]) for p in parts]
        for r in range(len(cuts) + 1):
            own = [slice(e[r], e[r + 1]) for e in edges]
            keys = joined([p.take(s) for p, s in zip(parts, own, strict=True)])
            by = keys.order()  # stable, so a run of equal keys begins with its lowest rank
            new = keys.take(by).news()
            start = np.nonzero(new)[0]
            count = np.diff(np.append(start, len(by)))
            if earlier:
                of = np.repeat(rank, [s.stop - s.start for s in own])[by]
                hit = of > np.repeat(of[start], count)
            else:
                hit = np.repeat(count > 1, count)
            found = np.empty(len(by), bool)
            found[by] = hit
            at = 0
            for b, s in zip(bits, own, strict=True):
                b[s] = found[at : at + s.stop - s.start]
                at += s.stop - s.start
        return pa.table({
            "g": pa.array(gs[order], pa.int64()),
            "b": pa.array([table.column("b")[0].as_py()] * len(order), pa.int64()),
            "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
        })

    return sent.repartition(4 * lay.buckets, "b").groupBy("b").applyInArrow(run, ANSWERS)


def told(keys: Keys, bounds: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answer to each of ``keys``, which are those that were sent."""
    at = np.append(np.searchsorted(keys.h, bounds), len(keys))
    out = np.zeros(len(keys), bool)
    bits = answers.column("bits")
    for i, b in enumerate(answers.column("b").to_pylist()):
        n = at[b + 1] - at[b]
        out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), count=n).astype(bool)
    return out


def per_block(packed: DataFrame, lay: Layout, run: Callable, schema: str, *answers: DataFrame) -> DataFrame:
    """``run(g, block, answers...)`` for every block, with what was told to it; a task for each block or so."""
    if not answers:
        return packed.groupBy("g").applyInArrow(lambda key, t: run(key[0].as_py(), unpacked(t.column("payload"))), schema)
    kinds = len(answers)
    both = answers[0].withColumn("kind", F.lit(0))
    for i, a in enumerate(answers[1:], 1):
        both = both.unionByName(a.withColumn("kind", F.lit(i)))

    def step(key, t: pa.Table, told_: pa.Table) -> pa.Table:
        kind = told_.column("kind").to_numpy()
        return run(key[0].as_py(), unpacked(t.column("payload")), *(told_.filter(pa.array(kind == i)) for i in range(kinds)))

    return packed.groupBy("g").cogroup(both.repartition(lay.blocks, "g").groupBy("g")).applyInArrow(step, schema)
