"""Near copies by the exact Jaccard similarity of word shingles, found through SimHash fingerprints first.

Fingerprints of the same shingles go through the Gray-order index of operator 9, which proposes pairs that differ in 3
bits at most; what the texts confirm is linked.  At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, so
an exact way finds the links that the index can't: two sets with a similarity of ``least`` share at least that part of
either, so in any order that is the same for all sets, the first size - ceil(least * size) + 1 members of both have one
in common.  Shingles that are common in a sample come last in that order, the most common at the end, which keeps
groups small; the order has no bearing on the result.  Documents with equal sets are one node.  A pair that shares such
a key is dropped only by bounds that hold for sure: sizes, places of the first member in common (none before it is
shared), and parities of hashed cells, which differ in no more places than the sets have members apart.  What is left
is compared in full.  In large groups that share a key, near copies are brought into one class by pivots first, members
of the largest class aren't paired with each other, and parities of a fixed number of cells are a condition of the join,
so that rows are made only of pairs that are near.  The join still looks at every other pair of such a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.batches import lean, small
from threadloom.llm.simhash import components, links, majority, shingle_hashes
from threadloom.session import discard, written

CELLS = 2048  # at least
SLOTS = 1 << 20  # of hashes of texts that are looked for
SAMPLE, PART, OFTEN, COMMON = (4_000, 40_000), 16, 3, 200_000  # fewest and most documents looked at for common shingles, part of all, least count, most shingles
PLACES = 1 << 22  # of hashes of common shingles
ROUNDS = 8  # of comparisons with pivots, before all pairs that are left are compared
CENTRAL = 8  # a pivot is the most central of one in so many members
FEW = 64  # members of a key up to which all its pairs are looked at
NEAR = 3  # bits
SEEN = 1_000_000  # sets that a task remembers


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text is one run, an empty one has none."""
    return np.unique(shingle_hashes(text, n))


def parity(members: np.ndarray) -> np.ndarray:
    """Which of the cells hold an odd number of members; cells are a power of two, and as many as members at least, so
    that long texts are told apart as well as short ones."""
    n = max(CELLS, 1 << max(0, len(members) - 1).bit_length())
    cells = np.bincount((members >> np.uint64(7)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def folded(p: Column, size: Column) -> Column:
    """Parities of half as many cells, if there are more than ``size`` words of them."""
    half = F.zip_with(F.slice(p, F.lit(1), size), F.slice(p, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(p) > size, half).otherwise(p)


def sketch(p: Column) -> Column:
    """Parities of ``CELLS`` cells."""
    n = CELLS // 64
    word = lambda i: F.aggregate(F.sequence(i, F.size(p) - 1, F.lit(n)), F.lit(0).cast("bigint"), lambda s, j: s.bitwiseXOR(F.get(p, j)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def close(percent: int) -> Column:
    """What sketches leave open, for rows with size, sketch, size_b and sketch_b."""
    apart = reduce(add, (F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(CELLS // 64)))
    return apart * (100 + percent) <= (F.col("size") + F.col("size_b")) * (100 - percent)


def prefix(members: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Members of which two sets that are similar enough share one, by level and hash."""
    n = len(members)
    if not n:
        return members
    late = level[(members % np.uint64(len(level))).astype(np.int64)]
    return members[np.argsort(late, kind="stable")][: n - -(-percent * n // 100) + 1]


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes of common shingles, and a level for each that rises with the count."""
    rows = max(1, docs.count())
    part = min(1, min(max(rows // PART, SAMPLE[0]), SAMPLE[1]) / rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [shingles(t, n).view(np.int64) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["members"])

    some = docs.select("t", "th").where(F.pmod(F.xxhash64("th"), F.lit(1_000_000)) < int(1_000_000 * part)).dropDuplicates(["th"])
    counts = some.select("t").mapInArrow(lean(run), "members array<bigint>").select(F.explode("members").alias("m")).groupBy("m").count().where(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "m").limit(COMMON).toPandas()
    places = (top["m"].to_numpy(np.int64).view(np.uint64) % np.uint64(PLACES)).astype(np.int64)
    return places, np.log2(top["count"].to_numpy(np.float64)).astype(np.uint8)


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that connect all whose fingerprints differ in ``NEAR`` bits at most, by the Gray index."""
    fps = nodes.groupBy("fp").agg(F.min("sig").alias("first"))
    equal = nodes.join(fps, "fp").where("sig != first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    near = links(fps.select("fp"), NEAR).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    for side in "ab":
        near = near.join(fps.select(F.col("fp").alias(f"fp_{side}"), F.col("first").alias(side)), f"fp_{side}")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def possible(percent: int) -> Column:
    """What sizes and places of the first member in common leave open, for rows with size, pos, size_b and pos_b."""
    both = F.col("size") + F.col("size_b")
    sized = F.least("size", "size_b") * 100 >= F.greatest("size", "size_b") * percent
    shared = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) * (100 + percent) >= both * percent
    return sized & shared & ((F.col("pos") + F.col("pos_b")) * (100 + percent) <= both * (100 - percent))


def texts_of(own: DataFrame, ids: DataFrame) -> DataFrame:
    """th and t, once each, of the texts whose hashes are in ``ids``, and of few others."""
    wanted = np.zeros(SLOTS, bool)
    wanted[ids.select(F.pmod("th", F.lit(SLOTS)).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(batches):
            keep = wanted[(th := batch.column(0).to_numpy()) % SLOTS]
            for i in np.flatnonzero(keep):
                keep[i] = th[i] not in seen
                seen.add(th[i])
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(keep))

    return own.select("th", "t").mapInArrow(lean(run), "th bigint, t string").dropDuplicates(["th"])


def similar(pairs: DataFrame, nodes: DataFrame, own: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("sig").alias(side), F.col("th").alias(f"th_{side}"), F.col("size").alias(f"n_{side}"), F.col("parity").alias(f"p_{side}")), side)
    # sizes that are near enough have cells that differ by a factor of two at most
    size = F.least(F.size("p_a"), F.size("p_b"))
    apart = F.aggregate(F.zip_with(folded(F.col("p_a"), size), folded(F.col("p_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    may = F.when(sized, apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).otherwise(False)
    pairs = could_be = written(pairs.where(may).select("a", "b", "th_a", "th_b"))
    texts = written(texts_of(own, pairs.select(F.explode(F.array("th_a", "th_b")).alias("th")).distinct()))
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("th").alias(f"th_{side}"), F.col("t").alias(f"t_{side}")), f"th_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            both = zip(*(batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3)), strict=True)
            keep = []
            for x, y in ((shingles(t, n), shingles(u, n)) for t, u in both):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = written(pairs.select("a", "b", "t_a", "t_b").mapInArrow(lean(run), "a bigint, b bigint"))
    discard(could_be, texts)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents that are linked, directly or through others, by a Jaccard similarity of their distinct
    runs of ``shingle`` words of ``percent`` per cent or more.

    Returns a row for each input row: doc_id, th (xxhash64 of the text), sig (64-bit hash of the set), root (a name of
    its class) and component_id (smallest doc_id that can be reached).  Words are lower-cased in ASCII and split at white space.  Null and empty texts are alike.
    Exact up to 64-bit hashes.  Null ids stay null and are never a component's id.  Empty table: no rows.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    places, levels = common_shingles(own, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.zeros(PLACES, np.uint8), set()
        np.maximum.at(level, places, levels)
        for batch in small(batches):
            out: list[tuple] = []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                s = np.unique(h := shingle_hashes(t, shingle))
                sig = xxhash.xxh64_intdigest(s.tobytes())
                # copies within a task have their keys once
                out.append((sig, majority(h), len(s), *((None, None) if sig in seen else (parity(s), prefix(s, level, percent).view(np.int64)))))
                seen.add(sig)
            if len(seen) > SEEN:
                seen.clear()
            sig, fp, size, *lists = zip(*out, strict=True) if out else [()] * 5
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sig, fp)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs, pa.array(size, pa.int64()), *lists], names=["doc_id", "th", "sig", "fp", "size", "parity", "keys"])

    full = written(own.select("doc_id", "t", "th").mapInArrow(lean(run), "doc_id bigint, th bigint, sig bigint, fp bigint, size bigint, parity array<bigint>, keys array<bigint>"))
    rows = written(full.select("doc_id", "th", "sig"))
    nodes = written(full.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.first("parity", ignorenulls=True).alias("parity")))
    key = Window.partitionBy("key")
    members = full.select("sig", "size", F.posexplode("keys").alias("pos", "key"))
    members = members.withColumn("lo", F.min("sig").over(key)).withColumn("hi", F.max("sig").over(key)).where("lo < hi")
    members = written(members.select("key", "sig", "size", "pos").dropDuplicates(["key", "sig"]))
    discard(full)

    def confirmed(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Roots, also by those of the pairs that are similar enough."""
        found = similar(pairs, nodes, own, shingle, percent)
        now = components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(found)
        return now

    def pairs_of(x: DataFrame, y: DataFrame, own: Column | None = None) -> DataFrame:
        """Pairs of a key in different classes that may be similar; with sketches, only what these leave open."""
        other = y.select("key", *(F.col(c).alias(f"{c}_b") for c in ("sig", "size", "pos", "root", "sketch") if c in y.columns))
        may = (F.col("root") != F.col("root_b")) & possible(percent)
        if "sketch" in y.columns:
            may &= close(percent)
        return x.join(other, "key").where(may if own is None else own & may).select(F.least("sig", "sig_b").alias("a"), F.greatest("sig", "sig_b").alias("b"))

    roots = confirmed(proposed(nodes), None)
    until = float("inf")  # open pairs up to which pivots are worth another round
    for k in range(ROUNDS + 1):
        named = members.join(roots, members["sig"] == roots["node"], "left").select("key", "sig", "size", "pos", F.coalesce("root", "sig").alias("root"))
        counts = named.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("within"), F.max(F.struct("count", "root"))["root"].alias("top"))
        # keys whose members are all in one class by now are never looked at again
        open_ = F.col("n") * F.col("n") - F.col("within")
        counts = written(counts.select("key", "n", open_.alias("open"), "top").where("open > 0"))
        many = F.col("open") > FEW * F.col("n")
        left = counts.agg(F.sum(F.when(many, F.col("open")))).first()[0] or 0
        last = not left or k == ROUNDS or left > until
        until = left / 2
        named = written(named.join(counts.select("key", "top", many.alias("many")), "key"))
        discard(members, counts)
        few = named.where("not many")
        pairs = pairs_of(few, few, F.col("sig") < F.col("sig_b"))
        if left:
            # sketches go with the members of large groups, so that a pair that they rule out is never a row
            several = written(named.where("many").join(nodes.select("sig", sketch(F.col("parity")).alias("sketch")), "sig"))
            if last:
                # those of a key's largest class needn't be compared with each other
                found = pairs_of(several.where("root != top"), several, (F.col("root_b") == F.col("top")) | (F.col("sig") < F.col("sig_b")))
            else:
                # members of a key are compared with the same one of them; large groups of near copies come together so.
                # Few rare shingles before a common one are a sign of a text from which the others were made
                order = F.struct(F.pmod(F.xxhash64("sig", F.lit(k)), F.lit(CENTRAL)).alias("h"), F.col("pos").alias("p"), "sig", "size", "pos", "root", "sketch")
                found = pairs_of(several, several.groupBy("key").agg(F.min(order).alias("p")).select("key", "p.sig", "p.size", "p.pos", "p.root", "p.sketch"))
            pairs = pairs.unionByName(found)
        roots = confirmed(pairs.distinct(), roots)
        if last:
            discard(named, *([several] if left else []))
            break
        members = written(several.select("key", "sig", "size", "pos"))
        discard(named, several)
    rooted = written(nodes.join(roots, nodes["sig"] == roots["node"], "left").select("sig", "least", F.coalesce("root", "sig").alias("root")))
    discard(nodes)
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "root", "component_id")
    return rows.join(ids, "sig", "left").select("doc_id", "th", "sig", "root", "component_id")
