import random

import pytest

import corpus_pipeline as P
import threadloom.llm.nearcopies as N
from llm.corpora import odd_rows, table


def runs(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, least.get(top(i))) for i, (d, _) in enumerate(rows)]


def planted(seed):
    """Copies with a few words changed (similarities on either side of 0.8), short texts, and a line in every text."""
    r, rows = random.Random(seed), []
    line = "this very line is found in each of these texts".split()
    for k in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 9, 12, 25, 60, 200, 600]))]
        for _ in range(r.choice([1, 2, 4, 9])):
            w = list(base)
            for _ in range(r.randrange(0, 2 + len(w) // 40)):
                w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
            at = r.randrange(len(w))
            rows.append((1000 - len(rows), " ".join(w[:at] + line + w[at:] if k % 2 else w)))
    return rows


@pytest.mark.parametrize("often", [N.OFTEN, 1_000_000])
def test_components_against_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(N, "OFTEN", often)
    rows = planted(often % 7) + odd_rows()
    got = N.near_copies(table(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_parities_never_exceed_differences():
    """Long sets too: the bound that drops pairs holds after folding to the smaller number of cells."""
    import numpy as np

    r = np.random.default_rng(4)
    for n, m in ((500, 620), (1000, 1030), (2040, 2500), (5000, 4100)):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], r.integers(0, 1 << 63, max(0, m - n * 9 // 10), dtype=np.uint64)]))
        p, q = sorted((N.parity(a), N.parity(b)), key=len)
        if len(q) > len(p):
            q = q[: len(p)] ^ q[len(p) :]
        assert len(p) * 64 >= 512 and len(q) == len(p)
        assert int(np.bitwise_count((p ^ q).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_long_near_copies_and_strangers(spark):
    r = random.Random(9)
    rows = []
    for k in range(6):
        base = [f"w{r.randrange(90_000)}" for _ in range(3000 + 900 * k)]
        for c in range(3):
            w = list(base)
            for _ in range(c * 40):
                w[r.randrange(len(w))] = f"x{r.randrange(9000)}"
            rows.append((len(rows), " ".join(["a passage that all of these long texts have"] + w[: len(w) - 30 * c])))
    got = N.near_copies(table(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty(spark):
    assert N.near_copies(table(spark, [])).count() == 0


def test_stage_drops_near_copies(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in planted(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.simhash(spark, df, str(tmp_path)).collect()}
    assert kept == {c for _, c in brute([x[:2] for x in rows])} and len(kept) < len(rows)


def test_fingerprints_propose_pairs_and_places_drop_strangers(spark, monkeypatch):
    """The Gray index connects all within three bits; strangers with one passage in common aren't compared in full."""
    r, rows, seen = random.Random(3), [], []
    passage = [f"p{i}" for i in range(12)]
    for _ in range(30):
        w = [f"w{r.randrange(90_000)}" for _ in range(r.randrange(40, 400))]
        rows.append((len(rows), " ".join(w[:20] + passage + w[20:])))
    for d, t in rows[:6]:
        rows.append((len(rows), t + " end"))
    real = N.similar

    def similar(pairs, *rest):
        seen.append({(p.a, p.b) for p in pairs.collect()})
        return real(pairs, *rest)

    monkeypatch.setattr(N, "similar", similar)
    got = N.near_copies(table(spark, rows)).select("doc_id", "component_id", "sig").collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted(brute(rows))
    sig = {x.doc_id: x.sig for x in got}
    fp = {d: N.majority(N.shingle_hashes(t.encode(), 5)) for d, t in rows}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= N.NEAR]
    first = {frozenset(p) for p in seen[0]}
    assert near and all(frozenset((sig[a], sig[b])) in first for a, b in near)
    assert sum(map(len, seen[1:])) < 36 * 35 // 2 // 4


def test_large_groups_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 1)
    rows = planted(2)[:90]
    got = N.near_copies(table(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("size", [150, 300])
def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch, size):
    """Copies of one text whose changes leave most pairs of them a little too different: rows of pairs, of a key or
    compared, are as many as a few for each member, not as the square."""
    monkeypatch.setattr(N, "FEW", 4)
    r, rows, seen = random.Random(7), [], []
    base = [f"w{i}" for i in range(150)]
    for i in range(size):
        w = list(base)
        for k in r.sample(range(len(w)), r.randrange(1, 6)):
            w[k] = f"x{i}x{k}"
        rows.append((i, " ".join(w)))
    real = N.similar

    def similar(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(N, "similar", similar)
    got = N.near_copies(table(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert len({x.component_id for x in got}) > 1 and sum(seen) < 8 * size


def test_sketches_never_exceed_differences(spark):
    """Sketches are parities folded to a fixed number of cells, so their bound holds whatever the sizes."""
    import numpy as np

    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 150, 3000, 20_000)]
    sets += [np.unique(np.concatenate([x[: len(x) * 9 // 10], r.integers(0, 1 << 63, len(x) // 9, dtype=np.uint64)])) for x in sets]
    df = spark.createDataFrame([(i, N.parity(x).tolist()) for i, x in enumerate(sets)], "i long, p array<long>")
    folds = [np.array(x.s, np.int64).view(np.uint64) for x in df.select("i", N.sketch(df.p).alias("s")).orderBy("i").collect()]
    for x, p in zip(sets, folds, strict=True):
        cells = np.bincount(((x >> np.uint64(7)) % np.uint64(N.CELLS)).astype(np.int64), minlength=N.CELLS) & 1
        assert np.array_equal(np.packbits(cells.astype(np.uint8)).view(np.uint64), p)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert int(np.bitwise_count(folds[i] ^ folds[j]).sum()) <= len(np.setxor1d(x, y))
