import numpy as np
import pytest

from llm.corpora import odd_rows, random_rows, table
from threadloom.llm import blocks as B
from threadloom.llm import repeats as R
from threadloom.llm.repeats import COVERS
from threadloom.llm.substring import dedup_substrings
from threadloom.llm.suffix import dedup_suffixes


def brute(rows, units, window):
    """A multiset of (id, units, removed flags); null ids neither lose nor prove anything."""
    first: dict = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if i is not None and first[tuple(u[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, u, gone))
    return out


def words(t):
    return (t or "").encode().split()


def raw(t):
    return list((t or "").encode())


CASES = [("words", dedup_substrings, words, 13), ("words of 8", dedup_substrings, words, 8), ("bytes", dedup_suffixes, raw, 50), ("bytes of 38", dedup_suffixes, raw, 38)]


def check(spark, f, units, window, rows):
    got = []
    for r in f(table(spark, rows), window=window, block_bytes=4000).collect():
        n = r[1]
        gone = [False] * n
        for s in r.spans:
            assert s.start < s.end
            gone[s.start : s.end] = [True] * (s.end - s.start)
        assert r.n_removed == sum(gone) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        got.append((r.doc_id, gone, r.kept.encode() if isinstance(r.kept, str) else bytes(r.kept)))
    want = []
    for i, u, gone in brute(rows, units, window):
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        want.append((i, gone, b" ".join(kept) if f is dedup_substrings else bytes(kept)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("name", "f", "units", "window"), CASES, ids=[c[0] for c in CASES])
@pytest.mark.parametrize("corpus", ["odd", "random"])
def test_against_brute_force(spark, name, f, units, window, corpus):
    check(spark, f, units, window, [(i, t[:3000] if t else t) for i, t in odd_rows()] if corpus == "odd" else random_rows(window))


@pytest.mark.parametrize(("f", "units", "window"), [(dedup_substrings, words, 13), (dedup_suffixes, raw, 50)])
def test_hot_ids(spark, f, units, window):
    """An id with most of all rows is dealt over blocks, and its rows are still not earlier than each other."""
    texts = [t for _, t in random_rows(5, 150) + random_rows(6, 150)]
    rows = [(7 if k % 3 else None if k % 9 == 0 else k, t) for k, t in enumerate(texts)]
    lay = B.layout(table(spark, rows), "doc_id", "text", 4000)
    assert lay.ways.max() > 3 and lay.blocks > len(lay.ways) > 3
    check(spark, f, units, window, rows)


@pytest.mark.parametrize(("f", "units", "window", "name"), [(dedup_substrings, words, 13, "word_hashes"), (dedup_suffixes, raw, 50, "byte_hashes")])
@pytest.mark.parametrize("at_once", [B.AT_ONCE, 500])
def test_colliding_hashes(spark, monkeypatch, f, units, window, name, at_once):
    """First hashes of six bits: what tells windows apart is the second one."""
    own, layout = getattr(R, name), B.layout

    def few_bits(units, at, n, lane):
        h = own(units, at, n, lane)
        return h if lane else h & np.uint64(63 << 58)

    spec = R.Spec(window, 7 if f is dedup_substrings else 31, R.word_units if f is dedup_substrings else R.byte_units, few_bits)
    monkeypatch.setattr("threadloom.llm.substring.WORDS", lambda w: spec)
    monkeypatch.setattr("threadloom.llm.suffix.BYTES", lambda w: spec)
    monkeypatch.setattr(B, "AT_ONCE", at_once)

    def huge(*args):
        lay = layout(*args)
        lay.total_bytes = 1 << 50
        return lay

    monkeypatch.setattr(B, "layout", huge)
    check(spark, f, units, window, random_rows(window))


@pytest.mark.parametrize("f", [dedup_substrings, dedup_suffixes])
def test_empty_table(spark, f):
    assert f(table(spark, [])).collect() == []


def test_covers_meet_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_too_short_windows():
    for f in (dedup_substrings, dedup_suffixes):
        with pytest.raises(ValueError, match="window"):
            f(None, window=5)
