"""SentencePiece, sharding, toxicity, decontamination and near-duplicates."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from llm.corpora import odd_rows, random_rows, table
from threadloom.llm import sentencepiece_bpe as B
from threadloom.llm import simhash as S
from threadloom.llm import toxicity as X
from threadloom.llm.decontaminate import Automaton, scan_documents, words
from threadloom.llm.sentencepiece_bpe import codec, encode_texts
from threadloom.llm.sharding import shard_by_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# SentencePiece


def test_tokens_of_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd_rows() + [(50, "▁a▁ b"), (51, "\0\x01 日本\n\n  x, y.z;w"), (52, "<s></s>")]
    got = encode_texts(table(spark, rows), MODEL, check=False).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, ids, library.decode(ids)))
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert encode_texts(table(spark, []), MODEL).count() == 0 and encode_texts(table(spark, rows), MODEL).count() == len(rows)


def test_codec_on_random_texts_and_ids():
    c, r = codec(MODEL), random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("ab e  the\n▁é日😀\0ing<s>.,;​²") for _ in range(r.randrange(0, 80)))
        packed, decoded = c.encode(t)
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == c.library.encode(t) and decoded == c.library.decode(ids) == c.decode(ids)
        ids = [r.choice([r.randrange(0, 300), r.randrange(0, 32_000)]) for _ in range(r.randrange(0, 8))]
        assert c.decode(ids) == c.library.decode(ids)
    word = "".join(r.choice("ethanois") for _ in range(3000))
    assert np.frombuffer(c.encode(word)[0], "<u4").tolist() == c.library.encode(word)


def test_few_remembered_chunks(spark, monkeypatch):
    from threadloom.llm import sentencepiece_bpe as B

    monkeypatch.setattr(B, "KEPT", 3)
    with open(MODEL, "rb") as f:
        c = B.Codec(f.read())
    for t in ["▁a ▁b ▁c ▁d ▁e ▁a ▁b", "\0 ▁ x", "a b c d e f g h"] * 3:
        packed, decoded = c.encode(t)
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == c.library.encode(t) and decoded == c.library.decode(ids)


# sharding


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards(spark, shards):
    rows = [(i, t[:2000] if t else t) for i, t in odd_rows()] + random_rows(1, 300)
    got = shard_by_bytes(table(spark, rows, 5), shards).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(((i is not None, i or 0, crc(t), size(t), i) for i, t in rows))
    total, before, slots, want = sum(o[3] for o in order), 0, {}, []
    for _, _, c, n, i in order:
        shard = min(shards - 1, (2 * before + n) * shards // (2 * total))
        before += n
        want.append((i, n, c, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_shards_of_nothing(spark):
    assert shard_by_bytes(table(spark, []), 4).count() == 0


# toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_look_up(whole, beginnings, ordinary, w):
    if w in whole:
        return False, whole[w]
    if starts := [b for b in beginnings if w.startswith(b)]:
        return False, beginnings[max(starts, key=len)]
    if w in ordinary or w.isdigit():
        return None
    near = [x for t, x in whole.items() if X.allowed(len(t), False) and edits(w, t) <= X.allowed(len(t), False)]
    near += [x for b, x in beginnings.items() if X.allowed(len(b), True) and any(edits(w[:n], b) <= X.allowed(len(b), True) for n in range(len(w) + 1))]
    return (True, max(near)) if near else None


WHOLE = {"abcab": 1.0, "cabba": 2.0, "bbccaa": 3.0, "acb": 9.0, "abca": 1.5, "abcabcabcabc": 7.0, "ccbbaaccbbaacc": 8.0}
BEGINNINGS = {"ccc": 4.0, "cc": 0.5, "bbbbb": 5.0, "baacb": 2.5}


def test_automata_and_lexicon():
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abc") for _ in range(r.randrange(0, n)))
    lexicon = X.Lexicon(WHOLE, BEGINNINGS, frozenset(["abcaa", "bbbb"]))
    for k in range(4000):
        a, b = text(8), text(8)
        for most in (1, 2):
            automaton = X.Levenshtein(a, most)
            state = automaton.start()
            for c in b:
                state = state and automaton.step(state, c)
            assert (state and automaton.edits(state)) == (edits(a, b) if edits(a, b) <= most else None)
        w = list(text(9) if k % 2 else r.choice([*WHOLE, *BEGINNINGS]) + text(4))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randrange(2)] = r.choice(["a", "b", "0", ""])
        assert lexicon.look_up("".join(w)) == brute_look_up(lexicon.whole, lexicon.beginnings, lexicon.ordinary, "".join(w)), w


def test_very_long_terms_travel():
    import pickle

    long = "x" * 30_000
    lexicon = pickle.loads(pickle.dumps(X.Lexicon({long: 1.0}, {})))
    assert lexicon.look_up(long) == (False, 1.0) and lexicon.look_up(long[1:]) == (True, 1.0) and lexicon.look_up(long[3:]) is None


def test_quotation():
    s = X.Scanner(X.Lexicon({"idiot": 5.0}, {}))
    assert s.features("You idiot!")[:4] == [5.0, 5.0, 0.0, 0.0]
    assert s.features("You idiiot!")[:4] == s.features("You idi0t!")[:4] == [0.0, 0.0, 5.0, 0.0]
    assert s.features('They wrote "you idiot" once')[3] == s.features("The word idiot is old")[3] == 5.0
    assert s.features('One "' + "far " * 500 + 'idiot" here')[3] == 5.0  # however long the line
    assert s.features('One "\nidiot" here')[3] == s.features('"One" idiot here')[3] == 0.0


def brute_features(text, lexicon):
    """Features by definition: each word against each term, quotation by counting marks from the line's start."""
    low = text.lower()
    ms = list(re.finditer(r"[^\W_]+", low))
    found = set()
    for i, m in enumerate(ms):
        hit = brute_look_up(lexicon.whole, lexicon.beginnings, lexicon.ordinary, m[0])
        if hit:
            start, end = low.rfind("\n", 0, m.start()) + 1, (low + "\n").find("\n", m.end())
            before, after = X.MARKS.findall(low[start : m.start()]), X.MARKS.findall(low[m.end() : end])
            found.add((m[0], bool(len(before) % 2 and after) or bool({x[0] for x in ms[max(0, i - 3) : i]} & X.REPORTING), hit))
    plain = [x for _, aside, (odd, x) in found if not aside and not odd]
    return [max(plain, default=0.0), sum(plain), sum(x for _, aside, (odd, x) in found if odd and not aside), sum(x for _, aside, (_, x) in found if aside), float(len(ms))]


def test_score_against_brute_force(spark):
    r = random.Random(4)
    pieces = [*WHOLE, *(b + "ca" for b in BEGINNINGS), "abcaba", "ccabba", "wort", "said", '"', "«", "\n", "plain", "12", "abca", "ac", "cabca1"]
    rows = [(i, "".join(r.choice(pieces) + r.choice([" ", " ", ", ", "_", ""]) for _ in range(r.randrange(0, 30)))) for i in range(300)]
    model = X.Model(X.Lexicon(WHOLE, BEGINNINGS, frozenset(["abcaba"])), [1.5, 0.5, 0.25, -1.0, -0.1], -2.0)
    got = {x.doc_id: (list(x.features), x.score) for x in X.score_toxicity(table(spark, rows), model).collect()}
    for i, t in rows:
        f = brute_features(t, model.lexicon)
        z = model.bias + sum(w * math.log1p(x) for w, x in zip(model.weights, f, strict=True))
        assert np.allclose(got[i][0], f, atol=1e-6) and abs(got[i][1] - 1 / (1 + math.exp(-z))) < 1e-6


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(5)
    plain = ["the", "house", "river", "lower", "then", "walks", "green"]
    rows, labels = [], []
    for i in range(600):
        ws = [r.choice(plain) for _ in range(r.randrange(5, 40))]
        bad = i % 6 == 0
        if bad:
            ws.insert(r.randrange(len(ws)), r.choice(["loser", "idiot", "idi0t", "skum" + r.choice(["a", "en", "ix"])]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (10_000, 1)]
    docs = table(spark, rows + [(i and i + 5000, t) for i, t in odd_rows()])
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = X.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(odd_rows())
    held = [x for x in got if x.doc_id is not None and x.doc_id < 600 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and all((x.score >= 0.5) == (x.doc_id % 6 == 0) for x in held)
    assert all(0 <= x.score <= 1 for x in got)
    assert sorted(x.doc_id for x in X.keep_clean(docs, model).where("doc_id between 0 and 599").collect()) == [i for i in range(600) if i % 6]


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = table(spark, odd_rows())
    assert {x.score >= 0.5 for x in X.score_toxicity(docs, X.fit(docs, none)).collect()} == {False}
    empty = table(spark, [])
    assert X.score_toxicity(empty, X.fit(empty, none)).count() == 0


# decontamination


def brute_hits(rows, items, window):
    item_words = [(i, words(t)) for i, t in ((i, t or "") for i, t in items)]
    out = []
    for i, t in rows:
        ws, hit, of = words(t or ""), set(), set()
        for item, iw in item_words:
            n = min(window, len(iw))
            for k in range(len(iw) - n + 1) if n else ():
                for j in range(len(ws) - n + 1):
                    if ws[j : j + n] == iw[k : k + n]:
                        hit |= set(range(j, j + n))
                        of.add(item)
        out.append((i, len(ws), len(hit), sorted(str(x) for x in of if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_words", [500_000, 30])
def test_windows_of_items(spark, part_words):
    rows = [(i, t[:600] if t else t) for i, t in odd_rows()] + random_rows(9, 60)
    r = random.Random(3)
    source = [t for _, t in rows if t and len(t.split()) > 12]
    items = [(i, " ".join(r.choice(source).split()[2 : 2 + r.choice([3, 9, 10, 14, 30])]).upper()) for i in range(12)]
    items += [(20, None), (21, ""), (22, "tie"), (23, "never seen words at all"), (5, "BETA gamma"), (None, "alpha"), (3, items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = scan_documents(table(spark, rows), benchmark, part_words=part_words).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in got), key=repr) == brute_hits(rows, items, 10)


def test_cutting_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = table(spark, [(1, "Héy, A b-c d e f g h i J! end"), (2, "a b c"), (3, None)])
    got = {x.doc_id: (x.text, [tuple(s) for s in x.spans]) for x in scan_documents(docs, benchmark).collect()}
    assert got == {1: ("Héy, ! end", [(1, 11)]), 2: ("a b c", []), 3: (None, [])}
    assert {x.doc_id: x.text for x in scan_documents(docs, benchmark, max_length=10, max_coverage=0.9).collect()}[1].startswith("Héy, A b-c")
    assert scan_documents(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0 and scan_documents(table(spark, []), benchmark).count() == 0


def test_automaton_lengths():
    r = random.Random(8)
    items = [("x", [bytes([r.choice(b"abc")]) for _ in range(r.randrange(1, 30))]) for _ in range(6)]
    a = Automaton(items, 5)
    doc = [bytes([r.choice(b"abcd")]) for _ in range(300)]
    state = size = 0
    for k, w in enumerate(doc):
        state, size = a.step(state, size, a.number.get(w, -1))
        best = max(n for n in range(31) if n == 0 or any(doc[k + 1 - n : k + 1] == iw[j : j + n] for _, iw in items for j in range(len(iw) - n + 1) if n <= k + 1))
        assert size == best


# near-duplicates


def brute_fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("busy", [20_000, 5])
def test_components(spark, busy, monkeypatch):
    monkeypatch.setattr(S, "BUSY", busy)
    r = random.Random(6)
    rows = [(i, t[:2000] if t else t) for i, t in odd_rows()] + random_rows(2, 60)
    base = " ".join(r.choice(["ab", "Cd", "ef", "gh", "ij"]) + str(r.randrange(99)) for _ in range(400)).split()
    for i in range(60):  # a chain of near copies
        base[r.randrange(len(base))] = f"new{i}"
        rows.append((5000 - i, " ".join(base)))
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, fp[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)
    got = S.near_duplicates(table(spark, rows)).collect()
    assert sorted(((x.doc_id, x.fp & (2**64 - 1), x.component_id) for x in got), key=repr) == want


def test_gray_index_finds_all_pairs():
    r = np.random.default_rng(3)
    one = lambda n: np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    base = r.integers(0, 1 << 63, 100, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ one(100) ^ one(100) for _ in range(20)]))
    index = S.GrayIndex(np.zeros(len(x), np.int64), x)
    got = {frozenset((a, b)) for i, j in index.pairs(3) for a, b in zip(index.fp[i].tolist(), index.fp[j].tolist(), strict=True)}
    near = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
    assert got == {frozenset(p) for p in zip(x[near[0]].tolist(), x[near[1]].tolist(), strict=True)}
    ranks = S.gray_rank(np.array([v ^ (v >> 1) for v in range(1000)], np.uint64))
    assert ranks.tolist() == list(range(1000))


def test_no_near_duplicates_of_nothing(spark):
    assert S.near_duplicates(table(spark, [])).count() == 0
    assert S.components(spark.createDataFrame([(1, 2), (2, 3), (9, 9), (5, 6), (3, 1)], "a long, b long")).orderBy("node").select(F.array("node", "root")).collect() == [([2, 1],), ([3, 1],), ([6, 5],)]


def test_ids_are_packed_as_little_endian_unsigned_integers():
    from threadloom.llm.sentencepiece_bpe import as_bytes

    assert as_bytes([]) == b"" and as_bytes([1, 256, 2**32 - 1]) == b"\x01\0\0\0\0\x01\0\0\xff\xff\xff\xff"


def library_says(c, texts):
    ids = c.library.encode(texts)
    return [(x, t) for x, t in zip(ids, c.library.decode(ids), strict=True)]


def says(c, texts):
    ids, at, decoded = c.encode_all(texts)
    return [(ids[a:b].tolist(), t) for a, b, t in zip(at, at[1:], decoded, strict=False)]


def test_different_words_are_not_piled_up():
    with open(MODEL, "rb") as f:
        c = B.Codec(f.read())
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("ethanoisr") for _ in range(r.randrange(8, 14))) for _ in range(2000)) for _ in range(30)]
    for t in texts:
        c.encode(t)
    assert len(c.new) + len(c.old) < 100
    assert says(c, texts) == library_says(c, texts)


def test_texts_encoded_together(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab e  the\n▁é日😀\0ing<s>.,;​²") for _ in range(r.choice([0, 1, 3, 40, 300]))) for _ in range(400)]
    texts += ["the ", " the", "", "the", "a" * 200, "日日 😀😀", ". .. ... ....", "x" * 47 + " " + "x" * 48 + " " + "x" * 49]
    c = codec(MODEL)
    assert says(c, texts) == library_says(c, texts) and says(c, []) == [] and says(c, ["", ""]) == [([], "")] * 2
    monkeypatch.setattr(B, "POWER", 1)  # all orders of the same characters have one hash
    with open(MODEL, "rb") as f:
        c = B.Codec(f.read())
    assert says(c, ["on no eat tea ate", *texts]) == library_says(c, ["on no eat tea ate", *texts])
    monkeypatch.setattr(B, "PORTION", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["a", "t"])
    parts = [p.column(1).to_pylist() for p in B.portions(batch)]
    assert sum(parts, []) == texts and all(sum(map(bool, p)) == 1 or sum(map(len, p)) <= 50 for p in parts) and not list(B.portions(batch.slice(0, 0)))


def test_unknown_characters_without_bytes():
    from threadloom.llm.sentencepiece_bpe import neighbours

    for join in (False, True):
        kind, joined = neighbours({"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "c": 5}, join)
        may = lambda s: bool(joined[kind[ord(s[0])], kind[ord(s[1])]])
        assert may(" a") and may("ab") and not may("ba") and not may("a ") and not may("cc") and not may("aa") and may("xy") == join


def test_memory_is_released_around_tasks(monkeypatch):
    from threadloom.llm import batches

    said = []
    monkeypatch.setattr(batches, "release", lambda: said.append("release"))

    def run(found):
        for b in found:
            said.append(b)
            yield b

    assert list(batches.lean(run)([1, 2])) == [1, 2] and said == ["release", 1, 2, "release"]
    with pytest.raises(TypeError):
        list(batches.lean(run)(None))
    assert said[4:] == ["release", "release"]
