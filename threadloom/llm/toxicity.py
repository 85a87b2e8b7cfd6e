"""Toxicity scores from a lexicon that is searched with Levenshtein automata (operator 6).

The lexicon is learnt: words, and beginnings that many words share, with the log ratio of their rates in toxic and
other labelled documents as weight.  It is kept as tries; for each distinct word of a text a Levenshtein automaton is
run against them, so misspelled terms and inflected forms of misspelled beginnings are found too.  How many edits a
term allows follows from its length alone.  Words that the labelled documents know as ordinary ones are not taken for
misspellings.  A window around each hit tells quotation (inside quotation marks, behind a verb of reporting) from
abuse.  Weights of hits by kind go into a logistic regression.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.batches import lean, small
from threadloom.session import checkpointed

WORD = re.compile(r"[^\W_]+")  # digits stay inside words: they stand for letters in some misspellings
PREFIXES = range(3, 9)
#: Verbs and nouns that announce a quotation, and marks that open or close one.
REPORTING = frozenset("said says wrote writes called quoted quote word term dit écrit mot cite sagte schrieb zitat wort dijo escribió cita palabra".split())
MARKS = re.compile("[\"“”„«»]")
FEATURES = ("strongest plain term", "plain terms", "misspelled terms", "quoted terms", "words")
ORDINARY = 3  # documents of the other label that make a word an ordinary one
CACHED = 200_000  # words remembered in each of two generations


def allowed(letters: int, beginning: bool) -> int:
    """Edits that a term of so many letters allows."""
    return 0 if letters < 4 + beginning else 1 if letters < 12 else 2


class Levenshtein:
    """Automaton of all words within ``most`` edits of ``word``.  A state has a number for each count of edits: bit i
    of number e says that the first i letters can have been read with e edits at most."""

    def __init__(self, word: str, most: int):
        self.most, self.whole = most, 1 << len(word)
        self.inside = 2 * self.whole - 1
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((2 << e) - 1 & self.inside for e in range(self.most + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...] | None:
        """The state after ``c``; None if no word goes on like that."""
        fits, below = self.places.get(c, 0), state[0]
        new = (below & fits) << 1
        out = [new]
        for e in range(1, self.most + 1):
            now = state[e]
            # as it is; c is too many; c for another letter; a letter is left out
            new = ((now & fits) << 1 | below | (below | new) << 1) & self.inside
            out.append(new)
            below = now
        return tuple(out) if new else None

    def edits(self, state: tuple[int, ...]) -> int | None:
        """Edits if the other word ends here; None if it isn't accepted."""
        return next((e for e in range(self.most + 1) if state[e] & self.whole), None)


def shortened(word: str) -> list[str]:
    """The word, and what it is without each of its letters: words one edit apart share one of these."""
    return [word, *[word[:i] + word[i + 1 :] for i in range(len(word))]]


def grow(node: dict, term: str, kind: str, weight: float) -> None:
    for c in term:
        node = node.setdefault(c, {})
    node[kind] = weight


@dataclass
class Lexicon:
    """whole: weights of terms that are words; beginnings: of terms that words start with; ordinary: words that are
    no misspellings however near a term they are."""

    whole: dict[str, float]
    beginnings: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fuzzy: dict[int, dict] = {}  # tries by edits
        self.near, self.fronts = set(), set()  # shortened terms and beginnings that allow one edit
        self.pieces: dict[tuple[int, int], set[str]] = {}  # by place and size: of terms that allow two
        for terms, kind in ((self.whole, "whole"), (self.beginnings, "start")):
            for term, weight in terms.items():
                grow(self.trie, term, kind, weight)
                most = allowed(len(term), kind == "start")
                if not most:
                    continue
                grow(self.fuzzy.setdefault(most, {}), term, kind, weight)
                if most == 1:
                    (self.near if kind == "whole" else self.fronts).update(shortened(term))
                else:  # two edits leave one of three pieces as it is, moved by two places at most
                    cuts = [len(term) * i // 3 for i in range(4)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        self.pieces.setdefault((a, b - a), set()).add(term[a:b])
        sizes = {len(b) for b in self.beginnings if allowed(len(b), True) == 1}
        self.reach = sorted({n + d for n in sizes for d in (-1, 0, 1)})

    def may_be_misspelled(self, word: str, most: int) -> bool:
        """Cheap, and never False for a word that some term accepts with so many edits."""
        if most == 2:
            return any(word[at : at + k] in known for (a, k), known in self.pieces.items() for at in range(max(0, a - 2), a + 3))
        if len(word) <= 13 and not self.near.isdisjoint(shortened(word)):
            return True
        return any(not self.fronts.isdisjoint(shortened(word[:n])) for n in self.reach)

    def look_up(self, word: str) -> tuple[bool, float] | None:
        """Is it misspelled, and the weight of its term: the word itself, else its longest beginning, else the
        weightiest term or beginning within the edits that it allows."""
        node, start = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            start = node.get("start", start)
        else:
            if "whole" in node:
                return False, node["whole"]
        if start is not None:
            return False, start
        if word in self.ordinary or word.isdigit():
            return None
        found = self.misspelled(word)
        return None if found is None else (True, found)

    def misspelled(self, word: str) -> float | None:
        best = None
        for most, trie in self.fuzzy.items():
            if self.may_be_misspelled(word, most):
                automaton = Levenshtein(word, most)
                found = self.meet(automaton, trie, automaton.start())
                if found is not None and (best is None or found > best):
                    best = found
        return best

    def meet(self, automaton: Levenshtein, trie: dict, start: tuple[int, ...]) -> float | None:
        """The largest weight of terms that trie and automaton both accept; a beginning is accepted by any state, as
        what is left of the word may follow it."""
        best = None
        open_ = [(trie, start)]
        while open_:
            node, state = open_.pop()
            for c, below in node.items():
                if len(c) == 1:
                    if (after := automaton.step(state, c)) is not None:
                        open_.append((below, after))
                elif (best is None or below > best) and (c == "start" or automaton.edits(state) is not None):
                    best = below
        return best

    def __reduce__(self):
        return Lexicon, (self.whole, self.beginnings, self.ordinary)


class Scanner:
    """Features of texts; one for each task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.new: dict[str, tuple[bool, float] | None] = {}
        self.old: dict[str, tuple[bool, float] | None] = {}

    def look_up(self, word: str) -> tuple[bool, float] | None:
        if word not in self.new:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[word] = self.old[word] if word in self.old else self.lexicon.look_up(word)
        return self.new[word]

    def features(self, text: str) -> list[float]:
        lowered = text.lower()
        words = WORD.findall(lowered)
        known, slow = self.new, self.look_up
        hits = [i for i, w in enumerate(words) if (known[w] if w in known else slow(w)) is not None]
        out = [0.0] * len(FEATURES)
        out[4] = float(len(words))
        if hits:
            at = [m.span() for m in WORD.finditer(lowered)]
            marks, breaks = [m.start() for m in MARKS.finditer(lowered)], [i for i, c in enumerate(lowered) if c == "\n"]
            # each term counts once for its plain uses and once for its quoted ones
            for word, aside in sorted({(words[i], self.quoted(words, i, at[i][0], marks, breaks, len(lowered))) for i in hits}):
                misspelled, weight = slow(word)
                if aside:
                    out[3] += weight
                elif misspelled:
                    out[2] += weight
                else:
                    out[0] = max(out[0], weight)
                    out[1] += weight
        return [round(x, 6) for x in out]

    @staticmethod
    def quoted(words: list[str], i: int, at: int, marks: list[int], breaks: list[int], size: int) -> bool:
        """Is the word between quotation marks of its line, or close behind a word of reporting?"""
        line = bisect_left(breaks, at)
        start, end = breaks[line - 1] if line else -1, breaks[line] if line < len(breaks) else size
        before = bisect_left(marks, at)
        inside = (before - bisect_left(marks, start)) % 2 == 1 and before < len(marks) and marks[before] < end
        return inside or not REPORTING.isdisjoint(words[max(0, i - 3) : i])


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * math.log1p(x) for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fold(id_col: str):
    """crc32 of the id as text, modulo 5: rows with 0 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> Model:
    """Learns lexicon and weights from labelled rows that aren't held out.

    ``max_rows`` bounds the labelled rows used (a hash of the id decides which; documented sample for fitting only).
    Terms need 1 % of the toxic ones of these, so no more than a hundred times the words of one document reach the
    driver, and ordinary words only where they are near a term.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = some.count()
    if n > max_rows:
        some = some.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    train = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(some), "id")
    # copies of a text count once, or every rare word of a text that is copied often would look like a term
    train = checkpointed(train.groupBy(F.xxhash64("t").alias("h")).agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        rows = [0, 0]
        for batch in small(batches):
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                y = int(y > 0)
                rows[y] += 1
                words = set(WORD.findall(t.lower()))
                seen[y].update(words)
                seen[y].update({w[:k] + "*" for w in words for k in PREFIXES if len(w) > k})
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield counted(seen)
                    seen = (Counter(), Counter())
        seen[0][""], seen[1][""] = rows[0], rows[1]
        yield counted(seen)

    def counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    counts = train.mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    word = ~F.endswith("term", F.lit("*"))
    usual = F.col("neg") >= ORDINARY
    counts = checkpointed(counts.where((F.col("pos") >= 5) | (usual & word) | (F.col("term") == "")))
    pos, neg = counts.where("term = ''").agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    least = max(5, -(-pos // 100))
    often = (F.col("pos") >= least) & (F.col("pos") * (neg + 1) >= 4 * (pos + 1) * F.col("neg"))
    rows = counts.where(often & (F.col("term") != "")).collect()
    lexicon = choose({r.term: (r.pos, r.neg) for r in rows}, pos, neg)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array([lexicon.misspelled(w) is not None for w in batch.column("term").to_pylist()], pa.bool_()))

    ordinary = counts.where(usual & word & (F.col("term") != "") & (F.col("neg") * (pos + 1) >= F.col("pos") * (neg + 1))).select("term")
    lexicon = Lexicon(lexicon.whole, lexicon.beginnings, frozenset(r.term for r in ordinary.mapInArrow(near, "term string").collect()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(lexicon)
        for batch in small(batches):
            found = [s.features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[round(math.log1p(x), 2) for x in f] for f in found], pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    # rows that agree in all features count as one with a weight; there are no more than max_rows
    cells = train.mapInArrow(scan, "x array<double>, y int").groupBy("x").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).collect()
    weights, bias = regression([list(r.x) for r in cells], [r.pos for r in cells], [r.n for r in cells])
    return Model(lexicon, weights, bias)


def choose(counts: dict[str, tuple[int, int]], pos: int, neg: int) -> Lexicon:
    """Weights of terms that are commoner in toxic documents by 5 deviations; a beginning stays only if no longer
    term has nearly all of its documents."""
    base = (pos + 0.5) / (pos + neg + 1)
    counts = {t: (p, n) for t, (p, n) in counts.items() if p - (p + n) * base >= 5 * math.sqrt((p + n) * base * (1 - base))}
    weight = {t: math.log(((p + 0.5) / (pos + 1)) / ((n + 0.5) / (neg + 1))) for t, (p, n) in counts.items()}
    covered: dict[str, int] = {}  # most documents of a longer term, by beginning
    for t, (p, _) in counts.items():
        stem = t.rstrip("*")
        for k in range(1, len(stem) + (not t.endswith("*"))):
            covered[stem[:k]] = max(p, covered.get(stem[:k], 0))
    starts = {t[:-1]: w for t, w in weight.items() if t.endswith("*") and covered.get(t[:-1], 0) < 0.9 * counts[t][0]}
    return Lexicon({t: w for t, w in weight.items() if not t.endswith("*")}, starts)


def regression(x: list[list[float]], pos: list[int], n: list[int], ridge: float = 0.05, rounds: int = 60) -> tuple[list[float], float]:
    """Weighted logistic regression by Newton steps; without both labels, the bias is the smoothed rate."""
    if not x or sum(pos) in (0, sum(n)):
        rate = (sum(pos) + 0.5) / (sum(n) + 10)
        return [0.0] * len(FEATURES), math.log(rate / (1 - rate))
    a = np.hstack([np.array(x), np.ones((len(x), 1))])
    k, m = np.array(pos, float), np.array(n, float)
    penalty = np.diag([ridge] * len(FEATURES) + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (m * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (k - m * p) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id, score (0 to 1) and features (weights of hits by kind, as in ``FEATURES``).

    Null and empty texts have no hits and get the model's base score.  Equal texts get equal scores.  Null ids stay
    null; other columns are not read.  Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(model.lexicon)
        for batch in small(batches):
            found = [s.features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(f) for f in found]), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "score", "features"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "doc_id bigint, score double, features array<double>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows as they are, without those that score ``threshold`` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(model.lexicon)
        for batch in small(batches):
            yield batch.filter(pa.array([model.score(s.features(t or "")) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
