"""SentencePiece encoding and decoding for merge-type vocabularies (operator 4).

A text is cut into chunks between all characters that are neighbours in no piece, so no merge crosses a cut and each
chunk can be encoded alone.  No piece of a vocabulary learnt over split white space has a space mark behind another
character, so there is a cut before every run of space marks at least; :class:`Codec` refuses other vocabularies.  The
different chunks of some texts are encoded once.  Within a chunk an agenda of adjacent symbol pairs, ordered by score and
then from the left, is worked off until no pair is a piece; the agendas of many short chunks are columns of one array,
and each step takes the best pair of every column.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.batches import lean

MARK = "▁"
UNKNOWN = " ⁇ "  # what the library decodes an unknown id to
SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 48)  # symbols of the columns that short chunks are sorted into
COLUMNS = 4096  # chunks whose agendas are worked off together
PLACES = WIDTHS[-1] + 2
NEVER = np.iinfo(np.int64).max
KEPT = 50_000  # longer and strange chunks remembered in each of two generations, long ones counted as several
LONG = 64  # characters from which a chunk counts as two
PORTION = 1 << 18  # characters of texts encoded together, unless one has more
MIX, POWER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # factors of hashes


class Codec:
    """Vocabulary and rules from a model file; its own encoder and decoder, and the library's for checking."""

    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = len(sp)
        pieces = sp.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a space mark behind another character: chunks can't be encoded alone")
        if sp.encode("Å ﬁ", out_type=str)[0][:1] != MARK or sp.normalize("Å  ﬁ ") != f"{MARK}Å{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("only models that keep every character and add a mark in front are supported")
        self.ids = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: -sp.get_score(i) for i in plain if len(pieces[i]) > 1}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.text = [b"" if sp.is_control(i) else UNKNOWN.encode() if sp.is_unknown(i) else pieces[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.plain = [t.decode(errors="replace") for t in self.text]
        self.agendas = Agendas(self.ids, self.rank)
        self.kind, self.joined = neighbours(self.ids, not self.bytes)
        self.byte_ids = frozenset(self.bytes.values())
        self.new: dict[str, tuple[list[int], str]] = {}
        self.old: dict[str, tuple[list[int], str]] = {}
        self.room = KEPT
        self.powers = np.ones(1, np.uint64)

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk, by the agenda."""
        sym: list[str | None] = list(chunk)
        n, rank = len(chunk), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[s], i, s) for i in range(n - 1) if (s := chunk[i : i + 2]) in rank]
        heapify(agenda)
        while agenda:
            _, i, s = heappop(agenda)
            a, j = sym[i], after[i]
            if a is None or j >= n or len(a) + len(b := sym[j]) != len(s) or a + b != s:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = s, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := s + sym[k]) in rank:
                    heappush(agenda, (rank[pair], i, pair))
            if (k := before[i]) >= 0 and (pair := sym[k] + s) in rank:
                heappush(agenda, (rank[pair], k, pair))
        return [s for s in sym if s is not None]

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(chunk):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += (self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): bytes that are no UTF-8 become U+FFFD one by one, one space in front goes."""
        out: list[str] = []
        run = bytearray()
        front = True
        for i in ids:
            if i in self.byte_ids:
                run += self.text[i]
                front = False
                continue
            if run:
                out.append(as_text(bytes(run)))
                run.clear()
            s = self.plain[i]
            if front and s:
                front = False
                if s[0] == " " and i != self.unknown:
                    s = s[1:]  # the mark that encoding adds
            out.append(s)
        if run:
            out.append(as_text(bytes(run)))
        return "".join(out)

    def chunk(self, chunk: str) -> tuple[list[int], str]:
        """Ids of a chunk and what they decode to."""
        if (found := self.new.get(chunk)) is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            if self.byte_ids.isdisjoint(ids):
                found = ids, "".join([self.plain[i] for i in ids])
            else:
                found = ids, as_text(b"".join([self.text[i] for i in ids]))
        if self.room <= 0:
            self.old, self.new, self.room = self.new, {}, KEPT
        self.room -= 1 + len(chunk) // LONG
        self.new[chunk] = found
        return found

    def same(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks of codes: one of each text, and for each chunk the place of its text's there.  Hashes bring chunks
        together, codes are compared then."""
        if len(self.powers) <= len(codes):
            self.powers = np.full(len(codes) + 1, POWER, np.uint64)
            self.powers[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
        # powers fall along the codes, so that sums of equal texts differ only by the power of their place
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)][::-1], out=total[1:])
        hashes = (total[start + size] - total[start]) * self.powers[start]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        shift = np.repeat(start[first][which] - start, size)
        if (size[first][which] != size).any() or (codes[np.arange(len(codes)) + shift] != codes).any():
            return np.arange(len(start)), np.arange(len(start))
        return first, which

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of documents, without begin and end, one after the other; where those of each document start, and at last
        where they end; and what they decode to."""
        decoded = [t.replace(MARK, " ") for t in texts]
        size_of = np.array([len(t) + 1 if t else 0 for t in decoded], np.int64)
        codes = np.frombuffer("".join([" " + t for t in decoded if t]).encode("utf-32-le"), "<u4")
        doc_at = np.concatenate([[0], size_of.cumsum()])
        if not len(codes):
            return np.zeros(0, "<u4"), doc_at, decoded
        kind = self.kind[codes]
        cut = np.ones(len(codes), bool)
        np.logical_not(self.joined[kind[:-1], kind[1:]], out=cut[1:])
        cut[doc_at[:-1][size_of > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(codes))
        first, which = self.same(codes, start, size)
        short = np.flatnonzero(size[first] <= WIDTHS[-1])
        short = first[short[np.argsort(size[first[short]], kind="stable")]]
        symbols = self.agendas.symbol[codes]
        parts, counts, low = [], [np.zeros(0, np.int64)], 0
        for width in WIDTHS:
            high = int(np.searchsorted(size[short], width, "right"))
            for at in range(low, high, COLUMNS):
                some = short[at : min(at + COLUMNS, high)]
                ids, n = self.agendas.merge(symbols, start[some], size[some], width)
                parts.append(ids)
                counts.append(n)
            low = high
        n_ids = np.full(len(start), -1, np.int64)  # by chunk, for the first of each text
        n_ids[short] = np.concatenate(counts)
        done = short[n_ids[short] >= 0]
        rest = first[n_ids[first] < 0]  # long, or with characters that are no pieces
        odd: dict[int, str] = {}
        for i in rest.tolist():
            text = codes[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le")
            ids, out = self.chunk(text.replace(" ", MARK))
            parts.append(np.array(ids, "<u4"))
            n_ids[i] = len(ids)
            if out != text:
                odd[i] = out
        done = np.concatenate([done, rest])
        before = np.zeros(len(start), np.int64)  # ids in front of its own in the parts
        before[done] = n_ids[done].cumsum() - n_ids[done]
        n, before = n_ids[first][which], before[first][which]
        ends = n.cumsum()
        ids = np.concatenate(parts)[np.repeat(before - ends + n, n) + np.arange(ends[-1])]
        chunk_at = np.searchsorted(start, doc_at)
        if odd:
            is_odd = np.zeros(len(start), bool)
            is_odd[list(odd)] = True
            source = first[which]
            for d in np.unique(np.searchsorted(doc_at, start[is_odd[source]], "right") - 1).tolist():
                of_doc = range(chunk_at[d], chunk_at[d + 1])
                whole, a = " " + decoded[d], start[chunk_at[d]]
                decoded[d] = "".join([odd[k] if (k := int(source[i])) in odd else whole[start[i] - a : start[i] - a + size[i]] for i in of_doc])[1:]
        return ids, np.concatenate([[0], ends])[chunk_at], decoded

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a document, without begin and end, and what they decode to."""
        ids, _, decoded = self.encode_all([text])
        return ids.tobytes(), decoded[0]


def neighbours(ids: dict[str, int], unknown_join: bool) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of characters by code, and which kinds are neighbours in a piece; spaces stand for their marks."""
    kinds: dict[str, int] = {}
    for p in ids:
        if len(p) > 1:
            for c in p:
                kinds.setdefault(c, len(kinds) + 2)
    kind = np.ones(0x110000, np.int32)  # 1: in no piece; unknown characters in a row make one id if there are no bytes
    for p in ids:
        if len(p) == 1:
            kind[ord(p)] = 0  # only a piece of its own
    for c, k in kinds.items():
        kind[ord(c)] = k
    kind[ord(" ")] = kind[ord(MARK)]
    joined = np.zeros((len(kinds) + 2,) * 2, bool)
    joined[1, 1] = unknown_join
    for p in ids:
        for a, b in zip(p, p[1:], strict=False):
            joined[kinds[a], kinds[b]] = True
    return kind, joined


class Agendas:
    """Which symbols join to which piece, as a table with open addresses, and the agendas of many chunks at once."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        self.none = max(ids.values(), default=0) + 1  # stands beside the outer symbols
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = ids.get(MARK, -1)
        order = {r: k for k, r in enumerate(sorted(set(rank.values())))}
        self.order = np.full(self.none + 1, NEVER, np.int64)  # at -1: of no piece
        for p, r in rank.items():
            self.order[ids[p]] = order[r] * PLACES
        joins = {ids[p[:k]] * (self.none + 1) + ids[p[k:]]: ids[p] for p in rank for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.bits = max(10, (4 * len(joins)).bit_length())
        self.key, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, made = np.fromiter(joins, np.int64, len(joins)), np.fromiter(joins.values(), np.int32, len(joins))
        slot = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.key[slot] < 0)
            self.key[slot[free]] = keys[free]  # of several the last stays
            done = self.key[slot] == keys
            self.made[slot[done]] = made[done]
            keys, made, slot = keys[~done], made[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - self.bits)).view(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pieces that two symbols make, -1 for none."""
        keys = a * (self.none + 1) + b
        slot = self.slot(keys)
        there = self.key[slot]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            now = self.key[slot[other]]
            there[other] = now
            other = other[(now != keys[other]) & (now >= 0)]
        return np.where(there == keys, self.made[slot], -1)

    def merge(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of up to ``width`` symbols, one after the other, and how many each has: -1 if one of its
        characters is no piece."""
        n, high = len(start), width + 2
        place = np.arange(high)[:, None]
        sym = np.full((high, n), self.none, np.int64)
        inside = place[:width] < size
        sym[1:-1][inside] = symbols[(start + place[:width])[inside]]
        strange = (sym < 0).any(axis=0)
        sym[:, strange] = self.none
        made = np.full((high, n), -1, np.int64)
        made[1:-2] = self.join(sym[1:-2].ravel(), sym[2:-1].ravel()).reshape(width - 1, n)
        # the better the smaller, and of equal ones the leftmost
        agenda = np.where(made >= 0, self.order[made] + place, NEVER)
        after, before = np.repeat(place + 1, n, axis=1), np.repeat(place - 1, n, axis=1)
        sym1, made1, agenda1, after1, before1 = (x.reshape(-1) for x in (sym, made, agenda, after, before))
        while len(col := np.flatnonzero((best := agenda.min(axis=0)) != NEVER)):
            i = best[col] % PLACES
            at = i * n + col
            s = made1[at]
            gone = after1[at] * n + col
            k = after1[gone]
            right = k * n + col
            h = before1[at]
            left = h * n + col
            sym1[at], sym1[gone] = s, -1
            agenda1[gone] = NEVER
            after1[at], before1[right] = k, i
            for one, where, pair in ((at, i, self.join(s, sym1[right])), (left, h, self.join(sym1[left], s))):
                made1[one] = pair
                agenda1[one] = np.where(pair >= 0, self.order[pair] + where, NEVER)
        ids = sym.T
        real = (ids >= 0) & (ids != self.none)
        return ids[real].astype("<u4"), np.where(strange, -1, real.sum(axis=1))


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little" and array("I").itemsize == 4:
        return array("I", ids).tobytes()  # a third of the time that an array of numpy's takes
    return np.array(ids, "<u4").tobytes()


def as_text(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is in no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


CODECS: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """One for each worker process."""
    if model_path not in CODECS:
        with open(model_path, "rb") as f:
            CODECS[model_path] = Codec(f.read())
    return CODECS[model_path]


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of up to PORTION characters, or of one row with more."""
    start = size = 0
    for i, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        if size and size + n > PORTION:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(batch):
        yield batch.slice(start)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Encodes whole texts with begin and end ids and decodes them again.

    ``model_path`` is a vocabulary file that is installed on every executor.  With ``check`` each portion of rows is
    encoded and decoded by the library too, and a difference is an error that names the document.  Returns a row for each input
    row: doc_id, n_tokens (all ids), ids (packed as little-endian unsigned 32-bit integers, as token files hold them)
    and decoded.  Null and empty texts: begin and end only, decoded "".  Null ids stay null; other columns are not
    read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in (p for b in batches for p in portions(b)):
            texts = batch.column(1).to_pylist()
            inner, starts, decoded = c.encode_all(texts)
            at = starts + 2 * np.arange(len(texts) + 1)
            ids = np.empty(at[-1], "<u4")
            ids[at[:-1]], ids[at[1:] - 1] = c.begin, c.end
            inside = np.ones(len(ids), bool)
            inside[at[:-1]] = inside[at[1:] - 1] = False
            ids[inside] = inner
            if check:
                raw, ends = ids.tobytes(), (4 * at).tolist()
                his = c.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                for doc, a, b, want, own, text in zip(batch.column(0), ends, ends[1:], his, decoded, c.library.decode(his, num_threads=1), strict=False):
                    if as_bytes(want) != raw[a:b]:
                        raise ValueError(f"document {doc.as_py()}: the ids differ from the library's")
                    if text != own:
                        raise ValueError(f"document {doc.as_py()}: the decoded text differs from the library's")
            packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), packed, pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(lean(run), SCHEMA)
