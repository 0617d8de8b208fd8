"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled into a normaliser (a byte transducer of the longest-match rewrite rules, then the
white-space rules), a piece transducer (a trie read from the last character, whose final states put out a
piece with its negated score as weight) and a byte-fallback transducer (of the characters that no piece is). An input, composed
with them, is a graph of arcs between its places; the encoding is its shortest path in the tropical semiring.

For a unigram model any arc may follow any other. A BPE model has a fourth machine in the composition, whose
states remember the piece before: two pieces may follow each other only if merging their joint characters gives back
just these two, and a path may begin with a piece only if merging its characters gives it back. A sequence of pieces
is the BPE encoding of its text if and only if each piece and each neighbouring pair in it passes: merges that
cross no border never depend on what lies beyond it, so the first wrong merge of the whole would be a wrong merge of
two neighbours. Every beginning of the text has one encoding, so just one arc into each place is left, and the shortest path
is the BPE encoding, whatever the weights. The composition is made as far as the search asks for it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import small_batches
from corpusloom.llm._text import ddl, renamed, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0
FINAL = None
INFINITE = float("inf")


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message; values are ints, floats or bytes."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", raw, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", raw, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


def charsmap_rules(blob: bytes) -> dict[bytes, bytes]:
    """Rewrite rules of a precompiled map: a double-array trie over bytes, whose values point into a table of outputs."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist()
    table = blob[4 + size :]
    rules: dict[bytes, bytes] = {}

    def offset(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)

    stack = [(0, b"")]
    while stack:
        node, key = stack.pop()
        base = node ^ offset(units[node])
        for c in range(1, 256):
            to = base ^ c
            if to < len(units) and (units[to] & (1 << 31 | 255)) == c:
                if (units[to] >> 8) & 1:
                    value = units[to ^ offset(units[to])] & ((1 << 31) - 1)
                    rules[key + bytes([c])] = table[value : table.index(b"\0", value)]
                stack.append((to, key + bytes([c])))
    return rules


class Transducer:
    """A trie: arcs by symbol, and what a final state puts out."""

    def __init__(self, entries):
        self.start: dict = {}
        for symbols, output in entries:
            state = self.start
            for x in symbols:
                state = state.setdefault(x, {})
            state[FINAL] = output

    def longest(self, symbols, at: int):
        """(length, output) of the longest entry that begins at a place; (0, None) without one."""
        state, best = self.start, (0, None)
        for i in range(at, len(symbols)):
            state = state.get(symbols[i])
            if state is None:
                break
            if FINAL in state:
                best = i + 1 - at, state[FINAL]
        return best


@dataclass
class PieceFst:
    """The compiled machine. ``encode_ids`` and ``decode_ids`` work on one text; ``texts``/``tokens`` on DataFrames."""

    pieces: list[tuple[str, float, int]]
    bpe: bool
    rules: dict[bytes, bytes] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = False
    escape: bool = True
    byte_fallback: bool = True
    cache_size: int = 400_000

    @classmethod
    def compile(cls, raw: bytes) -> PieceFst:
        pieces, trainer, normalizer = [], {}, {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for tag, value in _fields(raw):
            if tag == 1:
                p = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                pieces.append((p[1].decode(), p[2], p[3]))
            elif tag == 2:
                trainer |= dict(_fields(value))
            elif tag == 3:
                normalizer |= dict(_fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2):
            raise ValueError(f"only unigram and BPE models are supported, not {kind}")
        return cls(pieces, kind == 2, charsmap_rules(normalizer[2]), bool(normalizer[3]), bool(normalizer[4]), bool(normalizer[5]), any(p[2] == BYTE for p in pieces))

    def __post_init__(self):
        usable = [(i, p) for i, p in enumerate(self.pieces) if p[2] in (NORMAL, USER) and p[0]]
        self.ids = {p[0]: i for i, p in usable}
        self.scores = [p[1] for p in self.pieces]
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes_of = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.least = min((p[1] for _, p in usable), default=0.0)
        #: No piece goes on after these characters, or begins before them: paths can be cut there.
        self.cut_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut_line = not any("\n" in p and len(p) > 1 for p in self.ids)
        #: Neighbouring characters that some piece holds. No piece spans any others, so paths can be cut between them.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.width = np.dtype(np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32)
        self.out = [b"" if p[2] == CONTROL else bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else b" \xe2\x81\x87 " if p[2] == UNKNOWN else p[0].replace(SPACE, " ").encode() for p in self.pieces]
        self.code = {p: np.array([k], self.width).tobytes() for p, k in self.ids.items()}
        self.normaliser = Transducer(self.rules.items())
        weight = {p: 0.1 - len(p) * self.least if self.pieces[k][2] == USER else -self.scores[k] for p, k in self.ids.items()}
        self.machine = Transducer((p[::-1], (p, w)) for p, w in weight.items())
        #: Weight of a character that is no piece and falls back to its bytes (or the unknown piece).
        self.fallback = UNK_PENALTY - self.least
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._units: dict[str, bytes] = {}

    # -- normaliser -----------------------------------------------------------------------------

    def _rewrite(self, text: str) -> str:
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            n, to = self.normaliser.longest(raw, at)
            if n:
                out.append(to)
                at += n
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out.append(raw[at : at + n])
                at += n
        return b"".join(out).decode()

    def normalise(self, text: str) -> str:
        if self.rules:
            text = self._rewrite(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # -- shortest path --------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging the best pair (leftmost of equals) again and again leaves."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: str, b: str) -> bool:
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) > self.cache_size:
                self._pairs.clear()
            ok = self._pairs[a, b] = self._merged(a + b) == [a, b]
        return ok

    def _arcs(self, text: str, end: int) -> list[tuple[int, str, float]]:
        """The arcs of the composition that end at a place: (begin, piece, weight), the longest last."""
        state, at, out = self.machine.start, end, []
        while at:
            state = state.get(text[at - 1])
            if state is None:
                break
            at -= 1
            arc = state.get(FINAL)
            if arc is not None:
                out.append((at, *arc))
        if not out or out[0][0] != end - 1:
            out.insert(0, (end - 1, text[end - 1], self.fallback))
        return out

    def _path(self, text: str) -> list[str]:
        """The shortest path through the composition of the text with the machines, from its end.

        Places are worked when an arc begins at them. Of a BPE model only one arc into a place passes, so arcs are tried
        longest first, and places that no such arc begins at are never looked at.
        """
        bpe, pairs, follows, arcs_to = self.bpe, self._pairs.get, self._follows, self._arcs
        n = len(text)
        cost: list[float] = [0.0] + [INFINITE] * n
        last: list[str | None] = [None] * (n + 1)  # the piece of the best arc into each place that is worked
        open_ = [(n, arcs_to(text, n))]  # places that wait for the places where their arcs begin
        while open_:
            end, arcs = open_[-1]
            while arcs:
                at, piece, weight = arcs[-1]
                if not bpe:
                    ok = True
                elif at:
                    before = last[at]
                    if before is None:
                        break
                    ok = pairs((before, piece))
                    if ok is None:
                        ok = follows(before, piece)
                else:
                    ok = end == 1 or self._whole(piece)
                if at and last[at] is None:
                    break
                arcs.pop()
                if ok and cost[at] + weight < cost[end]:
                    cost[end], last[end] = cost[at] + weight, piece
                    if bpe:
                        break
            else:
                if last[end] is None:
                    raise AssertionError("an encoding exists for every text")
            if last[end] is not None and (bpe or not arcs):
                open_.pop()
            else:
                open_.append((at, arcs_to(text, at)))
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def _whole(self, p: str) -> bool:
        ok = self._alone.get(p)
        if ok is None:
            ok = self._alone[p] = self._merged(p) == [p]
        return ok

    def _ids(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for p in path:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out.extend(self.bytes_of[b] for b in p.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _chunk(self, chunk: str) -> bytes:
        got = self._cache.get(chunk)
        if got is None:
            if len(self._cache) >= self.cache_size:
                self._cache.clear()
            if self.bpe and len(chunk) > 2 and chunk[-1] in ".,;:!?" and (stem := self._cache.get(chunk[:-1])) and self._follows(self._last(stem), chunk[-1]):
                # Two encodings whose border pieces may follow each other are the encoding of both texts together.
                got = stem + self._chunk(chunk[-1])
            elif self.bpe or self.byte_fallback:
                joined, units, at = self.joined, [], 0
                for i in range(1, len(chunk)):
                    if chunk[i - 1 : i + 1] not in joined:
                        units.append(chunk[at:i])
                        at = i
                units.append(chunk[at:])
                unit, known = self._unit, self._units.get
                got = b"".join([known(u) or unit(u) for u in units])
            else:
                got = self._unit(chunk)
            if len(chunk) <= 64:
                self._cache[chunk] = got
        return got

    def _last(self, ids: bytes) -> str:
        """The last piece of an encoding; a byte piece, which no other piece may join, counts as a character of its own."""
        p = self.pieces[int.from_bytes(ids[-self.width.itemsize :], "little")]
        return p[0] if p[2] in (NORMAL, USER) else "\0"

    def _unit(self, text: str) -> bytes:
        path = self._path(text)
        if self.byte_fallback:
            code = self.code.get
            got = b"".join([code(p) or np.array(self._ids([p]), self.width).tobytes() for p in path])
        else:
            got = np.array(self._ids(path), self.width).tobytes()
        if len(text) <= 32:
            if len(self._units) >= self.cache_size:
                self._units.clear()
            self._units[text] = got
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of the encoding as little-endian integers of ``width``."""
        s = self.normalise(text or "")
        if not s:
            return b""
        if not (self.cut_space and (self.bpe or self.byte_fallback)):
            return self._chunk(s)
        cache, chunk = self._cache, self._chunk
        out: list[bytes] = []
        if self.cut_line and "\n" in s:
            lines = s.split("\n")
            newline = chunk("\n")
        else:
            lines, newline = [s], b""
        for i, line in enumerate(lines):
            if i:
                out.append(newline)
            first, *rest = line.split(SPACE)
            if first:
                out.append(chunk(first))
            spaces = SPACE
            for w in rest:
                if w:
                    w = spaces + w
                    out.append(cache.get(w) or chunk(w))
                    spaces = SPACE
                else:
                    spaces += SPACE
            if len(spaces) > 1:
                out.append(chunk(spaces[1:]))
        return b"".join(out)

    def encode_ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), self.width).tolist()

    def decode_bytes(self, ids: bytes) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD; the space of the dummy prefix goes."""
        table = self.out
        s = b"".join([table[i] for i in np.frombuffer(ids, self.width).tolist()]).decode("utf-8", "replace")
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s

    def decode_ids(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, self.width).tobytes())


def load(path: str) -> PieceFst:
    """The machine of a model file on the driver."""
    with open(path, "rb") as f:
        return PieceFst.compile(f.read())


def tokenise(docs: DataFrame, fst: PieceFst, text_col: str = "text", out: str = "tokens", decoded: str | None = None) -> DataFrame:
    """docs with a binary column of token ids (little-endian, 2 bytes for vocabularies up to 65,536, else 4)
    and, if ``decoded`` names a column, the text read back from them. Null and empty texts have no token. No column may have these names already (ValueError)."""
    small_batches(docs.sparkSession)
    if {x.lower() for x in (out, decoded) if x} & {c.lower() for c in docs.columns}:
        raise ValueError("docs already has a column of that name")
    src, back = renamed(docs)
    at = back.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fst)
    schema = ddl(src) + ", _t binary" + (", _d string" if decoded else "")

    def work(batches):
        m = shared.value
        for b in batches:
            for s, e in slices(b.column(at)):
                ids = [m.encode_bytes(t) for t in b.column(at).slice(s, e - s).to_pylist()]
                more = [pa.array(ids, pa.binary())] + ([pa.array([m.decode_bytes(x) for x in ids], pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in b.columns] + more, [*b.schema.names, "_t", *(["_d"] if decoded else [])])

    return src.mapInArrow(work, schema).toDF(*back, out, *([decoded] if decoded else []))


def token_count(tokens: str, fst: PieceFst):
    return (F.octet_length(tokens) / fst.width.itemsize).cast("long")
