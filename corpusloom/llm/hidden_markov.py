"""A hidden Markov language model, trained by Baum-Welch and scored by the scaled forward recursion.

Symbols are the most frequent words, 64 classes of the other words, and the end of a text. A text's
probability is the product of the model's probability of its symbols (all state paths summed) and the
probability of each other word within its class, which gives unseen words their share, so it is one
distribution over all texts.

Word counts, class counts and the expected counts of every round cover all training texts; partitions
add theirs up before anything is dealt out, and only sums of a fixed size reach the driver. What is
sent to the executors is bounded by frequency: at most 1/share words have more than that share of the
tokens. Other words are looked up by a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, small_batches
from corpusloom.llm._text import slices, split_words, text_buffer

CLASSES = 64
END = np.int64(0x0F1E2D3C4B5A6978)
SYMBOL_SHARE, KNOWN_SHARE = 1 << 15, 1 << 21
SEGMENT, LONG = 256, 2048
CHUNK = 1024
PRIOR = 0.1


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, offsets of rows) of the tokens of each row; each row ends with the end token."""
    w = split_words(*text_buffer(texts), "nonspace")
    n = len(w.counts)
    last = w.buf[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    cls = (last & np.uint8(31)) | np.where(w.ends - w.starts >= 8, np.uint8(32), np.uint8(0))
    h = np.insert(w.hashes.view(np.int64), w.rows[1:], END)
    c = np.insert(cls, w.rows[1:], 0)
    return h, c, w.rows + np.arange(n + 1)


@dataclass
class Lexicon:
    """Counts of the frequent words, sorted by hash; the first ``symbols`` of them by frequency have a symbol each."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray  # -1: none
    symbols: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, c):
        return np.log10((c + PRIOR) / (self.tokens + PRIOR * (self.distinct + 1)))

    def class_base(self) -> np.ndarray:
        return self.class_tokens + PRIOR * (self.class_words + 1)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many of the sequences, sorted by falling length, are longer than t, for each t."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), "right")


def _by_time(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences sorted by falling size: how many are active at each time, where each time's rows begin when all rows
    lie time by time, and the token that each row is."""
    active = _active(size)
    top = np.r_[0, np.cumsum(active)]
    at = np.arange(top[-1]) - np.repeat(top[:-1], active)
    return active, top, begin[at] + np.repeat(np.arange(len(active)), active)


def _segments(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of SEGMENT tokens of the sequences ``rows``: begin, size, sequence (its place in rows), number in the sequence."""
    lengths = np.diff(offsets)[rows]
    pieces = -(-lengths // SEGMENT)
    own = np.repeat(np.arange(len(rows)), pieces)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[rows][own] + nth * SEGMENT
    return begin, np.minimum(SEGMENT, offsets[rows + 1][own] - begin), own, nth


def _transfer(m: Hmm, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, logs) of segments: row i of a matrix, times 10 to the log of that row, are the weights of ending in each
    state after the segment's tokens when the token before was in state i."""
    k = len(m.start)
    order = np.argsort(-size, kind="stable")
    a, log = np.tile(np.eye(k), (len(size), 1, 1)), np.zeros((len(size), k))
    for t, n in enumerate(_active(size[order])):
        step = (a[:n].reshape(-1, k) @ m.move).reshape(n, k, k) * m.emit[ids[begin[order[:n]] + t]][:, None, :]
        total = step.sum(2)
        a[:n] = step / total[:, :, None]
        log[:n] += np.log10(total)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return a[back], log[back]


def _borders(m: Hmm, ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray, backward: bool = True):
    """Of long sequences: their segments (as of _segments), the state distribution at each one's end given all tokens so far,
    the weights of all tokens after it by its last state (up to a factor), and the log10 of each sequence's probability."""
    begin, size, own, nth = _segments(offsets, rows)
    k = len(m.start)
    whole, log = _transfer(m, ids, begin[nth > 0], size[nth > 0])
    place = np.cumsum(nth > 0) - 1
    ends, after, total = np.zeros((len(own), k)), np.ones((len(own), k)), np.zeros(len(rows))
    heads = np.flatnonzero(nth == 0)
    first = m.start * m.emit[ids[begin[heads]]]
    scale = first.sum(1)
    first /= scale[:, None]
    total += np.log10(scale)
    rest, more = _transfer(m, ids, begin[heads] + 1, size[heads] - 1)
    for r, h in enumerate(heads):
        v, log_v = first[r], total[r]
        last = heads[r + 1] if r + 1 < len(heads) else len(own)
        for p in range(h, last):
            a, lg = (rest[r], more[r]) if p == h else (whole[place[p]], log[place[p]])
            top = lg[v > 0].max()
            v = (v * 10 ** (lg - top)) @ a
            s = v.sum()
            v, log_v = v / s, log_v + top + math.log10(s)
            ends[p] = v
        total[r] = log_v
        if backward:
            for p in range(last - 1, h, -1):
                a, lg = whole[place[p]], log[place[p]]
                w = 10 ** (lg - lg.max()) * (a @ after[p])
                after[p - 1] = w / w.sum()
    return begin, size, own, nth, ends, after, total


def expect(m: Hmm, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected (starts, moves, emissions) of sequences (none is empty), and their log-likelihood.

    Sequences of up to LONG tokens are worked whole, all at once and time by time. Longer ones are worked in segments
    that begin and end with the exact weights of all that lies before and after them, so nothing is cut.
    """
    k = len(m.start)
    lengths = np.diff(offsets)
    begin, size = offsets[:-1][lengths <= LONG], lengths[lengths <= LONG]
    before = np.zeros((len(begin), k))  # the state distribution before the first token; unused for whole sequences
    after = np.ones((len(begin), k))
    whole = np.ones(len(begin), bool)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        b, s, own, nth, ends, rest, _ = _borders(m, ids, offsets, long)
        prior = np.r_[np.zeros((1, k)), ends[:-1]]
        begin, size, whole = np.r_[begin, b], np.r_[size, s], np.r_[whole, nth == 0]
        before, after = np.r_[before, prior], np.r_[after, rest]
    order = np.argsort(-size, kind="stable")
    begin, size, before, after, whole = begin[order], size[order], before[order], after[order], whole[order]
    active, top, token = _by_time(begin, size)
    own = ids[token]
    emit = m.emit.astype(np.float32)[own]
    move = m.move.astype(np.float32)
    alpha, scale = np.empty((len(token), k), np.float32), np.empty(len(token), np.float32)
    a = np.where(whole[:, None], m.start, before @ m.move).astype(np.float32)
    for t, n in enumerate(active):
        row = slice(top[t], top[t] + n)
        x = np.multiply(a if t == 0 else a[:n] @ move, emit[row], out=alpha[row])
        s = np.einsum("ij->i", x)
        scale[row] = s
        x /= s[:, None]
        a = x
    # b weighs all tokens after by state, scaled so that alpha times b sums to 1 at every token.
    moves = np.zeros((k, k))
    b = np.empty((0, k), np.float32)
    emit /= scale[:, None]
    for t in range(len(active) - 1, -1, -1):
        n, row = active[t], slice(top[t], top[t] + active[t])
        if len(b) < n:
            new = after[len(b) : n]
            new = new / (alpha[top[t] + len(b) : top[t] + n] * new).sum(1, keepdims=True)
            b = np.concatenate([b, new.astype(np.float32)])
        e = b * emit[row]
        if t:
            moves += alpha[top[t - 1] : top[t - 1] + n].T @ e
        else:
            moves += before[~whole].T @ e[~whole]
        alpha[row] *= b
        if t:
            b = e @ move.T
    alpha /= np.einsum("ij->i", alpha)[:, None]
    emitted = np.stack([np.bincount(own, alpha[:, i], minlength=len(m.emit)) for i in range(k)], 1)
    return alpha[: len(whole)][whole].sum(0, dtype=np.float64), moves * m.move, emitted, float(np.log(scale.astype(np.float64)).sum())


def reestimate(starts, moves, emitted, unigram: np.ndarray, weight: float = 20.0) -> Hmm:
    """Normalised expected counts, each state's emissions smoothed by ``weight`` tokens of the unigram distribution."""
    emit = emitted + weight * unigram[:, None]
    return Hmm((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))


def likelihood(m: Hmm, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 of the exact probability of each sequence (none is empty).

    The forward recursion runs over all sequences of a batch at once. Long sequences are cut into segments,
    of which each gives the matrix from the state before it to the state at its end; their product is the same sum.
    """
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths))
    short = np.flatnonzero(lengths <= LONG)
    if len(short):
        order = short[np.argsort(-lengths[short], kind="stable")]
        active, top, token = _by_time(offsets[order], lengths[order])
        emit = m.emit[ids[token]]
        scale = np.empty(len(token))
        a = m.start[None, :]
        for t, n in enumerate(active):
            row = slice(top[t], top[t] + n)
            x = np.multiply(a if t == 0 else a[:n] @ m.move, emit[row], out=emit[row])
            s = np.einsum("ij->i", x)
            scale[row] = s
            x /= s[:, None]
            a = x
        at = np.arange(len(token)) - np.repeat(top[:-1], active)
        out[order] = np.bincount(at, np.log10(scale), minlength=len(order))
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        out[long] = _borders(m, ids, offsets, long, backward=False)[-1]
    return out


def _as_chunks(x: np.ndarray):
    flat = np.zeros(-(-x.size // CHUNK) * CHUNK)
    flat[: x.size] = x.reshape(-1)
    rows = flat.reshape(-1, CHUNK)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "counts"])


class HiddenMarkovModel:
    """Learns from the rows of ``docs`` that ``train`` marks and scores all rows.

    Text is case-folded (A-Z) and cut at ASCII white space; the end of a text is a token. Null and empty
    texts are the end token alone. A null mark counts as false. Repeated rows count and score as often as they occur. Without any training
    text every token is unseen. A first guess comes from at most ``burn_in`` tokens (and a text more) of training texts
    (chosen by hash; documented bound); whatever the size of the table, rounds that count all training texts, whole,
    then go on until one raises the log-likelihood by less than ``least_gain`` of itself, or for ``rounds`` if given.
    """

    def __init__(self, states: int = 8, rounds: int | None = None, burn_in: int = 1_000_000, burn_rounds: int = 30, seed: int = 5, least_gain: float = 1e-4):
        self.states, self.rounds, self.burn_in, self.burn_rounds, self.seed, self.least_gain = states, rounds, burn_in, burn_rounds, seed, least_gain
        self.history: list[float] = []  # log-likelihood of all training texts at the begin of each round

    def count(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(h, cls, c): every distinct training token with its count."""

        def work(batches):
            held, size = [], 0

            def packed(parts):
                h, c, n = (np.concatenate(x) for x in zip(*parts))
                u, first, inv = np.unique(h, return_index=True, return_inverse=True)
                return u, c[first], np.bincount(inv, n, minlength=len(u)).astype(np.int64)

            for b in batches:
                for s, e in slices(b.column(0)):
                    h, c, _ = words_of(b.column(0).slice(s, e - s))
                    u, first, n = np.unique(h, return_index=True, return_counts=True)
                    held.append((u, c[first], n))
                    size += len(u)
                    if size > 3_000_000:
                        held = [packed(held)]
                        size = len(held[0][0])
                        if size > 2_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][0], held[0][1].astype(np.int32), held[0][2])], ["h", "cls", "c"])
                            held, size = [], 0
            if held:
                u, c, n = packed(held)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int32)), pa.array(n)], ["h", "cls", "c"])

        rows = docs.select(text_col).mapInArrow(work, "h long, cls int, c long")
        return rows.groupBy("h").agg(F.max("cls").alias("cls"), F.sum("c").alias("c"))

    def lexicon(self, counts: DataFrame) -> Lexicon:
        r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        tokens, distinct = int(r[0]), int(r[1])
        top = counts.where(F.col("c") * F.lit(KNOWN_SHARE) > F.lit(tokens)).toArrow()  # fewer than KNOWN_SHARE rows
        h, c = top["h"].to_numpy(), top["c"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]
        often = c * SYMBOL_SHARE > tokens
        symbol = np.full(len(h), -1, np.int32)
        symbol[often] = np.arange(often.sum())
        rest = counts.where(F.col("c") * F.lit(SYMBOL_SHARE) <= F.lit(tokens)).groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
        n = np.zeros((2, CLASSES))
        for x in rest:
            n[:, x.cls] = x.c, x.n
        return Lexicon(h, c, symbol, int(often.sum()), tokens, distinct, n[0], n[1])

    def encode(self, docs: DataFrame, lex, id_col: str, text_col: str, train: Column) -> DataFrame:
        """A row for each text: its symbols (2 bytes each), sums over frequent words, and the words to look up."""

        def work(batches):
            x = lex.value
            in_class = np.log10(x.class_base())
            base = x.base(x.counts)
            for b in batches:
                for s, e in slices(b.column(2)):
                    h, cls, off = words_of(b.column(2).slice(s, e - s))
                    at = np.searchsorted(x.hashes, h)
                    at[at == len(x.hashes)] = 0
                    known = x.hashes[at] == h if len(x.hashes) else np.zeros(len(h), bool)
                    sym = np.where(known, x.symbol[at], -1) if len(x.hashes) else np.full(len(h), -1)
                    ids = np.where(sym >= 0, sym, x.symbols + cls.astype(np.int64)).astype(np.uint16)
                    add = lambda v: np.add.reduceat(v, off[:-1])
                    base_sum = add(np.where(known, base[at], 0.0)) if len(x.hashes) else np.zeros(e - s)
                    within = add(np.where(known & (sym < 0), np.log10(x.counts[at] + PRIOR) - in_class[cls], 0.0)) if len(x.hashes) else np.zeros(e - s)
                    rare = np.flatnonzero(~known)
                    row = np.searchsorted(off, rare, "right") - 1
                    cuts = np.searchsorted(row, np.arange(e - s + 1))
                    looked = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(h[rare]), pa.array(cls[rare].astype(np.int32))], ["h", "cls"]))
                    raw = ids.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array(np.diff(off), pa.int64()), pa.array(add(known.astype(np.int64))), pa.array(base_sum), pa.array(within), pa.array([raw[2 * i : 2 * j] for i, j in zip(off[:-1], off[1:])], pa.binary()), looked],
                        ["doc_id", "train", "n", "known", "base", "within", "ids", "rare"],
                    )

        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
        schema = "doc_id long, train boolean, n long, known long, base double, within double, ids binary, rare array<struct<h: long, cls: int>>"
        return src.mapInArrow(work, schema).withColumn("rid", F.monotonically_increasing_id())

    def learn(self, coded: DataFrame, lex: Lexicon) -> Hmm:
        symbols, k = lex.symbols + CLASSES, self.states
        unigram = np.zeros(symbols)
        unigram[lex.symbol[lex.symbol >= 0]] = lex.counts[lex.symbol >= 0]
        unigram[lex.symbols :] = lex.class_tokens
        unigram = (unigram + 0.5) / (unigram + 0.5).sum()
        rng = np.random.default_rng(self.seed)
        emit = unigram[:, None] * rng.uniform(0.2, 1.8, (symbols, k))
        m = Hmm(np.full(k, 1 / k), 0.9 * np.eye(k) + 0.1 / k, emit / emit.sum(0))
        learnable = coded.where("train").select("ids")
        rate = min(1.0, self.burn_in / max(lex.tokens, 1))
        dice = F.pmod(F.xxhash64("rid"), F.lit(1 << 30))
        # Sizes first: of the texts drawn, those with the least numbers, up to burn_in tokens.
        drawn = coded.where("train").where(dice < int(rate * (1 << 30))).select(dice.alias("dice"), "n").toArrow()
        order = np.argsort(drawn["dice"].to_numpy(), kind="stable")
        within = int(np.searchsorted(np.cumsum(drawn["n"].to_numpy()[order]), self.burn_in)) + 1
        some = []
        if len(order):
            last = int(drawn["dice"].to_numpy()[order][:within][-1])
            some = [bytes(r.ids) for r in coded.where("train").where(dice <= last).select("ids").collect()]
        if some:
            ids, off = np.frombuffer(b"".join(some), np.uint16).astype(np.int64), np.cumsum([0] + [len(x) // 2 for x in some])
            for _ in range(self.burn_rounds):
                m = reestimate(*expect(m, ids, off)[:3], unigram)
        spark = coded.sparkSession
        size = k + k * k + symbols * k + 1

        def work(shared):
            def count(batches):
                m = shared.value
                total = np.zeros(size)
                for b in batches:
                    raw = b.column(0).to_pylist()
                    held, n = [], 0
                    for x in [*raw, None]:
                        if held and (x is None or n > 1 << 20):
                            ids, off = np.frombuffer(b"".join(held), np.uint16).astype(np.int64), np.cumsum([0] + [len(y) // 2 for y in held])
                            s, mv, em, ll = expect(m, ids, off)
                            total += np.concatenate([s, mv.reshape(-1), em.reshape(-1), [ll]])
                            held, n = [], 0
                        if x is not None:
                            held.append(x)
                            n += len(x)
                yield _as_chunks(total)

            return count

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[c] = total.get(c, 0) + np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

        schema = "chunk int, counts binary"
        self.history = []
        while self.rounds is None or len(self.history) < self.rounds:
            shared = spark.sparkContext.broadcast(m)
            rows = learnable.mapInArrow(work(shared), schema).repartition("chunk").mapInArrow(add, schema).collect()
            shared.unpersist()
            total = np.zeros(-(-size // CHUNK) * CHUNK)
            for r in rows:
                total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts)
            if not total.any():
                break
            m = reestimate(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : size - 1].reshape(symbols, k), unigram)
            self.history.append(float(total[size - 1]))
            if self.rounds is None and len(self.history) > 1 and self.history[-1] - self.history[-2] < -self.least_gain * self.history[-2]:
                break
        return m

    def run(self, docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
        spark = docs.sparkSession
        small_batches(spark)
        scratch = Scratch(spark, "hmm")
        counts = scratch.save(self.count(docs.where(F.coalesce(train, F.lit(False))), text_col), "counts")
        lex = self.lexicon(counts)
        coded = scratch.save(self.encode(docs, spark.sparkContext.broadcast(lex), id_col, text_col, train), "coded")
        model = spark.sparkContext.broadcast(self.learn(coded, lex))

        def forward(batches):
            m = model.value
            for b in batches:
                raw = b.column(1).to_pylist()
                out = np.zeros(len(raw))
                at = 0
                while at < len(raw):
                    to, n = at, 0
                    while to < len(raw) and (to == at or n + len(raw[to]) < 1 << 21):
                        n += len(raw[to])
                        to += 1
                    off = np.cumsum([0] + [len(x) // 2 for x in raw[at:to]])
                    out[at:to] = likelihood(m, np.frombuffer(b"".join(raw[at:to]), np.uint16).astype(np.int64), off)
                    at = to
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["rid", "lm"])

        c = F.coalesce("c", F.lit(0))
        whole = F.lit(float(lex.tokens + PRIOR * (lex.distinct + 1)))
        in_class = F.element_at(F.array(*[F.lit(float(x)) for x in lex.class_base()]), F.col("cls") + 1)
        rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.h", "r.cls").groupBy("rid", "h").agg(F.max("cls").alias("cls"), F.count("*").alias("tf"))
        looked = rare.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known_r"), F.sum(F.col("tf") * F.log10((c + PRIOR) / whole)).alias("base_r"), F.sum(F.col("tf") * F.log10((c + PRIOR) / in_class)).alias("within_r"))
        lm = coded.select("rid", "ids").mapInArrow(forward, "rid long, lm double")
        zero = lambda x: F.coalesce(F.col(x), F.lit(0))
        out = coded.select("rid", "doc_id", "train", "n", "known", "base", "within").join(lm, "rid").join(looked, "rid", "left")
        return out.select("doc_id", "train", F.col("n").alias("n_tokens"), (F.col("known") + zero("known_r")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("base_r")).alias("base_score"), (F.col("lm") + F.col("within") + zero("within_r")).alias("score"))
