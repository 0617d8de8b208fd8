"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target texts and one of the raw texts that they were
chosen from, give each text a log importance weight, the ratio of its probabilities; adding Gumbel noise to
the log weights and keeping the k largest draws k texts without replacement in proportion to their weights.

The models are of presence: a text draws each hashed n-gram at most once, so length and repetition do
not drown a few telling n-grams. N-grams are words, their first 4 and 5 bytes, runs of symbols, word pairs, and
4-grams of marks that say of each word whether it repeats the one before. The log ratio of an n-gram is shrunk
by the posterior probability that it is a telling one, so that the many which differ by chance weigh next to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, small_batches
from corpusloom.llm._text import U64, ddl, mix, renamed, slices, split_words, text_buffer

WORDS, PAIRS, MARKS = 1 << 20, 1 << 16, 4
STEMS = 1 << 18
SPACE = WORDS + PAIRS + STEMS + (1 << MARKS)
CHUNK = 1024
#: Log ratios below this are not summed; a million of them would not move a weight by a thousandth.
NOTHING = 1e-9


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram, repeats included, and a key of each row's words.

    Buckets: words and symbols, pairs, stems, marks of repetition."""
    buf, off = text_buffer(texts)
    w, s = split_words(buf, off, "alnum"), split_words(buf, off, "symbol")
    rw, rs = np.repeat(np.arange(len(w.counts), dtype=np.uint32), w.counts), np.repeat(np.arange(len(s.counts), dtype=np.uint32), s.counts)
    parts = [(rw, w.hashes >> U64(44)), (rs, mix(s.hashes) >> U64(44))]
    if len(rw) > 1:
        same = rw[1:] == rw[:-1]
        with np.errstate(over="ignore"):
            pair = mix(w.hashes[:-1] * U64(0x9E3779B97F4A7C15) + w.hashes[1:]) >> U64(48)
        parts.append((rw[1:][same], pair[same] + U64(WORDS)))
        again = (same & (w.hashes[1:] == w.hashes[:-1])).astype(U64)
    if len(rw) > MARKS:
        inside = rw[MARKS:] == rw[:-MARKS]
        code = np.zeros(len(rw) - MARKS, U64)
        for j in range(MARKS):
            code = code * U64(2) + again[j : j + len(code)]
        parts.append((rw[MARKS:][inside], code[inside] + U64(WORDS + PAIRS + STEMS)))
    for n in (4, 5):
        at = np.flatnonzero(w.ends - w.starts > n)
        if len(at):
            x = np.zeros(len(at), U64)
            for j in range(n):
                x = (x << U64(8)) | LOWER[buf[w.starts[at] + j]]
            parts.append((rw[at], (mix(x) >> U64(46)) + U64(WORDS + PAIRS)))
    key = np.zeros(len(w.counts), U64)
    full = w.counts > 0
    if full.any():
        with np.errstate(over="ignore"):
            key[full] = np.add.reduceat(w.hashes, w.rows[:-1][full])
    return np.concatenate([r for r, _ in parts]), np.concatenate([b.astype(np.uint32) for _, b in parts]), key


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, bucket) once."""
    wide = np.uint64 if len(row) and int(row.max()) >= (1 << 32) // SPACE else np.uint32
    key = np.sort(row.astype(wide) * wide(SPACE) + bucket)
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key // wide(SPACE)).astype(np.int64), (key % wide(SPACE)).astype(np.int64)


SIZE = -(-(SPACE + 1) // CHUNK) * CHUNK


LOWER = np.arange(256, dtype=U64)
LOWER[0x41:0x5B] += U64(0x20)


def chunks(n: np.ndarray):
    """Non-zero stretches of a 2 x SIZE count array as rows."""
    for lo in range(0, SIZE, CHUNK * 32):
        at = [c for c in range(lo // CHUNK, min(lo // CHUNK + 32, SIZE // CHUNK)) if n[0, c * CHUNK : (c + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.ascontiguousarray(n[:, c * CHUNK : (c + 1) * CHUNK]).tobytes() for c in at], pa.binary())], ["chunk", "counts"])


def gumbel(ids: np.ndarray, texts_key: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise fixed by id, text and seed."""
    with np.errstate(over="ignore"):
        u = mix(mix(ids.astype(np.int64).view(U64) + U64(seed)) ^ texts_key)
    u = ((u >> U64(11)).astype(np.float64) + 0.5) / 2**53
    return -np.log(-np.log(u))


def log_beta(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) for a, b in zip(x, y)])


def log_ratios(seen: np.ndarray, raw: np.ndarray, target: int, total: int, prior: float, telling: float) -> np.ndarray:
    """Of n-grams that ``seen`` of ``target`` texts hold and ``raw`` of ``total``: the log of the ratio of their chances, times
    the posterior probability that target texts and the others differ in them, of which ``telling`` is the prior."""
    pairs, back = np.unique(np.stack([seen, raw], 1), axis=0, return_inverse=True)
    a, n = pairs[:, 0].astype(float), pairs[:, 1].astype(float)
    rest, b, h = total - target, n - a, np.full(len(pairs), 0.5)
    scale = total / target
    ratio = np.log((a + prior) / (target + 2 * prior)) - np.log((n + prior * scale) / (total + 2 * prior * scale))
    apart = log_beta(a + h, target - a + h) + log_beta(b + h, rest - b + h)
    alike = log_beta(n + h, total - n + h) + log_beta(h, h)
    odds = np.exp(np.clip(alike - apart, -700, 700)) * (1 - telling) / telling
    return (ratio / (1 + odds))[back.reshape(-1)]


class ImportanceResampler:
    """Scores and samples texts by how much likelier they are among target texts than among the raw ones.

    Target texts are those of the labelled rows with quality 1 and toxic 0 in every label row; of the different
    labelled ids, at most about ``max_labels`` are used (chosen by hash; the bound of what is broadcast). The raw
    texts are all of these, so what tells depends on the labels and not on how many texts have none.
    ``prior`` are pseudo-texts with and without an n-gram, ``telling`` is the share of n-grams thought to tell.
    As many texts are drawn as have a log weight of ``cut`` or more, at ``temperature`` 1 in proportion to their weights.

    Null or empty texts have no n-gram and weight 0. A null id is never labelled. Repeated rows are scored alike and
    drawn alike, so ties beyond k only come from them. Without any target label, or without any other, all weights are 0.
    """

    def __init__(self, prior: float = 0.5, telling: float = 1e-3, cut: float = -1.0, temperature: float = 1.0, seed: int = 7, max_labels: int = 50_000):
        self.prior, self.telling, self.cut, self.temperature, self.seed, self.max_labels = prior, telling, cut, temperature, seed, max_labels
        self.ratio: np.ndarray | None = None

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ImportanceResampler:
        spark = docs.sparkSession
        small_batches(spark)
        lab = labels.select(F.col("doc_id").alias("lid"), "quality", "toxic").where("lid is not null")
        lab = lab.groupBy("lid").agg(F.coalesce((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0), F.lit(False)).alias("good"))
        total = lab.count()
        if total > self.max_labels:
            lab = lab.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 30)) < int(self.max_labels / total * (1 << 30)))
        src = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(lab), "lid").select("text", "good")

        def count(batches):
            n = np.zeros((2, SIZE), np.int64)
            for b in batches:
                good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                for s, e in slices(b.column(0)):
                    row, bucket = distinct(*grams(b.column(0).slice(s, e - s))[:2])
                    n[0, :SPACE] += np.bincount(bucket, minlength=SPACE)
                    n[1, :SPACE] += np.bincount(bucket[good[s:e][row]], minlength=SPACE)
                n[0, SPACE] += b.num_rows
                n[1, SPACE] += good.sum()
            yield from chunks(n)

        def add(batches):
            total = np.zeros((2, SIZE), np.int64)
            for b in batches:
                for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[:, c * CHUNK : (c + 1) * CHUNK] += np.frombuffer(x, np.int64).reshape(2, CHUNK)
            yield from chunks(total)

        schema = "chunk int, counts binary"
        counts = src.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
        n = np.zeros((2, SIZE))
        for r in counts.collect():  # SIZE counts in all, whatever the input
            n[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.counts, np.int64).reshape(2, CHUNK)
        total, target = int(n[0, SPACE]), int(n[1, SPACE])
        self.counts = n
        self.ratio = np.zeros(SPACE, np.float32)
        if 0 < target < total:
            at = np.flatnonzero(n[0, :SPACE])
            self.ratio[at] = log_ratios(n[1, at], n[0, at], target, total, self.prior, self.telling)
        return self

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: str = "log_weight", draw: str = "draw") -> DataFrame:
        """docs with two columns more: the log weight and the draw (the weight at the temperature, with Gumbel noise). No column may
        have their names already (ValueError); ``weight`` and ``draw`` take others. ``sample`` and ``judged`` take any columns."""
        small_batches(docs.sparkSession)
        src, back = renamed(docs)
        if {weight.lower(), draw.lower()} & {c.lower() for c in back}:
            raise ValueError(f"docs already has a column named {weight} or {draw}")
        i_id, i_text = back.index(id_col), back.index(text_col)
        ratio, temperature, seed = docs.sparkSession.sparkContext.broadcast(self.ratio), self.temperature, self.seed

        def work(batches):
            lam = ratio.value
            for b in batches:
                for s, e in slices(b.column(i_text)):
                    texts = b.column(i_text).slice(s, e - s)
                    row, bucket, key = grams(texts)
                    weighs = np.abs(lam[bucket]) > NOTHING
                    row, bucket = distinct(row[weighs], bucket[weighs])
                    weight = np.bincount(row, lam[bucket], minlength=e - s).astype(float)
                    ids = b.column(i_id).slice(s, e - s).cast(pa.int64()).fill_null(-1).to_numpy()
                    draw = weight / temperature + gumbel(ids, key, seed)
                    yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in b.columns] + [pa.array(weight), pa.array(draw)], [*b.schema.names, "_w", "_d"])

        return src.mapInArrow(work, ddl(src) + ", _w double, _d double").toDF(*back, weight, draw)

    def kth_draw(self, scored: DataFrame, k: int, bins: int = 4096, draw: str = "draw") -> float:
        """The k-th largest draw, found exactly: the range that holds it is cut into bins, counted, and narrowed to one of
        them until all its draws are equal. Only counts of bins reach the driver."""
        if k <= 0:
            return float("inf")
        r = scored.agg(F.count(draw), F.min(draw), F.max(draw)).first()
        if r[0] < k:
            return float("-inf")
        rest, low, high = k, r[1], r[2]
        while low < high:
            place = F.least(F.floor((F.col(draw) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
            here = scored.where(F.col(draw).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(draw).alias("low"), F.max(draw).alias("high"))
            for x in sorted(here.collect(), key=lambda x: -x.bin):
                if rest <= x.n:
                    low, high = x.low, x.high
                    break
                rest -= x.n
        return low

    def threshold(self, scored: DataFrame, weight: str = "log_weight", draw: str = "draw") -> float:
        """Draws from here on are the sample: k is the number of texts whose log weight reaches ``cut``."""
        return self.kth_draw(scored, scored.where(F.col(weight) >= self.cut).count(), draw=draw)

    def judged(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, log_weight, draw, kept for each row of docs; scored once and written, without the texts."""
        scored = self.score(docs.select(id_col, text_col), id_col, text_col).drop(text_col)
        scored = Scratch(docs.sparkSession, "importance").save(scored, "scores")
        return scored.withColumn("kept", F.col("draw") >= self.threshold(scored))

    def sample(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of docs that are drawn, with their columns as they were; scored once and written with the texts."""
        src, back = renamed(docs)
        at = dict(zip(back, src.columns))
        scored = self.score(src, at[id_col], at[text_col], "_weight", "_draw")
        scored = Scratch(docs.sparkSession, "importance").save(scored, "scored")
        return scored.where(F.col("_draw") >= self.threshold(scored, "_weight", "_draw")).select(*src.columns).toDF(*back)
