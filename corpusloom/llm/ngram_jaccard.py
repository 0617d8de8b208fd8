"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. MinHash bands propose candidates; within a band bucket the MinHash
values of two texts are compared some at a time and the pair is dropped as soon as the posterior
probability (uniform prior) that its Jaccard similarity reaches the threshold falls under the
tolerance; what is left is verified on the full n-gram sets.

Texts with equal word sequences are one node with a weight, so copies never make pairs. A bucket or
class above ``block`` texts is dealt out as pairs of blocks (larger ones in very large classes), every pair of blocks
in its own group, so no group of rows is unbounded and none is cut short. Tasks return degrees and spanning edges, a
number of rows that is linear in what they read, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._graph import components
from corpusloom.llm._store import Scratch
from corpusloom.llm._text import U64, gram_hashes, gram_rows, mix, renamed, slices, split_words, text_buffer

STEP = 16


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * hashes + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
    return (r[:hashes] >> U64(32)).astype(np.uint32), (r[hashes:] >> U64(32)).astype(np.uint32) | np.uint32(1)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, number by row, 2 x 64-bit key of the word sequence by row). A text of fewer than n words is one shingle."""
    w = split_words(*text_buffer(texts), "alnum")
    at, counts = gram_rows(w.rows, n)
    g = gram_hashes(w.hashes, n)
    g = g[at] if len(at) else np.zeros(0, U64)
    words = w.counts
    pos = np.arange(len(w.hashes), dtype=U64) - np.repeat(w.rows[:-1], words).astype(U64)
    keys = np.zeros((2, len(words)), U64)
    full = words > 0
    with np.errstate(over="ignore"):
        if full.any():
            for k, c in enumerate((0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)):
                keys[k, full] = np.add.reduceat(mix(w.hashes + mix(pos + U64(c))), w.rows[:-1][full])
    short = np.flatnonzero(full & (words < n))
    if len(short):
        counts = counts.copy()
        counts[short] = 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), U64)
        rest = np.ones(len(out), bool)
        rest[ends[short] - 1] = False
        out[ends[short] - 1] = mix(keys[0, short])
        out[rest] = g
        g = out
    return g, counts, keys


def signatures(g: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """16-bit MinHash values, a row of ``hashes`` for each text; rows without shingles are zero."""
    out = np.zeros((len(counts), hashes), np.uint16)
    full = counts > 0
    if full.any():
        first = (np.cumsum(counts) - counts)[full]
        s = (g >> U64(32)).astype(np.uint32)
        xor, mul = _family(hashes)
        t = np.empty_like(s)
        low = np.empty((hashes, len(first)), np.uint32)
        for i in range(hashes):
            np.bitwise_xor(s, xor[i], out=t)
            np.multiply(t, mul[i], out=t)
            low[i] = np.minimum.reduceat(t, first)
        low *= np.uint32(0x9E3779B1)
        out[full] = (low >> np.uint32(16)).astype(np.uint16).T
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """Low bytes of all values of a row, then the high bytes, so that a prefix can be compared alone."""
    return np.concatenate([(sig & np.uint16(255)).astype(np.uint8), (sig >> np.uint16(8)).astype(np.uint8)], 1)


def unpacked(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half].astype(np.uint16) | (x[:, half:].astype(np.uint16) << np.uint16(8))


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values for which P(J >= threshold | matches) >= tolerance under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its upper tail is the chance of at most m successes in n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def prune(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs (i, j) of rows of x, those that survive the incremental comparison."""
    same = np.zeros(len(i), np.int32)
    chance = 1 / 256 if x.dtype == np.uint8 else 1 / 65536
    for at in range(0, x.shape[1], STEP):
        if not len(i):
            break
        to = min(at + STEP, x.shape[1])
        same += (x[i, at:to] == x[j, at:to]).sum(1, dtype=np.int32)
        ok = same >= least_matches(to, threshold + (1 - threshold) * chance, tolerance)
        i, j, same = i[ok], j[ok], same[ok]
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by repeated minimum over the edges."""
    r = np.arange(n)
    while len(i):
        m = np.minimum(r[i], r[j])
        was = r.copy()
        np.minimum.at(r, i, m)
        np.minimum.at(r, j, m)
        np.minimum.at(r, was[i], m)
        np.minimum.at(r, was[j], m)
        r = r[r]
        if np.array_equal(r, was):
            break
    return r


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by keys, many groups to a table; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last, size = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(b.schema.get_field_index(k)).to_numpy() for k in keys])
        cut = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1
        starts = last is not None and (cols[:, 0] != last).any()
        if held and (size > 4096 or sum(h.nbytes for h in held) > 1 << 24) and starts:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if (size + b.num_rows > 4096 or b.nbytes > 1 << 24) and len(cut):
            held.append(b.slice(0, cut[-1]))
            yield pa.Table.from_batches(held)
            held, size = [b.slice(cut[-1])], b.num_rows - cut[-1]
        else:
            held.append(b)
            size += b.num_rows
        last = cols[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _groups(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cols = np.stack([t.column(k).to_numpy() for k in keys])
    first = np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(0)]
    start = np.flatnonzero(first)
    return start, np.r_[start[1:], t.num_rows]


def _pairs(start: int, end: int, left: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group: all of one block, or those between its left and its right block."""
    if diagonal:
        i, j = np.triu_indices(end - start, 1)
        return i + start, j + start
    a, b = np.flatnonzero(left[start:end]) + start, np.flatnonzero(~left[start:end]) + start
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _candidates(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    start, end = _groups(t, keys)
    left, diag = t.column("left").to_numpy(), t.column("x").to_numpy() == t.column("y").to_numpy()
    out_i, out_j = [], []
    two = (end - start == 2) & diag[start]
    out_i.append(start[two])
    out_j.append(start[two] + 1)
    cross = (end - start == 2) & ~diag[start] & (left[start] != left[np.minimum(start + 1, len(left) - 1)])
    out_i.append(start[cross])
    out_j.append(start[cross] + 1)
    for s, e in zip(start[end - start > 2], end[end - start > 2]):
        i, j = _pairs(s, e, left, diag[s])
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _blocks(df: DataFrame, group: list[str], count: str, block: int, id_col: str) -> DataFrame:
    """Rows for each pair of blocks (x <= y) that a row's block belongs to; one pair (0, 0) for small groups. A row goes to as many
    places as its group has blocks, so groups beyond 32 blocks have blocks of up to eight times the size."""
    n = F.col(count)
    parts = F.when(n <= 32 * block, F.ceil(n / block)).otherwise(F.greatest(F.lit(32), F.ceil(n / (8 * block)))).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_col)), parts).cast("int")
    df = df.withColumn("parts", parts).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return df.select(*group, *[c for c in df.columns if c not in (*group, "parts", "own", "other", count)], F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"))


class NgramJaccard:
    """Near duplicates of ``docs``: word n-gram sets with Jaccard similarity of at least ``threshold``.

    Words are runs of ASCII letters (case-folded), digits and non-ASCII characters. A text with fewer
    than ``n`` words, but not none, is one n-gram of all its words. Texts without a word (null, empty,
    only punctuation) are like nothing, not even each other: each is a class of its own without links.
    Rows are documents: repeated rows are copies of each other. A null id stays null in the result, and
    such rows take part by their text (class ids are least non-null ids, null if there is none).
    ``classes`` and ``pairs`` read no other columns.

    The similar pairs of a group of n different texts are all looked at, block by block, since each of them
    counts as a link: the one work here that grows with the square of a group. It is dealt out, not cut.
    """

    def __init__(self, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, rows: int = 5, bands: int = 32, block: int = 256, spread: int = 64):
        self.n, self.threshold, self.tolerance, self.rows, self.bands, self.block, self.spread = n, threshold, tolerance, rows, bands, block, spread
        self.hashes = rows * bands

    # -- stages ---------------------------------------------------------------------------------

    def _signed(self, docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
        """(rid, id, k1, k2, n, sig): rid is the column ``row`` of docs, or a number given here."""
        n, hashes = self.n, self.hashes
        row = F.monotonically_increasing_id() if row is None else F.col(row)

        def work(batches):
            for b in batches:
                for s, e in slices(b.column(1)):
                    g, counts, keys = shingles(b.column(1).slice(s, e - s), n)
                    sig = signatures(g, counts, hashes)
                    ids, rids = b.column(0).slice(s, e - s), b.column(2).slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(counts), pa.array([x.tobytes() for x in packed(sig)], pa.binary()), rids], ["id", "k1", "k2", "n", "sig", "rid"])

        t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.alias("rid"))
        return t.mapInArrow(work, "id long, k1 long, k2 long, n long, sig binary, rid long")

    def _banded(self, reps: DataFrame) -> DataFrame:
        rows, bands = self.rows, self.bands

        def work(batches):
            for b in batches:
                sig = unpacked(_matrix(b.column(1), 2 * rows * bands, np.uint8)).astype(U64)
                with np.errstate(over="ignore"):
                    key = np.zeros((b.num_rows, bands), U64)
                    for q in range(rows):
                        key = key * U64(0x2545F4914F6CDD1D) + sig[:, q::rows][:, :bands] + U64(1)
                    key = mix(key + mix(np.arange(bands, dtype=U64) + U64(77)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(key.reshape(-1).view(np.int64))], ["rid", "key"])

        return reps.select("rid", "sig").mapInArrow(work, "rid long, key long")

    def _surviving(self, members: DataFrame) -> DataFrame:
        threshold, tolerance, hashes = self.threshold, self.tolerance, self.hashes
        keys = ["key", "x", "y"]

        def work(batches):
            for t in _runs(batches, keys):
                i, j = _candidates(t, keys)
                i, j = prune(_matrix(t.column("low"), hashes, np.uint8), i, j, threshold, tolerance)
                r = roots(t.num_rows, i, j)
                k = np.flatnonzero(r != np.arange(len(r)))
                ids = t.column("rid").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[r[k]])], ["a", "b"])

        parts = members.repartition(*keys).sortWithinPartitions(*keys)
        return parts.mapInArrow(work, "a long, b long").distinct()

    def _verified(self, blocks: DataFrame, pairs: bool) -> DataFrame:
        threshold, tolerance, hashes = self.threshold, self.tolerance, self.hashes
        keys = ["comp", "x", "y"]

        def work(batches):
            for t in _runs(batches, keys):
                i, j = _candidates(t, keys)
                i, j = prune(unpacked(_matrix(t.column("sig"), 2 * hashes, np.uint8)), i, j, threshold, tolerance)
                sets = [np.frombuffer(s, U64) for s in t.column("grams").to_pylist()]
                size = np.array([len(s) for s in sets])
                o = np.argsort(i, kind="stable")
                i, j = i[o], j[o]
                like = np.zeros(len(i))
                ends = np.cumsum(size)
                _, flat = np.unique(np.concatenate(sets), return_inverse=True)
                mark_of = np.zeros(int(flat.max()) + 1, bool)
                cut = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
                for s, e in zip(cut, np.r_[cut[1:], len(i)]) if len(i) else ():
                    a = i[s]
                    own = flat[ends[a] - size[a] : ends[a]]
                    mark_of[own] = True
                    for q in range(s, e):
                        b = j[q]
                        both = int(np.count_nonzero(mark_of[flat[ends[b] - size[b] : ends[b]]]))
                        like[q] = both / (size[a] + size[b] - both)
                    mark_of[own] = False
                ok = like >= threshold
                i, j, like = i[ok], j[ok], like[ok]
                ids, weight = t.column("rid").to_numpy(), t.column("copies").to_numpy()
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(like)], ["a", "b", "similarity"])
                    continue
                links = np.zeros(t.num_rows, np.int64)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                r = roots(t.num_rows, i, j)
                k = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[r[k]]), pa.array(links[k])], ["a", "b", "links"])

        parts = blocks.repartition(*keys).sortWithinPartitions(*keys)
        return parts.mapInArrow(work, "a long, b long, similarity double" if pairs else "a long, b long, links long")

    def _run(self, docs: DataFrame, id_col: str, text_col: str, pairs: bool, scratch: Scratch, row: str | None = None):
        """(signed rows, texts, verified links or pairs)"""
        signed = scratch.save(self._signed(docs, id_col, text_col, row), "signed")
        reps = scratch.save(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.min("id").alias("id"), F.count("*").alias("copies")), "reps")
        own = signed.where("n > 0").select("rid", "n", "sig").join(reps.select("rid"), "rid")
        own = scratch.save(own, "own")
        bands = scratch.save(self._banded(own), "bands")
        counts = bands.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
        low = own.select("rid", F.substring("sig", 1, self.hashes).alias("low"))
        members = _blocks(bands.join(counts, "key"), ["key"], "cnt", self.block, "rid").join(low, "rid")
        comp = components(self._surviving(members), scratch)
        scratch.drop(bands)
        comp = scratch.save(comp.select(F.col("node").alias("rid"), F.col("root").alias("comp")).union(comp.select(F.col("root").alias("rid"), F.col("root").alias("comp")).distinct()), "comp")
        sizes = comp.groupBy("comp").agg(F.count("*").alias("cnt"))
        info = comp.join(sizes, "comp").join(reps.select("rid", "k1", "k2", "copies"), "rid").join(own.select("rid", "sig"), "rid")
        grams = self._gram_sets(docs, text_col, comp.join(reps, "rid").select("k1", "k2"))
        blocks = _blocks(info.join(grams, ["k1", "k2"]).drop("k1", "k2"), ["comp"], "cnt", self.block, "rid")
        found = scratch.save(self._verified(blocks, pairs), "found")
        scratch.drop(own, comp)
        return signed, reps, found

    def _gram_sets(self, docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
        """(k1, k2, grams): the set of n-gram hashes of each wanted text, once.

        A bit table of fixed size, filled from the wanted keys, keeps most other texts from being dealt out;
        it only saves work, the join decides.
        """
        n, bits = self.n, 1 << 24
        filled = wanted.select(F.pmod("k1", F.lit(bits)).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w"))
        filled = filled.agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v"))
        table = np.zeros(bits // 64, np.int64)
        got = filled.toArrow()  # at most bits / 64 rows
        table[got["w"].to_numpy()] = got["v"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

        def work(batches):
            bit = np.frombuffer(shared.value, np.int64).view(U64)
            given: set[tuple[int, int]] = set()
            for b in batches:
                for s, e in slices(b.column(0)):
                    g, counts, keys = shingles(b.column(0).slice(s, e - s), n)
                    first = np.cumsum(counts) - counts
                    slot = keys[0] & U64(bits - 1)
                    k = np.flatnonzero((counts > 0) & ((bit[slot >> U64(6)] >> (slot & U64(63))) & U64(1)).astype(bool))
                    if len(given) > 1 << 18:
                        given.clear()
                    names = list(zip(keys[0, k].tolist(), keys[1, k].tolist()))
                    new = np.zeros(len(k), bool)
                    for i, name in enumerate(names):
                        if name not in given:
                            given.add(name)
                            new[i] = True
                    k = k[new]
                    grams = pa.array([np.unique(g[f : f + c]).tobytes() for f, c in zip(first[k], counts[k])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0, k].view(np.int64)), pa.array(keys[1, k].view(np.int64)), grams], ["k1", "k2", "grams"])

        # A task gives a text's set once. Copies from different tasks meet in two steps, so that a text which all tasks
        # hold sends each place of the first step a share of them, and the second step no more than ``spread`` of its sets.
        sets = docs.select(text_col).mapInArrow(work, "k1 long, k2 long, grams binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(self.spread)))
        some = sets.groupBy("k1", "k2", "salt").agg(F.first("grams").alias("grams"))
        return some.join(wanted.distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("grams").alias("grams"))

    # -- results --------------------------------------------------------------------------------

    def _roots(self, found: DataFrame, scratch: Scratch) -> DataFrame:
        """(node, root) of the texts that have links; roots are nodes too."""
        root = components(found.select("a", "b"), scratch)
        return root.union(root.select(F.col("root").alias("node"), "root").distinct())

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A row for each row of docs: its id, ``class_id`` (least id of the class) and ``n_links`` (similar rows, copies included)."""
        scratch = Scratch(docs.sparkSession, "ngram-jaccard")
        signed, reps, found = self._run(docs, id_col, text_col, False, scratch)
        links = found.groupBy("a").agg(F.sum("links").alias("links"))
        known = self._roots(found, scratch)
        ids = reps.select(F.col("rid").alias("node"), "id")
        least = known.join(ids, "node").groupBy("root").agg(F.min("id").alias("class_id"))
        node = known.join(least, "root").select(F.col("node").alias("rid"), "class_id")
        info = reps.join(node, "rid", "left").join(links.withColumnRenamed("a", "rid"), "rid", "left")
        info = info.select("k1", "k2", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        like = signed.where("n > 0").select("id", "k1", "k2").join(info, ["k1", "k2"])
        alone = signed.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return like.select("id", "class_id", "n_links").union(alone).withColumnRenamed("id", id_col)

    def firsts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of docs, one of each class: the one with the least id (rows without an id come last), of rows with one
        id that which comes first in docs. Rows are told apart as rows, so different texts under one id are not taken
        for each other. Texts without a word are classes of their own and all stay."""
        scratch = Scratch(docs.sparkSession, "ngram-jaccard")
        src, back = renamed(docs)
        at = dict(zip(back, src.columns))
        rows = scratch.save(src.withColumn("_row", F.monotonically_increasing_id()), "rows")
        signed, reps, found = self._run(rows, at[id_col], at[text_col], False, scratch, "_row")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best")
        best = scratch.save(signed.where("n > 0").groupBy("k1", "k2").agg(first, F.min("rid").alias("node")), "best")
        of = best.select("node", "best").join(self._roots(found, scratch), "node", "left")
        kept = of.groupBy(F.coalesce("root", "node").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.rid").alias("_row"))
        kept = kept.union(signed.where("n = 0").select(F.col("rid").alias("_row")))
        return rows.join(kept, "_row", "left_semi").select(*src.columns).toDF(*back)

    def pairs(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(similar pairs of different texts: two text ids and the exact similarity; membership: row id, text id)."""
        signed, reps, found = self._run(docs, id_col, text_col, True, Scratch(docs.sparkSession, "ngram-jaccard"))
        names = reps.select("rid", F.col("id").alias("text_id"))
        out = found.select(F.col("a").alias("rid"), "b", "similarity").join(names, "rid").select(F.col("text_id").alias("left_id"), F.col("b").alias("rid"), "similarity")
        out = out.join(names, "rid").select("left_id", F.col("text_id").alias("right_id"), "similarity")
        member = signed.where("n > 0").join(reps.select("k1", "k2", F.col("id").alias("text_id")), ["k1", "k2"]).select(F.col("id").alias(id_col), "text_id")
        return out, member
