"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string (signs of random projections of the centred vector) and is
a sorted array of these strings. A query descends each tree to its longest matching prefix, then all
trees ascend together, one symbol at a time, until the vectors that share a prefix of that length with
it in any tree are enough; these are ranked by their exact distance.

The index is sharded: each shard of rows is a forest of its own, every row is in one, and a query asks
all of them. Rows and queries are dealt out together by shard; a task builds a shard's forest when its rows
have passed and then lets the queries stream by, so it holds a shard of bounded size and a batch of
queries, and neither rows nor queries come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors in double precision) of the rows that take part: dim finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.zeros(len(column), np.int64)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    n[ok] = column.drop_null().value_lengths().to_numpy()
    rows = np.flatnonzero(ok & (n == dim))
    if not len(rows) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


@dataclass
class Forest:
    """Sorted hash strings of a block of vectors, tree by tree."""

    centre: np.ndarray
    planes: np.ndarray  # trees x bits x dim
    keys: np.ndarray | None = None
    order: np.ndarray | None = None

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def strings(self, x: np.ndarray) -> np.ndarray:
        trees, bits, dim = self.planes.shape
        weight = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        out = np.empty((len(x), trees), np.uint64)
        for lo in range(0, len(x), 2048):
            side = (x[lo : lo + 2048] - self.centre) @ self.planes.reshape(-1, dim).T > 0
            out[lo : lo + 2048] = (side.reshape(-1, trees, bits) * weight).sum(2, dtype=np.uint64)
        return out

    def build(self, x: np.ndarray) -> Forest:
        s = self.strings(x)
        order = np.argsort(s, axis=0, kind="stable")
        return Forest(self.centre, self.planes, np.take_along_axis(s, order, 0).T.copy(), order.T.copy())

    def candidates(self, strings: np.ndarray, enough: int, suffices=None):
        """For each query (its strings, a row of trees): places of the vectors found, at least ``enough`` if there are,
        and more until ``suffices(query, places)`` if that is given."""
        trees, n = self.keys.shape
        bits = self.bits
        seen = np.zeros(n, bool)
        lo, hi = np.zeros((bits + 1, len(strings), trees), np.int64), np.full((bits + 1, len(strings), trees), n)
        for level in range(1, bits + 1):
            shift = np.uint64(bits - level)
            low = (strings >> shift) << shift
            top = low + ((np.uint64(1) << shift) - np.uint64(1))
            for t in range(trees):
                lo[level, :, t] = np.searchsorted(self.keys[t], low[:, t], "left")
                hi[level, :, t] = np.searchsorted(self.keys[t], top[:, t], "right")
        sizes = (hi - lo).sum(2)
        for q in range(len(strings)):
            level = int(np.flatnonzero(sizes[:, q] >= min(enough, n))[-1])
            while True:
                seen[:] = False
                for t in range(trees):
                    seen[self.order[t, lo[level, q, t] : hi[level, q, t]]] = True
                found = np.flatnonzero(seen)
                if level == 0 or (len(found) >= enough and (suffices is None or suffices(q, found))):
                    break
                level -= 1
            yield found


def nearest(names: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest different names, ties to the smaller; a name that occurs more than once counts at its least distance."""
    o = np.lexsort((names, d))
    names, d = names[o], d[o]
    _, first = np.unique(names, return_index=True)
    first = np.sort(first)[:k]
    return names[first], d[first]


class PrefixForest:
    """The k nearest neighbours (Euclidean) of query rows among all rows.

    Rows whose vector is null, zero, or holds a null or non-finite component, or has another length than
    the most frequent one, take no part, nor do rows without an id. A row with the query's id is not its neighbour;
    rows repeated with one id count once, at their least distance. Of query rows with one id the one with the
    least vector asks. Fewer candidates than k give fewer rows, no query gives none.

    ``fit`` learns the centre and how far to ascend from at most about ``sample`` different rows (chosen by hash of
    id and vector; documented bound): the least share of a shard to gather for which the recall on the sample reaches
    ``recall``. All rows are indexed, in shards of about ``block`` different rows each; tables that would make fewer
    than 64 shards are dealt out in smaller ones.
    """

    def __init__(self, k: int = 10, trees: int = 48, bits: int = 24, sample: int = 6000, recall: float = 0.97, block: int = 65536, seed: int = 11):
        self.k, self.trees, self.bits, self.sample, self.recall, self.block, self.seed = k, trees, bits, sample, recall, block, seed
        self.dim, self.share, self.forest, self.rows = 0, 1.0, None, 0

    def _clean(self, rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """(id, v) of the rows that take part, repeats included."""
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        t = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        return t.where((F.size(v) == self.dim) & F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0))

    def fit(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> PrefixForest:
        key = F.xxhash64(F.col(id_col), F.col(vec_col))
        dims = rows.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("u")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
        if not dims:
            return self
        self.dim, self.rows = dims[0].d, dims[0].u
        part = self._clean(rows, id_col, vec_col)
        if self.rows > self.sample:
            part = part.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(self.sample / self.rows * (1 << 30)))
        got = part.dropDuplicates(["id", "v"]).select("id", "v").toArrow()
        _, x = usable(got["v"], self.dim)
        names = got["id"].to_numpy()
        rng = np.random.default_rng(self.seed)
        planes = rng.standard_normal((self.trees, self.bits, self.dim))
        self.forest = Forest(x.mean(0) if len(x) else np.zeros(self.dim), planes)
        if len(x) > 2 * self.k:
            built = self.forest.build(x)
            ask = rng.permutation(len(x))[:150]
            own = names[ask]
            true = []
            for q in ask:
                other = np.flatnonzero(names != names[q])
                true.append(nearest(names[other], ((x[other] - x[q]) ** 2).sum(1), self.k)[0])
            strings = self.forest.strings(x[ask])
            suffices = lambda q, f: len(np.unique(names[f][names[f] != own[q]])) >= self.k
            for self.share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0):
                found = built.candidates(strings, int(self.share * len(x)) + self.k + 1, suffices)
                if np.mean([np.isin(t, names[f]).mean() if len(t) else 1.0 for t, f in zip(true, found)]) >= self.recall:
                    break
        return self

    def search(self, rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """query_id, rank (from 1), the neighbour's id, score (its distance)."""
        spark = rows.sparkSession
        if self.forest is None:
            return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
        shards = max(1, -(-self.rows // self.block), min(64, self.rows // 4096))
        # Repeated rows are one before they are dealt out, so no shard is large by them.
        held = self._clean(rows, id_col, vec_col).dropDuplicates(["id", "v"])
        held = held.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
        asked = self._clean(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
        # No more tasks than shards: as many more would be empty.
        dealt = held.union(asked).repartition(min(shards, 1 << 16), "shard").sortWithinPartitions("shard", "asks")
        best = dealt.mapInArrow(self._worker(spark), "query_id long, id long, score double")
        best = best.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", F.col("id").alias(id_col), "score")

    def _worker(self, spark):
        shared, k, share, dim = spark.sparkContext.broadcast(self.forest), self.k, self.share, self.dim

        def ask(built, names, x, repeated, ids, queries):
            """(query ids, names, distances) of each query's k nearest of one shard."""
            strings = built.strings(queries)
            out = []
            for lo in range(0, len(ids), 512):
                own = ids[lo : lo + 512]
                # Different ids are counted where ids repeat; elsewhere the number of rows is theirs.
                suffices = (lambda q, f: len(np.unique(names[f][names[f] != own[q]])) >= k) if repeated else None
                for q, found in enumerate(built.candidates(strings[lo : lo + 512], int(share * len(x)) + k + 1, suffices), lo):
                    found = found[names[found] != ids[q]]
                    d = x[found] - queries[q]
                    d = np.sqrt((d * d).sum(1))
                    name = names[found]
                    if not repeated and len(d) > 2 * k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        name, d = name[near], d[near]
                    name, d = nearest(name, d, k)
                    out.append((np.full(len(d), ids[q]), name, d))
            return [np.concatenate(c) for c in zip(*out)]

        def work(batches):
            forest = shared.value
            shard, held, built = None, [], None
            for b in batches:
                _, x = usable(b.column(3), dim)  # all rows are
                shards, asks, ids = (b.column(i).to_numpy() for i in range(3))
                cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])])
                for s, e in zip(cuts, np.r_[cuts[1:], len(ids)]):
                    if shards[s] != shard:
                        shard, held, built = shards[s], [], None
                    if not asks[s]:
                        held.append((ids[s:e], x[s:e]))
                        continue
                    if built is None:
                        if not held:
                            continue
                        names, rows = (np.concatenate(c) for c in zip(*held))
                        built, repeated, held = forest.build(rows), len(np.unique(names)) < len(names), [held[0]]
                    for lo in range(s, e, 4096):
                        hi = min(e, lo + 4096)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in ask(built, names, rows, repeated, ids[lo:hi], x[lo:hi])], ["query_id", "id", "score"])

        return work
