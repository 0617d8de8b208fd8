"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least k-gram hash of each window of w consecutive k-grams, so two
texts that share k + w - 1 words share a fingerprint. Training and test fingerprints are tables that are joined;
each hit is extended word by word in both directions, compared byte by byte, and a span of at least ``window``
words is an occurrence of a test window. Test items shorter than that are windows as a whole; they are their
own (single) k-gram of that length, looked for among all k-grams of that length.

Before the join a bit table of bounded size, filled from the test fingerprints, drops most fingerprints of
texts that share none; it only saves work, the join decides. Nothing else of the test set leaves its tables.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, small_batches
from corpusloom.llm._text import U64, Words, ddl, gram_hashes, gram_rows, mix, renamed, slices, split_words, text_buffer

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += np.uint8(0x20)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for j in range(1, w):
        np.minimum(out, x[j : j + len(out)], out=out)
    return out


def fingerprints(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the selected k-grams, all k-gram hashes): those that are the least of some window within their row."""
    g = gram_hashes(words.hashes, k)
    at, _ = gram_rows(words.rows, k + w - 1)
    if not len(at):
        return np.zeros(0, np.int64), g
    least = sliding_least(g, w)[at]
    chosen = np.zeros(len(g), bool)
    for j in range(w):
        chosen[at[g[at + j] == least] + j] = True
    return np.flatnonzero(chosen), g


def keyed(h: np.ndarray, kind: int) -> np.ndarray:
    """Join keys of k-gram hashes: kind 0 is a fingerprint, kind n a short item of n words."""
    with np.errstate(over="ignore"):
        return mix(h + U64(kind) * U64(0xC13FA9A902A6328F))


class Text:
    """The words of one text: their hashes, and their bytes, case-folded and with one space between."""

    def __init__(self, text: str):
        w = split_words(*text_buffer(pa.array([text], pa.large_string())), "alnum")
        self.hashes = w.hashes
        size = w.ends - w.starts + 1
        self.at = np.r_[0, np.cumsum(size)]
        take = np.arange(self.at[-1]) - np.repeat(self.at[:-1] - w.starts, size)
        self.bytes = LOWER[np.r_[w.buf, np.uint8(32)][take]]
        self.bytes[self.at[1:] - 1] = 32

    def span(self, s: int, e: int) -> bytes:
        return self.bytes[self.at[s] : self.at[e]].tobytes()


def extend(text: Text, item: Text, hits: list[dict], window: int) -> list[tuple[int, int]]:
    """Spans of the text's words that occur in the item, of at least ``window`` words or the whole item: hits (places ps in
    the text, qs in the item) grown to their full length. A place that a longer match covers is not grown again."""
    n, m = len(text.hashes), len(item.hashes)
    need, out = min(window, m), []
    covered = np.zeros(n + m + 1, np.int64)  # by p - q: matches so far end here
    for hit in hits:
        ps = np.array(hit["ps"], np.int64)
        for q in hit["qs"]:
            for p in ps[covered[ps - q + m] <= ps].tolist():
                back, ahead = min(p, q), min(n - p, m - q)
                same = text.hashes[p - back : p + ahead] == item.hashes[q - back : q + ahead]
                while same[back]:
                    gaps = np.flatnonzero(~same)
                    at = int(np.searchsorted(gaps, back))
                    s = p - back + (int(gaps[at - 1]) + 1 if at else 0)
                    e = p - back + (int(gaps[at]) if at < len(gaps) else len(same))
                    covered[p - q + m] = e
                    if e - s < need:
                        break
                    if text.span(s, e) == item.span(s - p + q, e - p + q):
                        out.append((s, e))
                        break
                    # Different words of one hash: take their bytes instead, once.
                    same = np.array([text.span(p + i, p + i + 1) == item.span(q + i, q + i + 1) for i in range(-back, ahead)])
    return out


def united(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], e)
        else:
            out.append({"s": s, "e": e})
    return out


def _lists(keys: np.ndarray, places: np.ndarray) -> list[dict]:
    """{key, ps} for each different key, keys and places ascending."""
    o = np.lexsort((places, keys))
    keys, places = keys[o], places[o]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return [{"key": int(k), "ps": p.tolist()} for k, p in zip(keys[cut].view(np.int64), np.split(places, cut[1:]))] if len(keys) else []


class Winnowing:
    """Finds the words of texts that lie in an occurrence of a window of a test item.

    Words are runs of ASCII letters (case-folded), digits and non-ASCII characters. Every shared span
    of at least ``window`` words is found, whatever lies around it. Null, empty and wordless texts have
    no words and no hits; null or wordless items have no window. Repeated rows give repeated results,
    items with equal texts are all named (an id that is null counts as the string "null"). Columns of docs
    that are kept may have any names but those of the results.

    A fingerprint that very many texts share is dealt out ``spread`` ways; its items are repeated as often.
    The bit table has at most ``most_bits`` bits.
    """

    def __init__(self, window: int = 13, k: int = 8, share: int = 20, spread: int = 16, most_bits: int = 1 << 27):
        if not 1 <= k <= window:
            raise ValueError("k must lie between 1 and the window")
        self.window, self.k, self.share, self.spread, self.most_bits = window, k, share, spread, most_bits

    def _item_prints(self, items: DataFrame) -> DataFrame:
        """(tid, kind, key, qs): the fingerprints of each item, with their places."""
        window, k = self.window, self.k

        def work(batches):
            for b in batches:
                rows = []
                for tid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = split_words(*text_buffer(pa.array([text], pa.large_string())), "alnum")
                    n = len(w.hashes)
                    if n >= window:
                        at, g = fingerprints(w, k, window - k + 1)
                        rows += [(tid, 0, x["key"], x["ps"]) for x in _lists(keyed(g[at], 0), at)]
                    elif n:
                        rows.append((tid, n, int(keyed(gram_hashes(w.hashes, n), n).view(np.int64)[0]), [0]))
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["tid", "kind", "key", "qs"])

        return items.select("tid", "text").mapInArrow(work, "tid long, kind int, key long, qs array<long>")

    def _scanned(self, docs: DataFrame, text_col: str, keep: list[str], prints: DataFrame) -> DataFrame:
        """The kept columns, n_words, rid, prints array<struct<key, ps>> of what may be shared, and the text where there is any."""
        kinds = sorted(r.kind for r in prints.select("kind").distinct().collect())  # at most one for each length up to the window
        total = prints.count()
        # Some thousand bits for each fingerprint, as a text has hundreds, any of which may hit a bit by chance.
        bits = 1 << min(self.most_bits.bit_length() - 1, max(24, (4096 * total).bit_length()))
        filled = prints.select(F.pmod("key", F.lit(bits)).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w"))
        filled = filled.agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v"))
        table = np.zeros(bits // 64, np.int64)
        got = filled.toArrow()  # at most bits / 64 rows
        table[got["w"].to_numpy()] = got["v"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
        window, k, n_keep = self.window, self.k, len(keep)
        where = keep.index(text_col) if text_col in keep else n_keep + 1

        def work(batches):
            bit = np.frombuffer(shared.value, np.int64).view(U64)

            def may(keys):
                slot = keys & U64(bits - 1)
                return ((bit[slot >> U64(6)] >> (slot & U64(63))) & U64(1)).astype(bool)

            for b in batches:
                for s, e in slices(b.column(where)):
                    texts = b.column(where).slice(s, e - s)
                    w = split_words(*text_buffer(texts), "alnum")
                    found = []
                    for kind in kinds:
                        if kind:
                            at, _ = gram_rows(w.rows, kind)
                            keys = keyed(gram_hashes(w.hashes, kind)[at], kind) if len(at) else np.zeros(0, U64)
                        else:
                            at, g = fingerprints(w, k, window - k + 1)
                            keys = keyed(g[at], 0)
                        ok = may(keys)
                        found.append((at[ok], keys[ok]))
                    at, keys = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, U64))
                    row = np.searchsorted(w.rows, at, "right") - 1
                    lists: list = [None] * (e - s)
                    order = np.argsort(row, kind="stable")
                    at, keys, row = at[order], keys[order], row[order]
                    cuts = np.searchsorted(row, np.arange(e - s + 1))
                    for r in np.flatnonzero(np.diff(cuts)):
                        lists[r] = _lists(keys[cuts[r] : cuts[r + 1]], at[cuts[r] : cuts[r + 1]] - w.rows[r])
                    shown = pc.if_else(pa.array([x is not None for x in lists]), texts, pa.scalar(None, texts.type))
                    more = [pa.array(w.counts, pa.int64()), b.column(n_keep).slice(s, e - s), pa.array(lists, pa.list_(pa.struct([("key", pa.int64()), ("ps", pa.list_(pa.int64()))]))), shown]
                    yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in b.columns[:n_keep]] + more, [*keep, "n_words", "_rid", "_prints", "_text"])

        src = docs.select(*keep, F.monotonically_increasing_id().alias("_rid"), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
        schema = f"{ddl(docs.select(*keep))}, n_words long, _rid long, _prints array<struct<key: long, ps: array<long>>>, _text string"
        return src.mapInArrow(work, schema)

    def _salted(self, many: DataFrame, few: DataFrame, key: str) -> DataFrame:
        """many joined to few; rows of one key are dealt out ``spread`` ways."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1)))
        return many.withColumn("salt", F.pmod("rid", F.lit(self.spread)).cast("int")).join(few.withColumn("salt", salts), [key, "salt"]).drop("salt")

    def _extended(self, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """(rid, hits, items): a row for each text with an occurrence. A task lets the texts stream by, each before its hits."""
        window = self.window

        def work(batches):
            rid = text = None
            spans, names = [], set()
            item = lru_cache(maxsize=64)(Text)

            def done():
                return {"rid": rid, "hits": united(spans), "items": sorted(names)} if names else None

            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["rid"] != rid:
                        out.append(done())
                        rid, spans, names = r["rid"], [], set()
                    if r["item"] is None:
                        text = Text(r["text"])
                        continue
                    found = extend(text, item(r["text"]), r["hits"], window)
                    if found:
                        spans += found
                        names.add(r["item"])
                yield as_rows([x for x in out if x])
            yield as_rows([x for x in [done()] if x])

        def as_rows(rows):
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            return pa.RecordBatch.from_pylist(rows, pa.schema([("rid", pa.int64()), ("hits", span), ("items", pa.list_(pa.string()))]))

        none = F.lit(None)
        kind = "array<struct<ps: array<long>, qs: array<long>>>"
        rows = texts.select("rid", none.cast("string").alias("item"), "text", none.cast(kind).alias("hits")).union(hits.select("rid", "item", "text", F.col("hits").cast(kind)))
        rows = rows.repartition("rid").sortWithinPartitions("rid", F.asc_nulls_first("item"))
        return rows.mapInArrow(work, "rid long, hits array<struct<s: long, e: long>>, items array<string>")

    def spans(self, docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """A row for each row of docs: the kept columns (by default the id), n_words, hits array<struct<s, e>> (word
        places, e exclusive, disjoint and ascending) and items array<string> (sorted)."""
        spark = docs.sparkSession
        small_batches(spark)
        keep = [id_col] if keep is None else keep
        scratch = Scratch(spark, "winnowing")
        items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).where("text is not null")
        items = scratch.save(items.withColumn("tid", F.monotonically_increasing_id()), "items")
        prints = scratch.save(self._item_prints(items), "prints")
        seen = scratch.save(self._scanned(docs, text_col, keep, prints), "scanned")
        some = seen.where("_prints is not null")
        mine = some.select(F.col("_rid").alias("rid"), F.explode("_prints").alias("x")).select("rid", "x.key", "x.ps")
        pairs = self._salted(mine, prints.select("key", "tid", "qs"), "key").groupBy("rid", "tid").agg(F.collect_list(F.struct("ps", "qs")).alias("hits"))
        hits = self._salted(pairs, items, "tid").select("rid", "item", "text", "hits")
        found = self._extended(some.select(F.col("_rid").alias("rid"), F.col("_text").alias("text")), hits)
        found = scratch.save(found.withColumnRenamed("rid", "_rid"), "found")
        got = seen.where("_prints is not null").drop("_prints", "_text").join(found, "_rid", "left").select(*keep, "n_words", "hits", "items")
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name in ("hits", "items")]
        every = seen.where("_prints is null").select(*keep, "n_words", *none).union(got)
        empty = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("hits", "items")]
        return every.select(*keep, "n_words", *empty)

    def report(self, docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
        """The spans of ``spans`` as counts: n_hit, n_items, items_sha256 and whether hits make up 1/share of the words or more."""
        return self.judged(self.spans(docs, tests, id_col, **names)).select(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

    def judged(self, found: DataFrame) -> DataFrame:
        hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
        found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
        found = found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        return found.withColumn("contaminated", (F.col("n_hit") > 0) & (self.share * F.col("n_hit") >= F.col("n_words")))

    def clean(self, docs: DataFrame, tests: DataFrame, text_col: str = "text", **names) -> DataFrame:
        """The rows of docs that are not contaminated, with their columns as they were."""
        src, back = renamed(docs)
        at = src.columns[docs.columns.index(text_col)]
        got = self.judged(self.spans(src, tests, at, at, keep=src.columns, **names))
        return got.where(~F.col("contaminated")).select(*src.columns).toDF(*back)
