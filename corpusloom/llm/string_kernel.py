"""Language identification by a string kernel.

The kernel of two texts is the cosine of the sets of byte n-grams (a blended spectrum, n = 1 to 4)
that they hold. A Nystroem map through landmark texts makes it a vector, one-versus-rest kernel ridge
regression makes scores of it, and texts are scored in batches by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import small_batches
from corpusloom.llm._text import ddl, renamed, slices, text_buffer

UNKNOWN = "und"
SLOTS = 1 << 14
#: Rates of at most so many labels are sent to every task.
SENT = 50_000
ORDERS = (1, 2, 3, 4)


def _fold() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = t[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)
    t[0x80:] = np.arange(0x80, 0x100, dtype=np.uint8)
    return t


FOLDED = _fold()


def presence(texts: pa.Array) -> np.ndarray:
    """A row of SLOTS bits for each text: which hashed n-grams it holds. ASCII is case-folded, runs of its non-letters are one space."""
    buf, off = text_buffer(texts)
    out = np.zeros((len(off) - 1, SLOTS), bool)
    for r in range(len(off) - 1):
        x = FOLDED[buf[off[r] : off[r + 1]]]
        if not len(x):
            continue
        space = x == 0x20
        keep = ~space
        keep[1:] |= ~space[:-1]
        x = np.concatenate([[0x20], x[keep] if keep[0] or len(x) > 1 else x, [0x20]]).astype(np.uint32)
        g = np.zeros(len(x), np.uint32)
        for n in ORDERS:
            m = len(x) - n + 1
            if m <= 0:
                break
            g = (g[:m] << np.uint32(8)) | x[n - 1 :]
            slot = ((g ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
            out[r, slot] = True
    return out


def kernel(bits: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosines of texts and landmarks, some texts at a time."""
    out = np.empty((len(bits), landmarks.shape[1]), np.float32)
    for lo in range(0, len(bits), 256):
        x = bits[lo : lo + 256]
        out[lo : lo + 256] = (x.astype(np.float32) @ landmarks) / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(sizes, 1)[None, :])
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # SLOTS x m
    sizes: np.ndarray
    weights: np.ndarray  # (m + 1) x languages

    def margins(self, bits: np.ndarray) -> np.ndarray:
        k = kernel(bits, self.landmarks, self.sizes)
        return k @ self.weights[:-1] + self.weights[-1]


class StringKernelLanguageId:
    """Learns from labelled rows and predicts a learned language, or ``und`` for texts that are null or hold no letter.

    Every label value is learned, however many there are. At most about ``per_language`` texts of each are learned
    from, and at most about ``texts`` in all (but one of each at least): ids chosen by hash, of rows with one id and
    label the least text; documented bounds. ``landmarks`` of each language, at most about ``all_landmarks`` in all
    (but one at least, as many of each as of any other as far as they go), are landmarks. Whole texts are read. Rows
    with a null label or null id are not learned from. Without a learned language every prediction is ``und``.
    The score is the winning one-versus-rest margin mapped from [-1, 1] to [0, 1], and 0 for ``und``.
    Columns of docs may not be named like the results; ``predict`` takes other names for these.
    """

    def __init__(self, per_language: int = 400, landmarks: int = 40, ridge: float = 1e-3, texts: int = 16_000, all_landmarks: int = 1024):
        self.per_language, self.landmarks, self.ridge, self.texts, self.all_landmarks = per_language, landmarks, ridge, texts, all_landmarks
        self.model: Model | None = None

    def fit(self, docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> StringKernelLanguageId:
        spark = docs.sparkSession
        small_batches(spark)
        known = docs.select(F.col(label_col).cast("string").alias("l"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("l is not null and id is not null")
        learned = known.where(has_letter(F.col("text"))).groupBy("l").agg(F.approx_count_distinct("id").alias("n")).collect()
        if not learned:
            self.model = None
            return self
        each = max(1, min(self.per_language, self.texts // len(learned)))
        # A rate above what is wanted, since a draw may give fewer; a language of few texts gives all.
        rates = spark.createDataFrame([(r.l, 1.0 if r.n < 3 * each + 40 else (1.2 * each + 12) / r.n) for r in learned], "l string, rate double")
        if len(learned) <= SENT:  # a small row for each label; only beyond that are texts dealt out by their label
            rates = F.broadcast(rates)
        dice = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        chosen = known.withColumn("dice", dice).join(rates, "l").where("dice < rate").where(has_letter(F.col("text")))
        chosen = chosen.groupBy("l", "id", "dice").agg(F.min("text").alias("text")).select("l", "dice", "text")

        def bits(batches):
            for b in batches:
                for s, e in slices(b.column(2)):
                    p = np.packbits(presence(b.column(2).slice(s, e - s)), axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array([x.tobytes() for x in p], pa.binary())], ["l", "dice", "bits"])

        got = sorted((r.l, r.dice, bytes(r.bits)) for r in chosen.mapInArrow(bits, "l string, dice double, bits binary").collect())
        names = sorted({x[0] for x in got})
        if not names:
            self.model = None
            return self
        by_name: dict[str, list[bytes]] = {n: [] for n in names}
        for name, _, row in got:
            if len(by_name[name]) < each:
                by_name[name].append(row)
        texts = list(by_name.values())
        y = np.concatenate([np.full(len(t), i) for i, t in enumerate(texts)])
        x = np.unpackbits(np.frombuffer(b"".join(sum(texts, [])), np.uint8).reshape(len(y), -1), axis=1).astype(bool)
        # The first text of every language, then the second of each, and so on.
        nth = np.concatenate([np.arange(len(t)) for t in texts])
        first = np.lexsort((y, nth))[: max(1, min(self.all_landmarks, self.landmarks * len(names)))]
        first = np.sort(first[nth[first] < self.landmarks])
        z = x[first]
        landmarks, sizes = np.ascontiguousarray(z.T.astype(np.float32)), z.sum(1).astype(np.float32)
        value, vector = np.linalg.eigh(kernel(z, landmarks, sizes).astype(np.float64))
        ok = value > 1e-6 * value.max()
        whiten = vector[:, ok] / np.sqrt(value[ok])
        phi = np.c_[kernel(x, landmarks, sizes) @ whiten, np.ones(len(x))]
        share = np.bincount(y, minlength=len(names))
        weight = (len(y) / (len(names) * share))[y]
        goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
        gram = (phi * weight[:, None]).T @ phi + self.ridge * len(y) * np.diag(np.r_[np.ones(phi.shape[1] - 1), 0])
        beta = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), (phi * weight[:, None]).T @ goal)
        self.model = Model(names, landmarks, sizes, np.r_[whiten @ beta[:-1], beta[-1:]].astype(np.float32))
        return self

    def predict(self, docs: DataFrame, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
        """docs with two columns more: the predicted language and its score."""
        small_batches(docs.sparkSession)
        if {lang_out.lower(), score_out.lower()} & {c.lower() for c in docs.columns}:
            raise ValueError(f"docs already has a column named {lang_out} or {score_out}")
        src, back = renamed(docs)
        at = back.index(text_col)
        src = src.withColumn("_ok", has_letter(F.col(f"_c{at}")))
        model = docs.sparkSession.sparkContext.broadcast(self.model)
        n = len(back)

        def work(batches):
            m = model.value
            for b in batches:
                for s, e in ((x, min(y, x + 128)) for lo, y in slices(b.column(at)) for x in range(lo, y, 128)):
                    ok = b.column(n).slice(s, e - s).to_numpy(zero_copy_only=False).astype(bool)
                    lang, score = [UNKNOWN] * (e - s), np.zeros(e - s)
                    if m is not None and ok.any():
                        f = m.margins(presence(b.column(at).slice(s, e - s)))
                        best = f.argmax(1)
                        lang = [m.languages[k] if o else UNKNOWN for k, o in zip(best, ok)]
                        score = np.where(ok, np.clip((f[np.arange(e - s), best] + 1) / 2, 0, 1), 0.0)
                    yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in b.columns[:n]] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:n], "_l", "_s"])

        return src.mapInArrow(work, ddl(src.drop("_ok")) + ", _l string, _s double").toDF(*back, lang_out, score_out)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
