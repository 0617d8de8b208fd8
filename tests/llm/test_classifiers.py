import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.importance import ImportanceResampler, distinct, grams, log_ratios
from corpusloom.llm.string_kernel import StringKernelLanguageId, kernel, presence

from .helpers import empty, lower, odd_documents, words

SAMPLES = {"en": "the cat sat on the mat and then it went out with that other thing", "de": "der hund ging nicht über die straße und dann war er schon weg", "fr": "le chat était sur la table et puis il est parti avec les autres"}


def languages(spark, n=60):
    rows = []
    for i in range(n):
        for k, (lang, text) in enumerate(SAMPLES.items()):
            w = text.split()
            rows.append((3 * i + k + 1000, " ".join(w[(i + j * (1 + i % 3)) % len(w)] for j in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(spark):
    docs = languages(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = StringKernelLanguageId().fit(docs.where(~held)).predict(docs).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_rows(spark):
    docs = odd_documents(spark).drop("score")
    model = StringKernelLanguageId().fit(languages(spark))
    out = model.predict(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.lang_pred == "und") == (r.text in (None, "", "..."))
    assert model.predict(empty(docs)).count() == 0
    nothing = StringKernelLanguageId().fit(empty(docs)).predict(docs).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    """210 made-up languages of different vocabularies and one of many repeats of one row."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(210):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(12)]
        rows += [(len(rows) + j, " ".join(rng.choice(words, 30)), f"l{k}") for j in range(6)]
    rows += [(1, "zz yy xx zz yy xx", "many")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = StringKernelLanguageId(texts=600, all_landmarks=300).fit(docs)
    assert len(model.model.languages) == 211
    out = model.predict(docs.where("lang <> 'many'")).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_prediction_against_exact_kernel_ridge(spark):
    """With every text a landmark the map is exact: the same margins as kernel ridge regression on whole n-gram sets."""
    docs = languages(spark, 20)
    model = StringKernelLanguageId(landmarks=1000, ridge=1e-6).fit(docs)
    rows = docs.collect()

    def slots(text):
        # The n-grams themselves, not their hashed places; space stands for what is no ASCII letter.
        raw = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in text.lower().encode())
        raw = b" " + b" ".join(raw.split()) + b" "
        return {raw[i : i + n] for n in (1, 2, 3, 4) for i in range(len(raw) - n + 1)}

    sets = [slots(r.text) for r in rows]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    names = sorted(SAMPLES)
    y = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in rows])
    phi = np.c_[k, np.ones(len(k))]
    reg = 1e-6 * len(k) * np.block([[k, np.zeros((len(k), 1))], [np.zeros((1, len(k))), np.zeros((1, 1))]])
    beta = np.linalg.lstsq(phi.T @ phi + reg, phi.T @ y, rcond=None)[0]
    want = [names[i] for i in (phi @ beta).argmax(1)]
    got = {r.doc_id: r.lang_pred for r in model.predict(docs).collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_kernel_is_the_cosine_of_presence():
    x = presence(pa.array(["abc abd", "abc", "xyz", "", None]))
    k = kernel(x, x.T.astype(np.float32), x.sum(1).astype(np.float32))
    assert np.allclose(np.diag(k)[:3], 1) and 0 < k[0, 1] < 1 and k[3].sum() == 0


def test_grams_are_distinct_by_row():
    row, bucket, _ = grams(pa.array(["a b a b !!! c c c c c c", None, "a b"]))
    r, b = distinct(row, bucket)
    assert len(set(zip(r, b))) == len(r) < len(row)
    assert set(r) == {0, 2}


def test_quality_drops_what_labels_reject(spark):
    good = ["some %d clean words about gardens and rivers" % i for i in range(300)]
    bad = ["some %d clean words about an idiot and rivers" % i for i in range(100)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id long, text string, draw_ string")
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 400, 2)] + [(0, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = ImportanceResampler().fit(docs, labels)
    kept = {r.doc_id for r in model.sample(docs).collect()}
    assert kept == set(range(300))
    judged = model.judged(docs).collect()
    assert {r.doc_id for r in judged if r.kept} == kept


def test_quality_tells_rare_words_whatever_is_unlabelled(spark):
    """30 of 1,000 texts hold a toxic word and 12 of them are labelled; more unlabelled texts change nothing."""
    text = lambda i: "some %d clean words about %s and rivers" % (i, "an idiot" if i % 33 == 7 else "gardens")
    labels = spark.createDataFrame([(i, 1, int(i % 33 == 7)) for i in range(400)], "doc_id long, quality int, toxic int")
    for n in (1000, 3000):
        docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
        kept = {r.doc_id for r in ImportanceResampler().fit(docs, labels).sample(docs).collect()}
        assert kept == {i for i in range(n) if i % 33 != 7}


def test_quality_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ImportanceResampler().fit(docs, none)
    out = model.sample(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert model.sample(empty(docs)).count() == 0
    assert ImportanceResampler().fit(empty(docs), none).sample(empty(docs)).count() == 0


def test_kth_draw_is_exact(spark):
    rng = np.random.default_rng(0)
    draws = [float(x) for x in rng.normal(size=500)] + [0.0, -0.0, 5.5, 5.5]
    df = spark.createDataFrame([(x,) for x in draws], "draw double")
    ordered = sorted(draws, reverse=True)
    for k in (1, 2, 3, 100, 504):
        assert ImportanceResampler().kth_draw(df, k) == ordered[k - 1]


def plain_grams(text):
    """The n-grams themselves: words, stems, symbol runs, pairs, marks of repetition."""
    text = lower(text)
    w, s = words(text), re.findall(r"[!-/:-`{-~]+", text)
    out = {("w", x) for x in w} | {("s", x) for x in s} | {("p", a, b) for a, b in zip(w, w[1:])}
    out |= {("t", x.encode()[:n]) for x in w for n in (4, 5) if len(x.encode()) > n}
    marks = [a == b for a, b in zip(w, w[1:])]
    return out | {("m", *marks[i : i + 4]) for i in range(len(marks) - 3)}


def test_quality_against_plain_version(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(12)]  # few pairs, so that none share a place
    text = lambda i: " ".join(rng.choice(vocabulary, 25)) + (" you awful idiot!!" if i % 5 == 0 else "") + (" spam spam spam spam spam spam" if i % 7 == 0 else "")
    rows = [(i, text(i)) for i in range(300)] + [(400, None), (401, ""), (None, "word1 word2"), (402, "word1")] + [(402, "word1")]
    labels = [(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1, 0), (2, 1, 0), (4, 0, 0), (4, 1, 0), (999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ImportanceResampler().fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good = {}
    for i, q, t in labels:
        if i is not None:
            good[i] = good.get(i, True) and q == 1 and t == 0
    sets = [(i, plain_grams(t)) for i, t in rows]
    raw, seen, total, target = Counter(), Counter(), 0, 0
    for i, g in sets:
        if i in good:
            total, target = total + 1, target + good[i]
            raw.update(g)
            seen.update(g if good[i] else ())
    lam = {}
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    for g, n in raw.items():
        a, b, rest = seen[g], n - seen[g], total - target
        apart = beta(a + 0.5, target - a + 0.5) + beta(b + 0.5, rest - b + 0.5)
        alike = beta(n + 0.5, total - n + 0.5) + beta(0.5, 0.5)
        chance = 1 / (1 + math.exp(alike - apart) * 0.999 / 0.001)
        pad = 0.5 * total / target
        lam[g] = chance * (math.log((a + 0.5) / (target + 1)) - math.log((n + pad) / (total + 2 * pad)))
    want = sorted((str(i), round(sum(lam.get(x, 0) for x in g), 2)) for i, g in sets)
    out = model.judged(docs).collect()
    assert sorted((str(r.doc_id), round(r.log_weight, 2)) for r in out) == want
    k = sum(r.log_weight >= -1 for r in out)
    at = sorted((r.draw for r in out), reverse=True)[k - 1]
    assert all(r.kept == (r.draw >= at) for r in out) and min(r.log_weight for r in out) < -5
    noise = np.array([r.draw - r.log_weight for r in out])
    assert abs(noise.mean() - 0.577) < 0.25 and abs(noise.std() - 1.28) < 0.25


def test_log_ratios_of_chance_are_next_to_nothing():
    r = log_ratios(np.array([0, 75, 3, 0]), np.array([100, 100, 4, 0]), 300, 400, 0.5, 1e-3)
    assert r[0] < -3 and abs(r[1]) < 1e-2 and abs(r[2]) < 1e-2 and abs(r[3]) < 1e-2


def test_labels_are_bounded_by_distinct_ids(spark):
    docs = spark.createDataFrame([(i, f"text number{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(7, 1, 0)] * 5000, "doc_id long, quality int, toxic int")
    model = ImportanceResampler(max_labels=200).fit(docs, labels)
    assert model.counts[0].max() == 200


def test_quality_ties_and_clashing_names(spark):
    """Equal rows are drawn alike, also at the cut; columns named like the results come back as they were."""
    rows = [(1, "clean words here", 5.0, "a")] * 4 + [(i, "clean words here", 5.0, "b") for i in range(2, 9)] + [(20, "an idiot", 5.0, "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight double, draw string")
    labels = spark.createDataFrame([(i, 1, int(i == 20)) for i in (1, 2, 3, 4, 5, 6, 7, 8, 20)], "doc_id long, quality int, toxic int")
    model = ImportanceResampler().fit(docs, labels)
    kept = model.sample(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got[1] in (0, 4) and got[20] in (0, 3) and all(r.log_weight == 5.0 for r in kept.collect())
    with pytest.raises(ValueError):
        model.score(docs)


def test_prediction_refuses_clashing_names(spark):
    docs = languages(spark, 3)
    model = StringKernelLanguageId().fit(docs)
    with pytest.raises(ValueError):
        model.predict(docs.withColumn("SCORE", F.lit(1)))
    assert model.predict(docs.withColumn("score", F.lit(1)), score_out="how").count() == docs.count()
