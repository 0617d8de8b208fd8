import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import hidden_markov as H

from .helpers import empty, lower, odd_documents


def random_model(k=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return H.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def test_forward_sums_all_paths():
    m = random_model()
    x = np.array([0, 3, 2, 4])
    total = sum(m.start[p[0]] * np.prod([m.emit[s, q] for s, q in zip(x, p)]) * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) for p in itertools.product(range(3), repeat=4))
    assert math.isclose(H.likelihood(m, x, np.array([0, 4]))[0], math.log10(total))


def test_long_sequences_give_the_same_by_segments(monkeypatch):
    m = random_model()
    x = np.random.default_rng(2).integers(0, 5, 3000)
    off = np.array([0, 1000, 1001, 3000])
    want = H.likelihood(m, x, off)
    monkeypatch.setattr(H, "LONG", 10)
    assert np.allclose(H.likelihood(m, x, off), want)


def test_expected_counts_sum_all_paths():
    m, x = random_model(), np.array([0, 3, 2, 4, 1])
    starts, moves, emitted, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for p in itertools.product(range(3), repeat=5):
        w = m.start[p[0]] * np.prod([m.emit[s, q] for s, q in zip(x, p)]) * np.prod([m.move[a, b] for a, b in zip(p, p[1:])])
        total += w
        starts[p[0]] += w
        for a, b in zip(p, p[1:]):
            moves[a, b] += w
        for s, q in zip(x, p):
            emitted[s, q] += w
    got = H.expect(m, x, np.array([0, 5]))
    for a, b in zip(got, (starts / total, moves / total, emitted / total, math.log(total))):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_expected_counts_of_long_sequences_are_not_cut(monkeypatch):
    m = random_model(4, 6, 7)
    x = np.random.default_rng(2).integers(0, 6, 3000)
    off = np.array([0, 1000, 1001, 1040, 3000])
    want = H.expect(m, x, off)
    monkeypatch.setattr(H, "LONG", 10)
    for segment in (7, 64, 256):
        monkeypatch.setattr(H, "SEGMENT", segment)
        for a, b in zip(H.expect(m, x, off), want):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.choice([0, 1] if i % 2 else [2, 3], 50) for i in range(40)])
    off = np.arange(0, 2001, 50)
    m, unigram = random_model(2, 5, 4), np.full(5, 0.2)
    seen = []
    for _ in range(15):
        s, mv, e, ll = H.expect(m, ids, off)
        assert math.isclose(e.sum(), len(ids), rel_tol=1e-4) and math.isclose(s.sum(), 40, rel_tol=1e-4)
        seen.append(ll)
        m = H.reestimate(s, mv, e, unigram, 0.1)
    assert seen[-1] > seen[0]


def test_rounds_over_all_texts_go_on_to_convergence(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a b c d".split(), "w x y z".split()][(i + j // 6) % 2]) for j in range(40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = H.HiddenMarkovModel(states=2, burn_rounds=0)
    assert model.run(docs, F.lit(True)).count() == 120
    gains = np.diff(model.history) / -np.array(model.history[:-1])
    assert len(model.history) > 3 and all(gains[:-1] >= 1e-4) and gains[-1] < 1e-4


def test_odd_rows_against_counts(spark):
    docs = odd_documents(spark)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    out = H.HiddenMarkovModel(rounds=1, burn_rounds=3).run(docs, train).collect()
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + [None]) for r in docs.collect()]
    learn = [w for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    base = lambda w: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(base(w), 4)) for i, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_empty_tables(spark):
    docs = odd_documents(spark)
    assert H.HiddenMarkovModel(rounds=1).run(empty(docs), F.lit(True)).count() == 0
    out = H.HiddenMarkovModel(rounds=1).run(docs, F.lit(False)).collect()
    assert len(out) == docs.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in out)
