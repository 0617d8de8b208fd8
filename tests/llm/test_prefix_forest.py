import numpy as np

from corpusloom.llm.prefix_forest import PrefixForest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 100 == 0:
            d = {}
            for i, y in ok:
                if i != q:
                    e = float(np.sqrt(((y - x) ** 2).sum()))
                    d[i] = min(d.get(i, e), e)
            out[q] = [i for e, i in sorted((e, i) for i, e in d.items())][:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) + 3 * (i % 5)], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = PrefixForest(trees=16, block=700).fit(df).search(df, df.where("vec_id % 100 = 0")).collect()
    want, got = brute(rows), {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) == 10 for v in got.values())
    assert sum(len({i for _, i in got[q]} & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    v = [1.0] * 8
    nan = float("nan")
    rows = [(0, v, 1), (100, v, 1), (1, v, 1), (1, v, 1), (2, None, 1), (3, [0.0] * 8, 1), (4, [None] + v[1:], 1), (5, [nan] + v[1:], 1), (200, [float("inf")] + v[1:], 1), (6, [2.0] * 8, None), (7, [1.0], 1), (None, v, 1), (300, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = PrefixForest().fit(df).search(df, df.where("vec_id % 100 = 0")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 100, 6], 100: [0, 1, 6]}
    none = df.where("1 = 0")
    assert PrefixForest().fit(none).search(none, none).count() == 0
    assert PrefixForest().fit(df).search(df, none).count() == 0


def test_repeated_ids_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(5)
    vec = lambda c: [float(np.float32(x)) for x in rng.normal(size=8) + c]
    rows = [(0, vec(0), 0)] + [(7, vec(0), 0) for _ in range(40)] + [(i, vec(4), 0) for i in range(101, 139)] + [(100, vec(2), 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (8, 65536):
        out = PrefixForest(block=block, recall=1.0).fit(df).search(df, df.where("vec_id % 100 = 0")).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = brute(rows)
        assert {q: set(v) for q, v in got.items()} == {q: set(v) for q, v in want.items()}
        assert all(len(v) == 10 for v in got.values())


def test_recall_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 900, [float(np.float32(x)) for x in rng.normal(size=8) + 2 * (i % 5)], 0) for i in range(2700)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = {}
    for i, v, _ in rows:
        first[i] = min(first.get(i, v), v)
    out = PrefixForest(trees=16, block=700).fit(df).search(df, df.where("vec_id % 100 = 0")).collect()
    got, hits, total = {}, 0, 0
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in (i for i in first if i % 100 == 0):
        d = {}
        for i, v, _ in rows:
            if i != q:
                e = float(np.linalg.norm(np.array(v) - np.array(first[q])))
                d[i] = min(d.get(i, e), e)
        want = {i for _, i in sorted((e, i) for i, e in d.items())[:10]}
        assert len(got[q]) == 10
        hits, total = hits + len(got[q] & want), total + 10
    assert hits >= 0.95 * total
