import random

import numpy as np
import pytest

from corpusloom.llm.ngram_jaccard import NgramJaccard, least_matches, roots

from .helpers import empty, odd_documents, words


def linked(rows, n=5, threshold=0.8):
    """(similar rows, least row of the class) of each row."""
    sets = [set(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t)) else None for _, t in rows]
    like = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(like):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    return like, root


def groups(rows, **kind):
    return linked(rows, **kind)[1]


def brute(rows, **kind):
    like, root = linked(rows, **kind)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None, len(like[i])))
    return sorted(out, key=repr)


def classes(docs, **kind):
    return sorted((tuple(r) for r in NgramJaccard(**kind).classes(docs).collect()), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert classes(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert classes(empty(odd_documents(spark))) == []


@pytest.mark.parametrize("block", [1, 4, 256])
def test_near_copies_in_small_and_large_blocks(spark, block):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        text = rng.choices(vocabulary, k=150)
        for _ in range(rng.choice([1, 3, 45])):
            t = list(text)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(docs, block=block) == brute(rows)


def test_pairs_and_membership(spark):
    rows = [(i, " ".join(f"a{k}" for k in range(40)) + (f" z{i}" if i % 2 else "")) for i in range(6)]
    pairs, member = NgramJaccard().pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.text_id for r in member.collect()}) == 4
    assert {round(r.similarity, 4) for r in pairs.collect()} == {round(36 / 37, 4), round(36 / 38, 4)}


def test_pruning_bound_and_roots():
    assert least_matches(16, 0.8, 1e-6) < least_matches(16, 0.8, 1e-2) <= 16
    assert roots(5, np.array([3, 4]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 1]


def test_a_text_that_every_partition_holds(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(i, text if i % 3 else text + f" z{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    got = NgramJaccard(spread=4).classes(docs).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 299)} and len(got) == 300


def test_components_against_union_find(spark):
    from corpusloom.llm._graph import components
    from corpusloom.llm._store import Scratch

    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)] + [(3000 + i, 3000) for i in range(5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "graph"))
    assert sorted((r.node, r.root) for r in got.collect()) == sorted((x, r) for x, r in root.items() if x != r)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "graph")).count() == 0
