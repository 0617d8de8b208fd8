import hashlib
import random

import pytest

from corpusloom.llm.winnowing import Text, Winnowing, extend, united

from .helpers import empty, odd_documents, words


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from it"), (2, None), (3, ""), (4, "Zwei kleine"), (5, "x"), (6, "w0x0 w1x1 w2x2 W3x3"), (7, "w0x0 w1x1 w2x2 W3x3")]


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_odd_rows(spark, bits):
    docs = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in Winnowing(most_bits=bits).report(docs, items).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_random_texts_over_a_small_alphabet(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(12)]
    rows = [(i, text(rng.randint(0, 200))) for i in range(60)]
    got = Winnowing().report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, items)


def test_empty_tables_and_kept_columns(spark):
    docs, items = odd_documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Winnowing().report(empty(docs), items).count() == 0
    none = Winnowing().clean(docs, empty(items))
    assert none.columns == docs.columns and none.count() == docs.count()
    clean = Winnowing().clean(docs, items)
    assert {r.doc_id for r in clean.collect() if r.doc_id} == {3, 4, 5, 6, 7, 10}


def test_a_passage_that_most_texts_share(spark):
    """One item occurs in most texts, several items share it, and one word fills whole texts."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(1, passage), (2, "head " + passage + " tail"), (3, "a " * 40), (4, "a"), (5, passage)]
    rows = [(i, f"start{i} {passage} end{i}" if i % 3 else "a " * (i + 1)) for i in range(120)] + [(200, "b " * 500)]
    got = Winnowing(spread=3).report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, items)


def test_words_of_one_hash_are_told_apart_by_their_bytes():
    text, item = Text("a b c d e"), Text("a b x d e")
    item.hashes = text.hashes.copy()
    assert extend(text, item, [{"ps": [0], "qs": [0]}], 2) == [(0, 2)]
    assert extend(text, item, [{"ps": [2], "qs": [2]}], 2) == []
    assert extend(text, item, [{"ps": [3], "qs": [3]}], 2) == [(3, 5)]
    assert united([(3, 5), (0, 2), (1, 3)]) == [{"s": 0, "e": 5}]
