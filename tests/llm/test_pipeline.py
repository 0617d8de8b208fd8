import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.piece_fst import load
from corpusloom.llm.queries import PIECE_MODEL, QUERIES

from .helpers import odd_documents
from .test_ngram_jaccard import groups as near_groups
from .test_winnowing import brute as dirty

needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model file here")


def tables(spark, path, labels=()):
    long = " ".join(f"a{i % 23} b{i % 7}" for i in range(200))
    item = " ".join(f"item{i}" for i in range(15))
    docs = odd_documents(spark, [(20, long, "en"), (21, long + " x", "en"), (22, item, "en"), (23, item + " " + " ".join(f"q{i}" for i in range(900)), "de")])
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return [(r.doc_id, r.text) for r in docs.collect()], [(1, item), (2, None)]


@needs_model
def test_stages_against_plain_versions(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    groups = near_groups(kept)
    once, kept_of = [], {}
    for at, (i, _) in enumerate(kept):
        c = groups[at]
        if c not in kept_of or (i is not None and (kept[kept_of[c]][0] is None or i < kept[kept_of[c]][0])):
            kept_of[c] = at
    once = [kept[at] for at in sorted(kept_of.values())]
    bad = {i for i, *_, hit in dirty(once, items) if hit}
    want = sorted((str(i), t) for i, t in once if i not in bad)
    fst = load(PIECE_MODEL)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), fst.decode_bytes(bytes(r.tokens))) for r in out) == want
    assert all(r.round_trip and r.n_tokens * 2 == len(r.tokens) for r in out)
    assert 22 in bad and 23 not in bad


@needs_model
def test_empty_tables(spark, tmp_path):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").where("1 = 0")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op6_warc", "op9_reply_trees", "op10_winnowing_decontamination"])
def test_registered_sql(spark, name):
    import duckdb

    from corpusloom.llm.queries import ORACLE_SQL

    c, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf).select(*names).collect()) == want


def test_rows_not_ids_are_told_apart(spark):
    """Different texts under one id both stay, in whatever order; of copies without an id one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a, 0), (1, b, 1), (2, a, 2), (None, c, 3), (None, c + " more", 4), (None, a, 5), (None, None, 6), (3, "", 7), (3, "", 8)], "doc_id long, text string, _row long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r._row for r in kept.collect()) == [0, 1, 3, 6, 7, 8]


def test_stages_that_reject(spark, tmp_path):
    """Language: texts in no language go. Quality: texts with words that rejected labels have go, labelled or not."""
    text = lambda i: f"some {i} clean words about gardens and rivers" + (" you awful idiot!!" if i % 5 == 0 else "") + (" | x | y | z" if i % 7 == 0 else "")
    rows = [(i, text(i), "en", "web", 1) for i in range(400)] + [(500, "... 12 !!", "en", "web", 1), (501, None, "en", "web", 1), (502, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    said = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert said.columns == docs.columns and {r.doc_id for r in said.collect()} == set(range(400))
    nothing = corpus_pipeline.language_id(spark, docs.withColumn("lang", docs.lang.substr(9, 1)).withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
    assert {r.doc_id for r in nothing.collect()} == set(range(400))
    kept = corpus_pipeline.quality(spark, said, str(tmp_path))
    clean, got = {i for i in range(400) if i % 5 and i % 7}, {r.doc_id for r in kept.collect()}
    # A draw in proportion to weights, so a clean text may go and another stay, but few.
    assert kept.columns == docs.columns and len(got & clean) >= 0.98 * len(clean) and len(got - clean) <= 0.02 * len(clean)
