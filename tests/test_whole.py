"""Queries over whole tables: all rows are there and agree with the SQL."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalogue

from .test_catalogue import SF, rows

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def agrees(spark, name):
    """All rows of a query; they are those of its SQL."""
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = c.execute(catalogue.ORACLE_SQL[name])
    df = catalogue.QUERIES[name](spark, SF).cache()
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in found.description], found.fetchall())
    return df


@needs_data
def test_footer_classes_of_all_documents(spark):
    df = agrees(spark, "ag07_footer_classes")
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@needs_data
def test_single_top_of_all_documents(spark):
    df = agrees(spark, "wn09_single_top")
    sigs = catalogue.QUERIES["wn02_signatures"](spark, SF)
    assert df.count() == sigs.count()
    assert df.where("label = 'H1'").count() == sigs.select("doc_id").distinct().count()


def test_report_of_an_hour_and_more(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = spark.range(4000).select(F.col("id").alias("event_id"), F.lit(at).alias("ts"), F.when(F.col("id") < 3700, 1).otherwise(2).cast("long").alias("user_id"), F.lit("x").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert {r.doc_id for r in catalogue.QUERIES["snk09_report"](spark, str(tmp_path)).collect()} == {1, 2}


def test_scalars_of_long_documents(spark, tmp_path):
    n = [100, 2048, 1 << 20, 5 << 29, None]
    docs = spark.createDataFrame([(i, "a", "en", "web", x) for i, x in enumerate(n)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r["size"] for r in catalogue.QUERIES["prj03_scalars"](spark, str(tmp_path)).collect()}
    assert got == {0: "100 B", 1: "2.0 KB", 2: "1.0 MB", 3: "2.5 GB", 4: None}


@needs_data
@pytest.mark.parametrize("name", ["prj18_norm_heading", "poc03_leaders"])
def test_all_lines(spark, name):
    df = agrees(spark, name)
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.size(F.split("text", "\n")))).first()[0]
    assert df.count() == lines


def test_domain_terms_beside_and_with_accents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "plain words", "en", "web"), (2, "für immer schön", "de", "web")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term for r in catalogue.QUERIES["ag21_domain_terms"](spark, str(tmp_path)).collect()}
    assert {"PLAIN", "WORDS", "FÜR", "IMMER", "SCHÖN"} <= got
