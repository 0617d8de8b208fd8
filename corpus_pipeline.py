"""A corpus pipeline of five stages, each calling one operator on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, released
from corpusloom.llm.importance import ImportanceResampler
from corpusloom.llm.ngram_jaccard import NgramJaccard
from corpusloom.llm.piece_fst import load, token_count, tokenise
from corpusloom.llm.queries import PIECE_MODEL, remainder, table
from corpusloom.llm.string_kernel import UNKNOWN, StringKernelLanguageId, has_letter
from corpusloom.llm.winnowing import Winnowing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go: null ones and those without a letter. The rest stays as it is, also if no language could be learned."""
    learn = docs.where(~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    model = StringKernelLanguageId().fit(learn)
    if model.model is None:
        return docs.where(has_letter(F.col("text")))
    found = model.predict(docs, lang_out="_lang_pred", score_out="_lang_score")
    return found.where(F.col("_lang_pred") != UNKNOWN).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not drawn by importance go."""
    return ImportanceResampler().fit(docs, table(spark, sf_dir, "labels")).sample(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: the least id's, the first of rows with that id. Texts without a word stay."""
    return NgramJaccard().firsts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold too much of the benchmark go."""
    return Winnowing().clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, tokens (ids, 2 bytes each, little-endian), round_trip."""
    fst = load(PIECE_MODEL)
    out = tokenise(docs.select("doc_id", "lang", "source", "text"), fst, decoded="decoded")
    return out.select("doc_id", "lang", "source", token_count("tokens", fst).alias("n_tokens"), "tokens", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        was = docs
        with released(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(was, "_scratch_path"):
            scratch.drop(was)
    return STAGES[-1][1](spark, docs, sf_dir)
