"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.hidden_markov import HiddenMarkovModel
from corpusloom.llm.html_tree import extract
from corpusloom.llm.importance import ImportanceResampler
from corpusloom.llm.ngram_jaccard import NgramJaccard
from corpusloom.llm.piece_fst import load, token_count, tokenise
from corpusloom.llm.prefix_forest import PrefixForest
from corpusloom.llm.reply_trees import ReplyTrees, from_turns, loss_text, turns_of
from corpusloom.llm.string_kernel import StringKernelLanguageId
from corpusloom.llm.web_archive import LegacyArchive
from corpusloom.llm.winnowing import Winnowing

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the near-duplicate class), n_links."""
    return NgramJaccard().classes(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, kept: whether the document is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ImportanceResampler().fit(docs, table(spark, sf_dir, "labels"))
    return model.judged(docs).select("doc_id", "log_weight", "kept")


def op3_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    out = HiddenMarkovModel().run(docs, ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return PrefixForest().fit(rows).search(rows, rows.where("vec_id % 100 = 0"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = StringKernelLanguageId().fit(docs.where(~held))
    return model.predict(docs.select("doc_id", "text")).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LegacyArchive().run(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by commas), round_trip (decoding gives the text back)."""
    fst = load(model_path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenise(docs, fst, decoded="decoded")
    return out.select("doc_id", token_count("tokens", fst).alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = ReplyTrees().format(from_turns(turns.union(more)))
    back = out.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Winnowing().report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_classifier,
        op3_hidden_markov_lm,
        op4_prefix_forest,
        op5_language_id,
        op6_warc,
        op7_html_tree,
        op8_sentencepiece,
        op9_reply_trees,
        op10_winnowing_decontamination,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i+4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - 3))) AS i FROM w WHERE len(l) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
SELECT r.x AS doc_id, min(root) AS class_id, coalesce(any_value(k), 0) AS n_links FROM r LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY 1) d USING (x) GROUP BY r.x
""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to,
       CASE WHEN last <> page_id THEN NULL ELSE true END AS payload_ok
FROM g
""",
    "op10_winnowing_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark
), k AS (SELECT DISTINCT item, least(13, len(l)) AS n, array_to_string(l[i:i + least(13, len(l)) - 1], ' ') AS g FROM (SELECT item, l, unnest(range(1, greatest(2, len(l) - 11))) AS i FROM b WHERE len(l) > 0)),
z AS (SELECT DISTINCT n FROM k),
g AS (SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM d, z WHERE len(l) >= n)),
h AS (SELECT doc_id, item, g.n, i FROM g JOIN k USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_reply_trees": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS er,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(er, chr(10), '&#10;')) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
