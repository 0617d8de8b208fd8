"""Readers, and the span model derived from plain text.

A document is a table of positioned text spans (doc_id, page_no, block_no, line_no, span_no, text, font,
size, flags, origin_y). Decoded spans are read from Parquet or JSON; ``spans_of_text`` derives them from
plain text by a fixed rule, so that every later operator runs on any corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("page_no", "block_no", "line_no", "span_no")), T.StructField("text", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("flags", T.IntegerType()), T.StructField("origin_y", T.DoubleType())])
TOC = "doc_id long, ord int, level int, title string, page int"
LINES_ON_PAGE, LINES_IN_BLOCK = 10, 5


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of a JSON file; a missing file is an empty table of the schema, a malformed record a row of nulls."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line; other columns stay."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(F.col(id_col).alias("doc_id"), *rest, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def spans_of_text(docs: DataFrame) -> DataFrame:
    """A span for each comma-separated part of a line; fonts alternate with the part, sizes and flags with line and document.

    Texts are dealt out by document before they are taken apart, as everything after is by document: that moves the text once,
    and not its many spans."""
    parts = lines_of(docs.select("doc_id", "text", "source").repartition("doc_id")).select("doc_id", "source", "line_no", "line", F.posexplode(F.split("line", ",")).alias("span_no", "text"))
    page = F.floor(F.col("line_no") / LINES_ON_PAGE).cast("int") + 1
    return parts.select(
        "doc_id",
        page.alias("page_no"),
        F.floor(F.col("line_no") % LINES_ON_PAGE / LINES_IN_BLOCK).cast("int").alias("block_no"),
        "line_no",
        "span_no",
        "text",
        F.concat("source", F.when(F.col("span_no") % 3 == 2, "-alt").otherwise("")).alias("font"),
        (8 + F.length("line") % 10).cast("double").alias("size"),
        (F.col("doc_id") % 4).cast("int").alias("flags"),
        (F.col("line_no") % LINES_ON_PAGE * 80 + 40).cast("double").alias("origin_y"),
    )


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, text: pages of ten lines."""
    lines = lines_of(docs.select("doc_id", "text"))
    page = (F.floor(F.col("line_no") / LINES_ON_PAGE) + 1).cast("int").alias("page_no")
    return lines.groupBy("doc_id", page).agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def parse_toc(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of a text outline -> level (two spaces each, from 1), title, page; other lines go."""
    m = r"^(.*?)\s*\(page\s*(\d+)\)$"
    bare = F.ltrim("line")
    out = lines.where(bare.rlike(m))
    return out.select("doc_id", "line_no", (F.floor((F.length("line") - F.length(bare)) / 2) + 1).cast("int").alias("level"), F.regexp_extract(bare, m, 1).alias("title"), F.regexp_extract(bare, m, 2).cast("int").alias("page"))


def toc_text(toc: DataFrame, source: str = "embedded") -> DataFrame:
    """doc_id and the text outline that ``parse_toc`` reads."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "title", F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    head = F.lit(f"# Table of contents\n# Source: {source}\n#\n")
    return toc.withColumn("line", line).groupBy("doc_id").agg(F.concat(head, F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY ord)")).alias("text"))


def toc_source(embedded: DataFrame, visual: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and where its outline comes from: embedded, else visual, else none."""
    e, v = embedded.select("doc_id").distinct().withColumn("e", F.lit("embedded")), visual.select("doc_id").distinct().withColumn("v", F.lit("visual"))
    return docs.select("doc_id").join(e, "doc_id", "left").join(v, "doc_id", "left").select("doc_id", F.coalesce("e", "v", F.lit("none")).alias("source"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag, text: title, headings, paragraphs, navigation and footer of each page by a light pattern."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(title|h1|p|nav|footer)>(.*?)</(?:title|h1|p|nav|footer)>"), 0)
    t = pages.select("page_id", F.posexplode(found).alias("ord", "m"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("m", "<[^>]*>", " "), "\\s+", " "), "^ +| +$", ""))
    return t.select("page_id", "ord", F.regexp_extract("m", "^<(\\w+)>", 1).alias("tag"), text.alias("text"))
