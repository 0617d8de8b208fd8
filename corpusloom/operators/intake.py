"""Metadata of decoded documents and the pre-flight report. One row a document, by projections alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X

MIN_CHARS, FIRST_PAGES, LARGE = 100, 5, 50 * 1024 * 1024
#: What the report warns of.
WARNINGS = (
    "Scanned PDF detected - very little extractable text",
    "Very large file - may require extended processing",
    "Complex document - expect more user involvement",
    "No TOC detected - markdown heading structure may not align with the PDF; manual heading corrections may be required",
)


def _size(name: str) -> Column:
    return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))


def metadata(decoded: DataFrame) -> DataFrame:
    """doc_id and the metadata of each document: names, counts of pages, images and font families, outline depth, dates."""
    families = F.array_compact(F.transform("fonts", lambda f: X.font_family(f["name"])))
    depth = F.coalesce(F.array_max(F.transform("toc", lambda t: t["level"])), F.lit(0))
    named = [X.safe_string(F.col(f"info.{n}")).alias(n) for n in ("title", "author", "creator", "producer")]
    return decoded.select(
        "doc_id",
        "file_size_bytes",
        *named,
        F.nullif(F.col("info.copyright"), F.lit("")).alias("copyright"),
        _size("pages").alias("page_count"),
        (_size("toc") > 0).alias("has_toc"),
        _size("toc").alias("toc_entries"),
        depth.alias("toc_max_depth"),
        _size("images").alias("image_count"),
        F.greatest(F.coalesce(F.size(F.array_distinct(families)), F.lit(0)), F.lit(0)).alias("font_count"),
        X.pdf_date(F.col("info.creation_date")).alias("creation_date"),
        X.pdf_date(F.col("info.modification_date")).alias("modification_date"),
    )


def violations(meta: DataFrame) -> DataFrame:
    """doc_id, violations: counts out of range."""
    least = {"page_count": 1, "file_size_bytes": 1, "font_count": 0, "image_count": 0}
    rules = [F.when(F.coalesce(F.col(n), F.lit(-1)) < low, F.concat(F.lit(f"{n} must be {'>' if low else '>='} 0, got "), F.coalesce(F.col(n).cast("string"), F.lit("None")))) for n, low in least.items()]
    return meta.select("doc_id", F.array_compact(F.array(*rules)).alias("violations"))


def valid(meta: DataFrame) -> DataFrame:
    """Documents whose metadata breaks no rule; the others belong to a quarantine table."""
    return meta.join(violations(meta).where(F.size("violations") > 0), "doc_id", "left_anti")


def extractable(decoded: DataFrame, threshold: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_extractable: whether the first five pages hold enough characters; false where there is no page."""
    first = F.filter("pages", lambda p: p["page_no"] <= FIRST_PAGES)
    n = F.aggregate(F.transform(first, lambda p: F.coalesce(F.length(X.strip(p["text"])), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return decoded.select("doc_id", (F.coalesce(n, F.lit(0)) >= threshold).alias("text_extractable"))


def extractable_pages(pages: DataFrame, threshold: int = MIN_CHARS) -> DataFrame:
    """The same from a table of pages (doc_id, page_no, text)."""
    n = F.coalesce(F.sum(F.when(F.col("page_no") <= FIRST_PAGES, F.length(X.strip(F.col("text"))))), F.lit(0))
    return pages.groupBy("doc_id").agg((n >= threshold).alias("text_extractable"))


def toc_approach(has_toc: Column, entries: Column) -> Column:
    return F.when(F.coalesce(has_toc, F.lit(False)) & (entries > 0), "embedded").otherwise("none")


def warnings(text_extractable: Column, size: Column, complexity: Column, approach: Column) -> Column:
    """What to warn of, in a fixed order."""
    rules = (~text_extractable, size > LARGE, complexity == "high", approach == "none")
    return F.array_compact(F.array(*[F.when(r, F.lit(m)) for r, m in zip(rules, WARNINGS)]))


def preflight(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """The report of each document: size, counts, extractability, outline, complexities, warnings, phases that ask the user."""
    font = X.font_complexity(F.col("font_count"))
    overall = X.complexity(F.col("font_count"), F.col("image_count"))
    approach = toc_approach(F.col("has_toc"), F.col("toc_entries"))
    t = meta.join(texts, "doc_id", "left").withColumn("text_extractable", F.coalesce("text_extractable", F.lit(False)))
    return t.select(
        "doc_id",
        X.file_size(F.col("file_size_bytes")).alias("file_size"),
        "page_count",
        "image_count",
        "text_extractable",
        approach.alias("toc_approach"),
        font.alias("font_complexity"),
        overall.alias("overall_complexity"),
        X.quick_complexity(F.col("page_count"), F.col("font_count")).alias("complexity"),
        warnings(F.col("text_extractable"), F.col("file_size_bytes"), overall, approach).alias("warnings"),
        F.array(F.lit(7), F.lit(9)).alias("user_phases"),
        "copyright",
    )
