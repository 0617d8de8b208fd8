"""Font-signature statistics: signatures, heading candidates, footer and icon classes, body size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

KEY = ["family", "size", "weight", "style"]
SAMPLE_PAGES, CANDIDATES, TOP_LEVEL = 5, 5, 3
TOLERANCE = 0.5
TOP, BOTTOM = 0.15, 0.85
#: Parts of the names of symbol fonts.
ICON_FONTS = ("fontawesome", "material", "glyphicons", "icomoon", "icon", "symbol", "wingdings", "webdings")
#: Families that are icons whatever else is known, and parts of the names of sites that print footers.
ICON_FAMILIES = ("FontAwesome6Free-Solid", "FontAwesome6Free-Regular")
FOOTER_SITES = ("naturalcrit",)


def position() -> Column:
    return F.struct("page_no", "line_no", "span_no")


def styled(spans: DataFrame) -> DataFrame:
    """Spans with family, weight and style in place of font and flags."""
    return spans.withColumn("family", F.col("font")).withColumn("weight", X.weight_of(F.col("flags"))).withColumn("style", X.style_of(F.col("flags"))).withColumn("size", F.bround("size", 1))


def signatures(spans: DataFrame, pages: int | None = SAMPLE_PAGES) -> DataFrame:
    """A row for each distinct signature of a document's first pages: id (by size and first sight), frequency, sample, level.

    Ids are ``sig`` and a number of three digits in order of falling size; the first five are heading
    candidates with levels 1, 2 and 3 (and 3 from there on).
    """
    s = styled(spans if pages is None else spans.where(F.col("page_no") <= pages)).where(X.strip(F.col("text")) != "")
    g = s.groupBy("doc_id", *KEY).agg(F.count("*").alias("frequency"), F.min_by(F.substring("text", 1, 50), position()).alias("sample"), F.min(position()).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), F.asc("first")))
    g = g.withColumn("ord", rank)
    return g.select("doc_id", F.format_string("sig%03d", "ord").alias("sig"), "ord", *KEY, "frequency", "sample", (F.col("ord") <= CANDIDATES).alias("candidate_heading"), F.when(F.col("ord") <= CANDIDATES, F.least("ord", F.lit(TOP_LEVEL))).alias("suggested_level"))


def with_signature(spans: DataFrame, sigs: DataFrame) -> DataFrame:
    """Spans with the id of their exact signature; null if there is none."""
    return styled(spans).join(sigs.select("doc_id", *KEY, "sig"), ["doc_id", *KEY], "left")


def tolerant(spans: DataFrame, sigs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Spans with the first signature of their family whose size differs by less than the tolerance; other columns stay.

    Of signatures with one family and size the first keeps its place and the last gives the id. The few sizes of a
    document's families are matched to its signatures, and only then the spans to their sizes.
    """
    dims = sigs.groupBy("doc_id", "family", "size").agg(F.min("ord").alias("at"), F.max_by("sig", "ord").alias("sig")).withColumnRenamed("size", "sig_size")
    t = styled(spans)
    sizes = t.select("doc_id", "family", "size").distinct().join(dims, ["doc_id", "family"]).where(F.abs(F.col("size") - F.col("sig_size")) < tolerance)
    return t.join(sizes.groupBy("doc_id", "family", "size").agg(F.min_by("sig", "at").alias("sig")), ["doc_id", "family", "size"])


def footer_classes(matched: DataFrame, pages: DataFrame, height: Column | float = 800.0) -> DataFrame:
    """doc_id, sig, category, confidence, position of signatures that occur on at least eight pages in ten, by how they repeat and where.

    ``matched`` are spans with their signature, blank ones are skipped; ``pages`` has doc_id and pages, the number of
    all pages of the document; ``height`` is that of a span's page, in the units of origin_y.
    """
    h = height if isinstance(height, Column) else F.lit(height)
    t = matched.withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    g = t.groupBy("doc_id", "sig").agg(
        F.count("*").alias("cnt"),
        F.count_distinct("text").alias("texts"),
        F.bool_and(F.col("origin_y") < TOP * h).alias("top"),
        F.bool_and(F.col("origin_y") > BOTTOM * h).alias("bottom"),
        F.avg("size").alias("mean_size"),
        F.transform(F.array_sort(F.collect_list(F.when(F.length("text") <= 18, F.struct("page_no", "line_no", "span_no", "text")))), lambda x: x["text"]).alias("short"),
    ).join(pages.select("doc_id", "pages"), "doc_id").where(F.col("cnt") >= 0.8 * F.col("pages"))
    every = F.col("cnt") == F.col("pages")
    numbered = X.page_numbers(F.col("short"))
    category = F.when(every & (F.col("texts") == 1), "watermark").when(every & numbered & (F.col("top") | F.col("bottom")), "page_number").when(F.col("bottom"), "footer").when((F.col("mean_size") < 9.0) & (F.col("cnt") > 0.9 * F.col("pages")), "footer")
    confidence = F.when(category.isin("watermark", "page_number"), "high").when(F.col("bottom"), "medium").otherwise("low")
    return g.withColumn("category", category).where("category is not null").select("doc_id", "sig", "category", confidence.alias("confidence"), F.when(F.col("top"), "top").when(F.col("bottom"), "bottom").otherwise("mixed").alias("position"), "cnt")


def page_counts(spans: DataFrame) -> DataFrame:
    """doc_id, pages: the last page that holds a span, for want of the true number."""
    return spans.groupBy("doc_id").agg(F.max("page_no").alias("pages"))


def _unlabelled(sigs: DataFrame) -> Column:
    return (F.col("label") if "label" in sigs.columns else F.lit(None).cast("string")).isNull()


def plain_footers(sigs: DataFrame, sites: tuple[str, ...] = FOOTER_SITES) -> DataFrame:
    """doc_id, sig: footers by name alone, where no classes were made: small unlabelled signatures whose sample names a site or begins with PART."""
    named = F.exists(F.array(*[F.lit(x) for x in sites]), lambda x: F.contains(F.lower("sample"), x)) | F.upper("sample").startswith("PART")
    return sigs.where((F.col("size") < 8) & ~F.col("candidate_heading") & _unlabelled(sigs) & named).select("doc_id", "sig")


def plain_icons(sigs: DataFrame, families: tuple[str, ...] = ICON_FAMILIES) -> DataFrame:
    """doc_id, sig: icon signatures by family alone, where no classes were made."""
    return sigs.where(F.col("family").isin(*families)).select("doc_id", "sig")


def page_number_ids(sigs: DataFrame) -> DataFrame:
    """doc_id, sig: unlabelled signatures, no heading candidates, whose one sample is all digits."""
    return sigs.where(~F.col("candidate_heading") & _unlabelled(sigs) & F.col("sample").rlike(r"(?U)^\d+$") & (F.col("frequency") >= 1)).select("doc_id", "sig")


def candidates(sigs: DataFrame) -> DataFrame:
    """doc_id, candidates: how many heading candidates a document has."""
    return sigs.groupBy("doc_id").agg(F.count_if("candidate_heading").alias("candidates"))


def samples(spans: DataFrame, keys: list[str], n: int = 3, length: int = 50) -> DataFrame:
    """The keys with the first ``n`` texts of each, at most ``length`` characters of them, and how many there are."""
    t = spans.where(X.strip(F.col("text")) != "")
    w = Window.partitionBy("doc_id", *keys)
    t = t.withColumn("nth", F.row_number().over(w.orderBy("page_no", "line_no", "span_no"))).withColumn("frequency", F.count("*").over(w))
    t = t.where(F.col("nth") <= n).groupBy("doc_id", *keys).agg(F.max("frequency").alias("frequency"), F.array_sort(F.collect_list(F.struct("nth", F.substring("text", 1, length).alias("text")))).alias("s"))
    return t.select("doc_id", *keys, "frequency", F.transform("s", lambda x: x["text"]).alias("samples"))


def footer_ids(classes: DataFrame) -> DataFrame:
    """Signatures to remove: all but footers of low confidence (a missing confidence is high)."""
    return classes.where((F.col("category") != "footer") | (F.coalesce("confidence", F.lit("high")) != "low")).select("doc_id", "sig").distinct()


def icon_classes(spans: DataFrame) -> DataFrame:
    """Families that look like icon fonts: by name or private-use characters (high), or by very short texts (medium)."""
    g = spans.where(X.strip(F.col("text")) != "").groupBy("doc_id", F.lower("font").alias("family")).agg(F.bool_or(F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")).alias("private"), F.avg(F.length(X.strip(F.col("text")))).alias("mean_length"), F.count("*").alias("n_spans"))
    named = F.exists(F.array(*[F.lit(x) for x in ICON_FONTS]), lambda x: F.contains("family", x))
    confidence = F.when(named | F.col("private"), "high").when(F.col("mean_length") <= 2, "medium")
    return g.withColumn("confidence", confidence).where("confidence is not null").select("doc_id", "family", "confidence", F.when(named, "name").when(F.col("private"), "private_use").otherwise("short_text").alias("reason"), "n_spans")


def icon_signatures(matched: DataFrame, sigs: DataFrame) -> DataFrame:
    """doc_id, sig, confidence: signatures that look like icons, by the spans that match them: by name or private-use characters
    (high), or by very short texts (medium)."""
    g = matched.groupBy("doc_id", "sig").agg(F.bool_or(F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")).alias("private"), F.avg(F.length("text")).alias("mean_length"))
    t = g.join(sigs.select("doc_id", "sig", F.lower("family").alias("name")), ["doc_id", "sig"])
    named = F.exists(F.array(*[F.lit(x) for x in ICON_FONTS]), lambda x: F.contains("name", x))
    return t.withColumn("confidence", F.when(named | F.col("private"), "high").when(F.col("mean_length") <= 2, "medium")).where("confidence is not null").select("doc_id", "sig", "confidence")


def body_size(sigs: DataFrame, low: float = 8, high: float = 12, default: float = 10) -> DataFrame:
    """doc_id, body_size: the most frequent size of signatures within the range, the first seen of equals; else the default."""
    g = sigs.where(F.col("size").between(low, high)).groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    best = g.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("ord"))).alias("body_size"))
    return sigs.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("body_size", F.lit(float(default))).alias("body_size"))
