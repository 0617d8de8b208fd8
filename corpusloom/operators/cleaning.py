"""String rewrites of marked text: removal by signature, paragraphs, blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

MARKER = r"«(sig[a-z0-9]+):([^»]*)»"


def by_line(*more) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("line_no")


def wrap_marked(line: Column) -> Column:
    """wrap_markdown inside markers and outside them, comments untouched."""
    parts = F.regexp_extract_all(line, F.lit(r"(?s)«sig[a-z0-9]+:[^»]*»|<!--.*?-->|(?:(?!«sig|<!--).)+"), 0)

    def one(p: Column) -> Column:
        inner = F.regexp_extract(p, MARKER, 2)
        return F.when(p.startswith("<!--"), p).when(p.rlike(f"^{MARKER}$"), F.concat(F.lit("«"), F.regexp_extract(p, MARKER, 1), F.lit(":"), X.wrap_markdown(inner), F.lit("»"))).otherwise(X.wrap_markdown(p))

    return F.array_join(F.transform(parts, one), "")


def drop_signatures(marked: DataFrame, gone: DataFrame) -> DataFrame:
    """Marked parts (doc_id, ..., sig) without those whose signature is to go."""
    return marked.join(gone.select("doc_id", "sig").distinct(), ["doc_id", "sig"], "left_anti")


def drop_blank_markers(lines: DataFrame) -> DataFrame:
    """Lines that are one marker around nothing go."""
    return lines.where(~(F.col("line").rlike(f"^{MARKER}$") & (X.strip(F.regexp_extract("line", MARKER, 2)) == "")))


def without_numbers(line: Column, ids: Column) -> Column:
    """The line without its markers of these signatures around digits."""
    pattern = F.concat(F.lit("«(?:"), F.array_join(ids, "|"), F.lit(r"):\d+»"))
    return F.when(F.coalesce(F.size(ids) > 0, F.lit(False)) & F.contains(line, F.lit("«")), F.regexp_replace(line, pattern, F.lit(""))).otherwise(line)


def drop_page_numbers(lines: DataFrame, signatures: DataFrame) -> DataFrame:
    """Lines without markers of page-number signatures around digits; lines of which nothing else is left go."""
    ids = signatures.groupBy("doc_id").agg(F.array_sort(F.collect_set("sig")).alias("_ids"))
    t = lines.join(ids, "doc_id", "left").withColumn("_line", without_numbers(F.col("line"), F.col("_ids")))
    t = t.where((F.col("_line") == F.col("line")) | (X.strip(F.col("_line")) != ""))
    return t.withColumn("line", F.col("_line")).select(*lines.columns)


def squeeze_lines(lines: DataFrame) -> DataFrame:
    """A blank line stays only after a line that isn't blank."""
    blank = X.strip(F.col("line")) == ""
    was = F.lag(blank, 1, False).over(by_line())
    return lines.withColumn("_d", blank & was).where(~F.col("_d")).drop("_d")


def is_plain(line: Column) -> Column:
    """A line that paragraphs are made of: not blank, no comment, heading or marker, not all upper case."""
    s = X.strip(line)
    return (s != "") & ~s.startswith("<!--") & ~s.startswith("#") & ~s.startswith("«") & ~X.is_upper(s)


def merge_paragraphs(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line_no (of the first line), line: runs of plain lines joined by a space, other lines as they are.
    ``keep`` are columns of the document that stay."""
    w = by_line()
    t = lines.withColumn("plain", is_plain(F.col("line")))
    t = t.withColumn("island", F.sum(F.when(F.col("plain") & F.lag("plain", 1, False).over(w), 0).otherwise(1)).over(w))
    t = t.withColumn("part", F.when(F.col("plain"), X.strip(F.col("line"))).otherwise(F.col("line")))
    return t.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), F.expr("listagg(part, ' ') WITHIN GROUP (ORDER BY line_no)").alias("line"), F.max("plain").alias("plain"), *[F.any_value(c).alias(c) for c in keep]).drop("island")


def repeated_edges(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """First and last lines that stand on at least ``share`` of a document's pages: running headers and footers."""
    full = lines.where(X.strip(F.col("line")) != "")
    edge = full.groupBy("doc_id", "page_no").agg(F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))
    pages = edge.groupBy("doc_id").agg(F.count("*").alias("pages"))
    seen = edge.select("doc_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("line")).groupBy("doc_id", "line").count()
    return seen.join(pages, "doc_id").where((F.col("pages") > 1) & (F.col("count") >= share * F.col("pages"))).select("doc_id", "line", F.col("count").alias("n_pages"))


def split_numbered(line: Column) -> Column:
    """A line that holds several numbered items as an array of them."""
    return F.split(F.regexp_replace(line, r"(?<=\S)\s+(?=\d{1,2}\.\s+\p{Lu})", "\n"), "\n")


def restyle(line: Column) -> Column:
    """A heading of a bare line: upper case becomes a second-level title, mostly capitalised words a third-level one."""
    s = X.strip(line)
    words = F.split(s, r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    short = F.length(s) <= 80
    return F.when(short & X.is_upper(s) & (F.length(s) > 3), F.concat(F.lit("## "), F.initcap(s))).when(short & (F.size(words) >= 2) & (capital > 0.7 * F.size(words)), F.concat(F.lit("### "), s)).otherwise(line)


def clean_leaders(line: Column) -> Column:
    """Dots between a title and its page number become one space."""
    return F.regexp_replace(line, r"\s*\.{2,}\s*(\d+)\s*$", " $1")
