"""Text extraction with signature markers, and reassembly in page order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

LINE = ["doc_id", "page_no", "line_no"]


def chunks(pages: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, chunk, first and last page of ranges of ``size`` pages."""
    g = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    t = g.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size))).alias("start"))
    return t.select("doc_id", (F.col("start") / size).cast("int").alias("chunk"), (F.col("start") + 1).alias("first_page"), F.least(F.col("start") + size, F.col("n")).alias("last_page"))


def runs(spans: DataFrame) -> DataFrame:
    """Consecutive spans of a line with one signature as one run: doc_id, page_no, line_no, run, sig, text.

    Two parts get a space between them if neither has one at the border and neither is blank. Empty spans are
    skipped; a span without a signature is a run of its own.
    """
    w = Window.partitionBy(*LINE).orderBy("span_no")
    t = spans.where(F.col("text") != "")
    same = F.col("sig").isNotNull() & F.coalesce(F.col("sig") == F.lag("sig").over(w), F.lit(False))
    before = F.lag("text").over(w)
    gap = same & before.rlike(r"\S$") & F.col("text").rlike(r"^\S")
    t = t.withColumn("part", F.when(gap, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))).withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return t.groupBy(*LINE, "run", "sig").agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY span_no)").alias("text"))


def marked_lines(found: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line: runs as markers, runs without a signature bare and set off by a space."""
    bare = F.col("sig").isNull()
    part = F.when(bare, F.when((F.col("run") > 1) & F.col("text").rlike(r"^\S"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))).otherwise(F.concat(F.lit("«"), "sig", F.lit(":"), X.escape_marker(F.col("text")), F.lit("»")))
    return found.withColumn("part", part).groupBy(*LINE).agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY run)").alias("line"))


def merged(lines: DataFrame) -> DataFrame:
    """doc_id, text: pages in order, each after a marker comment. Lines of a block and blocks of a page are both joined by a line
    feed; lines without text are not there, so blocks without any leave nothing."""
    page = lines.groupBy("doc_id", "page_no").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("body"))
    page = page.withColumn("body", F.concat(F.lit("\n<!-- Page "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), "body", F.lit("\n")))
    return page.groupBy("doc_id").agg(F.expr("listagg(body, '') WITHIN GROUP (ORDER BY page_no)").alias("text"))


def with_page_markers(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line in long form with the page comments between; the text itself is only put together at the sink."""
    marks = lines.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(-1).alias("line_no"), F.concat(F.lit("<!-- Page "), F.col("page_no").cast("string"), F.lit(" -->")).alias("line"))
    t = lines.select("doc_id", "page_no", "line_no", "line").unionByName(marks)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "line_no"))
    return t.select("doc_id", (n - 1).alias("line_no"), "line")


def boundaries(lines: DataFrame, context: int = 20) -> DataFrame:
    """Lines that end in a hyphen, where a sentence may be cut: page, line, type, the last characters."""
    s = F.regexp_replace("line", r"\s+$", "")
    return lines.where(s.endswith("-")).select("doc_id", "page_no", "line_no", F.lit("hyphen").alias("type"), F.right(s, F.lit(context)).alias("text"))


def markers(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, sig, text of every marker."""
    m = r"«(sig[a-z0-9]+):([^»]*)»"
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(m), 1).alias("sig"), F.regexp_extract_all("line", F.lit(m), 2).alias("text"))
    return lines.select("doc_id", "line_no", F.posexplode(pairs).alias("pos", "m")).select("doc_id", "line_no", "pos", "m.sig", X.unescape_marker(F.col("m.text")).alias("text"))


def page_of_lines(lines: DataFrame) -> DataFrame:
    """Lines with the number of the page whose comment came last before them; bounded by the next comment."""
    n = F.regexp_extract("line", r"^<!-- Page (\d+) -->$", 1)
    own = F.when(n != "", n.cast("int"))
    return lines.withColumn("page", F.last(own, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")))
