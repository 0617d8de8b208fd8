"""From labelled marked lines to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.cleaning import MARKER

#: A page comment; those within callouts are quoted.
PAGE_COMMENT = r"^(?:> )?<!-- Page (\d+) -->$"


def literal(text: Column) -> Column:
    """Safe as a regular-expression replacement."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def bare(line: Column, before: Column | None = None) -> Column:
    """The texts of a line's markers, each after ``before``, and all around them."""
    if before is None:
        return X.unescape_marker(F.regexp_replace(line, MARKER, "$2"))
    return X.unescape_marker(F.regexp_replace(line, F.lit(MARKER), F.concat(literal(before), F.lit("$2"))))


def first_label(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Lines with the label of their first marker's signature (null without one)."""
    t = lines.withColumn("sig", F.nullif(F.regexp_extract("line", MARKER, 1), F.lit("")))
    return t.join(labelled.where("label is not null").select("doc_id", "sig", "label"), ["doc_id", "sig"], "left")


def last_ends(rules: DataFrame) -> DataFrame:
    """label, end_text: of the rules of one label that have an end text, the last (by ord) gives it."""
    return rules.where("end_text <> ''").groupBy("label").agg(F.max_by("end_text", "ord").alias("end_text"))


def callout_state(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Lines with ``callout``: the callout they stand in, else null.

    A callout label opens one (or another); a heading or other marker closes it; a line with the callout's marker that
    holds its end text is its last. Lines without a marker, blank ones and page comments too, stay in it.
    ``ends`` (label, end_text, and an ord where a label has more) are the few rules of callouts, sent to every task.
    """
    if ends is None:
        t = lines.withColumn("end_text", F.lit(None).cast("string"))
    else:
        t = lines.join(F.broadcast(last_ends(ends if "ord" in ends.columns else ends.withColumn("ord", F.lit(0)))), "label", "left")
    opens = F.coalesce(F.col("label").startswith("callout"), F.lit(False))
    ended = opens & F.coalesce(F.contains("line", "end_text"), F.lit(False))
    # What holds after the line; the line itself stands in the callout that it opens.
    after = F.when(ended, "").when(opens, F.col("label")).when(F.col("sig").isNotNull(), "")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    t = t.withColumn("after", after).withColumn("cur", F.last("after", ignorenulls=True).over(w))
    return t.withColumn("callout", F.when(opens, F.col("label")).when(F.col("sig").isNull() & (F.col("cur") != ""), F.col("cur"))).withColumn("last_line", ended).drop("after", "cur", "end_text")


def unclosed_callouts(stated: DataFrame) -> DataFrame:
    """doc_id, callout of documents whose last line stands in a callout that doesn't end there."""
    last = stated.groupBy("doc_id").agg(F.max_by(F.struct("callout", "last_line"), "line_no").alias("z"))
    return last.where("z.callout is not null and not z.last_line").select("doc_id", F.col("z.callout").alias("callout"))


def render(stated: DataFrame) -> DataFrame:
    """doc_id, line_no, line in Markdown: every marker of a heading line or a callout's is prefixed, lines without a marker
    in a callout are quoted, other markers are bare."""
    level = F.coalesce(F.regexp_extract("label", r"^H([1-6])$", 1), F.lit(""))
    line = F.col("line")
    heading = bare(line, F.concat(F.repeat(F.lit("#"), F.when(level != "", level.cast("int"))), F.lit(" ")))
    callout = F.when(F.col("sig").isNotNull(), bare(line, F.lit("> "))).otherwise(F.concat(F.lit("> "), line))
    out = F.when(level != "", heading).when(F.col("callout").isNotNull(), callout).otherwise(bare(line))
    return stated.select("doc_id", "line_no", out.alias("line"))


def counts(stated: DataFrame) -> DataFrame:
    """doc_id, label, n: heading and callout lines by label."""
    return stated.where(F.col("label").rlike("^(H[1-6]$|callout)")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def table_text(lines: DataFrame, limit: int = 21) -> DataFrame:
    """doc_id, page, text: the lines of a page that look like a table's (two spaces, a tab, more than three spaces), the first ``limit``."""
    page = F.regexp_extract("line", PAGE_COMMENT, 1)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    t = lines.withColumn("page", F.last(F.when(page != "", page.cast("int")), ignorenulls=True).over(w)).where((page == "") & F.col("page").isNotNull())
    rowlike = F.contains("line", F.lit("  ")) | F.contains("line", F.lit("\t")) | (F.regexp_count(X.strip(F.col("line")), F.lit(" ")) > 3)
    t = t.where(rowlike).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no"))).where(F.col("nth") <= limit)
    return t.groupBy("doc_id", "page").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def place_images(lines: DataFrame, images: DataFrame) -> DataFrame:
    """A figure placeholder and a commented link after the comment of the image's page; later images of a page come first."""
    page = F.regexp_extract("line", PAGE_COMMENT, 1)
    marks = lines.withColumn("page", F.when(page != "", page.cast("int"))).where("page is not null").select("doc_id", "page", "line_no")
    put = images.join(marks, ["doc_id", "page"]).select("doc_id", "line_no", (-F.col("img_index")).alias("sub"), F.concat(F.lit("[FIGURE: "), F.coalesce("alt_text", F.lit("")), F.lit("]\n<!-- ![]("), "filename", F.lit(") -->")).alias("line"))
    t = lines.select("doc_id", "line_no", F.lit(-(1 << 31)).cast("long").alias("sub"), "line").union(put.select("doc_id", "line_no", F.col("sub").cast("long"), "line"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "sub"))
    return t.select("doc_id", (n - 1).alias("line_no"), "line")


def place_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """A table's Markdown after the first line of its page that is followed by a blank one (else after the page comment)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    page = F.regexp_extract("line", PAGE_COMMENT, 1)
    own = F.when(page != "", page.cast("int"))
    t = lines.withColumn("page", F.last(own, ignorenulls=True).over(w)).withColumn("gap", F.coalesce(F.trim(F.lead("line").over(w)) == "", F.lit(False)))
    slot = t.where("page is not null").groupBy("doc_id", "page").agg(F.coalesce(F.min(F.when(F.col("gap"), F.col("line_no"))), F.min("line_no")).alias("line_no"))
    put = tables.join(slot, ["doc_id", "page"]).withColumn("sub", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_id")))
    both = lines.select("doc_id", "line_no", F.lit(0).alias("sub"), "line").union(put.select("doc_id", "line_no", "sub", F.concat(F.lit("\n"), "markdown").alias("line")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "sub"))
    return both.select("doc_id", (n - 1).alias("line_no"), "line")


def documents(lines: DataFrame) -> DataFrame:
    """doc_id, text: the lines put together, only here."""
    return lines.groupBy("doc_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


NOTICE = """<!--
COPYRIGHT NOTICE
================
This text was made from a published document, for personal use only. Its content remains
the property of the publisher; do not pass it on or publish it.

Title: {title}
Author/Publisher: {author}
Copyright: {copyright}
Source file: {title}
Converted: {date}
Tool: corpusloom
-->

"""


def copyright_notice(meta: DataFrame, date: str) -> DataFrame:
    """doc_id, notice: a comment with title, author (else creator) and copyright; the last part of the copyright stands in for a title."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.coalesce(given("title"), F.element_at(F.split(F.coalesce(given("copyright"), F.lit("Unknown")), "/"), -1))
    values = {"{title}": title, "{author}": F.coalesce(given("author"), given("creator"), F.lit("Unknown")), "{copyright}": F.coalesce(given("copyright"), F.lit("See original publication")), "{date}": F.lit(date)}
    text = F.lit(NOTICE)
    for name, value in values.items():
        text = F.replace(text, F.lit(name), value)
    return meta.select("doc_id", text.alias("notice"))


def with_notice(texts: DataFrame, notices: DataFrame) -> DataFrame:
    """doc_id, text with the notice of the document before it."""
    return texts.join(notices, "doc_id", "left").select("doc_id", F.concat(F.coalesce("notice", F.lit("")), "text").alias("text"))
