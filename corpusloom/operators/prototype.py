"""Operators of the simpler, prototype way of conversion: labels of whole lines by font, inline headings, one-pass styling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cleaning

#: Which of two labels of one line wins.
PRIORITY = {"#": 5, "##": 4, "###": 3, "gm_note": 3, "quote": 2, "quote_author": 2, "body": 1, "-": 0}


def heading_key(c: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; the key by which lines are matched."""
    return X.strip(F.regexp_replace(F.regexp_replace(F.lower(c), f"(?!{X.SPACE})[^a-z0-9]", ""), f"{X.SPACE}+", " "))


def dominant_fonts(spans: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, text, font, size: of each line that isn't blank the font and size (to a tenth) that most of
    its characters have, the first of equals."""
    t = spans.withColumn("size", F.bround("size", 1))
    line = ["doc_id", "page_no", "line_no"]
    g = t.groupBy(*line, "font", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("span_no").alias("first"), F.array_sort(F.collect_list(F.struct("span_no", "text"))).alias("parts"))
    g = g.groupBy(*line).agg(F.max_by(F.struct("font", "size"), F.struct("chars", -F.col("first"))).alias("f"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))
    text = X.strip(F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    return g.select(*line, text.alias("text"), "f.font", "f.size").where("text <> ''")


def font_labels(lines: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """Lines (font, size, text) with ``label``: the override of their text for the font, else the label of the very size, else of the
    first (ord) size of the font within the tolerance. ``mapping``: ord, font, size, label; ``overrides``: font, size, key, label.

    The few sizes of each font are matched to the mapping first, then the lines to their sizes."""
    sizes = lines.select("font", "size").distinct()
    near = sizes.join(mapping.select("font", F.col("size").alias("at"), "ord", F.col("label").alias("l")), "font").where(F.abs(F.col("at") - F.col("size")) <= tolerance + 1e-9)
    best = near.groupBy("font", "size").agg(F.min_by("l", F.struct(F.col("at") != F.col("size"), "ord")).alias("label"))
    t = lines.join(best, ["font", "size"], "left")
    if overrides is None:
        return t
    o = overrides.groupBy("font", "size", "key").agg(F.min("label").alias("own"))
    t = t.withColumn("key", heading_key(F.col("text"))).join(o, ["font", "size", "key"], "left")
    return t.withColumn("label", F.coalesce("own", "label")).drop("own", "key")


def line_labels(labelled: DataFrame) -> DataFrame:
    """doc_id, key, label: of all labels that lines of one key have, that of the highest priority, the first of equals."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("label")], F.lit(0))
    t = labelled.where("label is not null").withColumn("key", heading_key(F.col("text"))).where("key <> ''")
    order = F.struct(rank, -F.col("page_no"), -F.col("line_no"))
    return t.groupBy("doc_id", "key").agg(F.max_by("label", order).alias("label"))


def mashed(line: Column, titles: Column) -> Column:
    """Whether a line is several outline entries run together: five numbers or more, and three of the titles."""
    low = F.lower(line)
    hits = F.size(F.filter(titles, lambda t: F.contains(low, F.lower(t))))
    return (F.regexp_count(line, F.lit(r"\d+")) >= 5) & (hits >= 3)


def split_headings(lines: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, line_no, part, line: a line that holds a heading phrase at a sentence's begin is cut in up to three, the phrase with its
    mark between. ``phrases``: doc_id, ord, phrase, mark; the first phrase that fits is taken. It fits if only white space or an
    end of sentence is before it and an upper-case letter is in it."""
    listed = phrases.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "phrase", "mark"))).alias("p"))
    t = lines.join(listed, "doc_id", "left").withColumn("s", X.strip(F.col("line")))

    def found(p: Column) -> Column:
        at = F.position(F.lower(p["phrase"]), F.lower("s"))
        before = F.regexp_extract(F.substr("s", F.lit(1), at - 1), f"(\\S){X.SPACE}*$", 1)
        own = F.substr("s", at, F.length(p["phrase"]))
        return (at > 0) & before.isin("", ".", "!", "?") & own.rlike(r"\p{Lu}")

    t = t.withColumn("hit", F.try_element_at(F.filter("p", found), F.lit(1)))
    at, n = F.position(F.lower("hit.phrase"), F.lower("s")), F.length("hit.phrase")
    cut = F.array(X.strip(F.substr("s", F.lit(1), at - 1)), F.concat("hit.mark", F.lit(" "), F.substr("s", at, n)), X.strip(F.substr("s", at + n)))
    parts = F.when(F.col("hit").isNull(), F.array("s")).otherwise(F.filter(cut, lambda x: x != ""))
    return t.select("doc_id", "line_no", F.posexplode(parts).alias("part", "line"))


def one_pass(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line: bare page numbers go, bullets are normal, upper-case and capitalised lines are headings, words cut at line
    ends and plain lines are joined; a line before a blank one stays a line of its own."""
    s = X.strip(F.col("line"))
    t = lines.where(~s.rlike(r"(?U)^\d+$") | (s == "")).withColumn("line", cleaning.restyle(F.when(s == "", "").otherwise(X.normalise_bullet(s))))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    # A word cut at the end of a line goes on in the next one, so the two are one line.
    t = t.withColumn("_glued", F.coalesce(F.lag("line").over(w).rlike(r"(?U)\w-$") & F.col("line").rlike(r"(?U)^\w"), F.lit(False)))
    t = t.withColumn("_i", F.sum(F.when(F.col("_glued"), 0).otherwise(1)).over(w))
    part = F.when(F.coalesce(F.lead("_glued").over(w), F.lit(False)), F.regexp_replace("line", "-$", "")).otherwise(F.col("line"))
    t = t.withColumn("part", part).groupBy("doc_id", "_i").agg(F.min("line_no").alias("line_no"), F.expr("listagg(part, '') WITHIN GROUP (ORDER BY line_no)").alias("line"))
    plain = (F.col("line") != "") & ~F.col("line").rlike("^(#|- |>)")
    t = t.withColumn("_p", plain).withColumn("_own", F.coalesce(F.lead("line").over(w) == "", F.lit(False)))
    t = t.withColumn("_k", F.sum(F.when(F.col("_p") & ~F.col("_own") & F.lag("_p", 1, False).over(w), 0).otherwise(1)).over(w))
    t = t.groupBy("doc_id", "_k").agg(F.min("line_no").alias("line_no"), F.expr("listagg(line, ' ') WITHIN GROUP (ORDER BY line_no)").alias("line"))
    return cleaning.squeeze_lines(t.select("doc_id", "line_no", "line"))
