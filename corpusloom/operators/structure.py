"""Headings, callouts and outlines: from markers and signatures to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

#: Phrases that a note for the game master holds, and phrases of text meant to be read aloud.
NOTE_KEYWORDS = ("gm note", "gm notes", "game master note", "keeper note", "keeper notes", "dm note", "dm notes", "dungeon master note")
READ_ALOUD = ("read aloud", "read the following", "boxed text", "sidebar")

#: Words that head a printed outline, and terms that spelling repair must leave alone.
TOC_KEYWORDS = ("contents", "table of contents", "index")
DOMAIN_TERMS = ("AC", "HP", "DC", "STR", "DEX", "CON", "INT", "WIS", "CHA", "THAC0", "XP", "GP", "SP", "CP", "PP", "EP", "DM", "GM", "PC", "NPC", "BBEG")

MAX_RULES = 1000


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that the text holds."""
    low = F.lower(text)
    return F.try_element_at(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(1))


def toc_levels(markers: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, sig, toc_level: the least outline level among the titles that markers of the signature match."""
    titles = toc.groupBy("doc_id", X.norm_heading(F.col("title")).alias("key")).agg(F.min("level").alias("level")).where("key <> ''")
    m = markers.withColumn("key", X.norm_heading(F.col("text")))
    return m.join(titles, ["doc_id", "key"]).groupBy("doc_id", "sig").agg(F.min("level").alias("toc_level"))


def note_label(text: Column, keywords: tuple[str, ...], own: Column | None = None) -> Column:
    """The label of a marker as a note: that of the captured callout that holds it, else callout_gm for a keyword."""
    word = F.when(contains_any(text, keywords), "callout_gm")
    return word if own is None else F.coalesce(own, word)


def evidence(markers: DataFrame, keywords: tuple[str, ...] = NOTE_KEYWORDS) -> DataFrame:
    """doc_id, sig with what its markers show: upper case, title case, the label of the last note, read-aloud text.
    Markers may have a column ``own``, the label of the captured callout that holds them."""
    at = F.struct("line_no", "pos")
    note = note_label(F.col("text"), keywords, F.col("own") if "own" in markers.columns else None)
    return markers.groupBy("doc_id", "sig").agg(
        F.bool_or(X.is_all_caps(F.col("text"))).alias("caps"),
        F.bool_or(X.is_title_case(F.col("text"))).alias("title"),
        F.max_by(note, F.when(note.isNotNull(), at)).alias("note"),
        F.bool_or(contains_any(F.col("text"), READ_ALOUD)).alias("aloud"),
    )


def captured_lines(captured: DataFrame) -> DataFrame:
    """doc_id, key, label: the lines of captured callouts, each with the label of the first rule that holds it."""
    order = "rule" if "rule" in captured.columns else "ord"
    line = captured.select("doc_id", F.col(order).alias("o"), "label", F.explode(F.split("text", "\n")).alias("key")).withColumn("key", X.strip(F.col("key"))).where("key <> ''")
    return line.groupBy("doc_id", "key").agg(F.min_by("label", "o").alias("label"))


def callout_members(markers: DataFrame, captured: DataFrame) -> DataFrame:
    """Markers whose stripped text is a line of a callout captured in their document, with the label of the first rule that holds it."""
    return markers.withColumn("key", X.strip(F.col("text"))).join(captured_lines(captured), ["doc_id", "key"]).drop("key")


def unmatched_markers(markers: DataFrame, sigs: DataFrame) -> DataFrame:
    """doc_id, n: markers whose signature is not known; a warning, as they are skipped."""
    return markers.join(sigs.select("doc_id", "sig"), ["doc_id", "sig"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


def read_aloud(markers: DataFrame) -> DataFrame:
    """Markers that hold a phrase of text meant to be read aloud."""
    return markers.where(contains_any(F.col("text"), READ_ALOUD))


def labels(sigs: DataFrame, body: DataFrame, toc: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id, sig, label: heading levels from outline, case and size, then callouts.

    Where the outline matches some signature of a document, those with headings by case alone that are no candidates are
    left as they are, without a callout too. Callouts look at the label that the signature had before.
    """
    known = toc.select("doc_id").distinct().withColumn("has_toc", F.lit(True))
    t = sigs.join(body, "doc_id", "left").join(toc, ["doc_id", "sig"], "left").join(seen, ["doc_id", "sig"], "left").join(known, "doc_id", "left")
    old = F.col("label") if "label" in sigs.columns else F.lit(None).cast("string")
    label = label_of(old, F.col("toc_level"), F.coalesce(F.col("caps") | F.col("title"), F.lit(False)), F.col("size"), F.col("body_size"), F.col("candidate_heading"), F.col("suggested_level"), F.coalesce("has_toc", F.lit(False)), F.col("note"), F.coalesce("aloud", F.lit(False)))
    return t.select("doc_id", "sig", "ord", "size", label.alias("label"))


def label_of(old: Column, toc_level: Column, cased: Column, size: Column, body: Column, candidate: Column, level: Column, has_toc: Column, note: Column, aloud: Column) -> Column:
    """The rule of ``labels`` on columns."""
    cased = old.isNull() & toc_level.isNull() & cased & (size > body)
    by_size = F.when(size > 1.5 * body, "H2").when(size > body, "H3").otherwise("H4")
    heading = F.when(old.isNotNull(), old).when(toc_level.isNotNull(), X.level_label(toc_level)).when(cased, F.coalesce(F.when(level.isNotNull(), X.level_label(level)), by_size))
    was = F.coalesce(old, F.lit(""))
    noted = F.when(note.isNotNull(), F.when(~was.isin("H1", "callout_read_aloud"), note).otherwise(heading))
    read = F.when(aloud, F.when(~was.isin("H1", "callout_gm"), "callout_read_aloud").otherwise(heading))
    return F.when(cased & has_toc & ~candidate, old).otherwise(F.coalesce(noted, read, heading))


def single_top(labelled: DataFrame) -> DataFrame:
    """Without any H1 the largest heading (the first of equals) becomes H1; others of its former label become H2."""
    w = Window.partitionBy("doc_id")
    heading = F.col("label").startswith("H")
    t = labelled.withColumn("_has", F.max(F.coalesce(F.col("label") == "H1", F.lit(False))).over(w))
    t = t.withColumn("_top", F.max_by(F.when(heading, F.struct("sig", "label")), F.when(heading, F.struct("size", -F.col("ord")))).over(w))
    new = F.when(F.col("_has") | F.col("_top").isNull(), F.col("label")).when(F.col("sig") == F.col("_top.sig"), "H1").when(F.col("label") == F.col("_top.label"), "H2").otherwise(F.col("label"))
    return t.withColumn("label", new).drop("_has", "_top")


def boundary_capture(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocks that lie from a rule's start text to its end text: label, doc_id, ord, rule (its place), text cut at both.

    A block that holds the start opens (even if an end comes earlier in it); the end closes; a start
    without an end captures to the document's end. ``rules`` is a small table, sent to every task.
    """
    if (n := rules.count()) > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES} can be sent to every task")
    order = F.col("rule") if "rule" in rules.columns else F.col("ord") if "ord" in rules.columns else F.monotonically_increasing_id()
    t = blocks.join(F.broadcast(rules.select("label", "start_text", "end_text", order.alias("rule"))), F.lit(True))
    t = t.withColumn("s", F.expr("locate(start_text, text)")).withColumn("e", F.expr("locate(end_text, text, greatest(locate(start_text, text), 1))"))
    event = F.when(F.col("s") > 0, F.when(F.col("e") > 0, "both").otherwise("open")).when(F.col("e") > 0, "close")
    w = Window.partitionBy("rule", "doc_id").orderBy("ord")
    was = F.last(F.when(event.isin("both", "close"), "close").when(event == "open", "open"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("event", event).withColumn("inside", F.coalesce(was == "open", F.lit(False)))
    text = F.when(F.col("event") == "both", F.expr("substring(text, s, e + length(end_text) - s)")).when(F.col("event") == "open", F.expr("substring(text, s)")).when(F.col("inside") & (F.col("event") == "close"), F.expr("substring(text, 1, e + length(end_text) - 1)")).when(F.col("inside"), F.col("text"))
    return t.withColumn("captured", text).where("captured is not null").select("label", "doc_id", "ord", "rule", F.col("captured").alias("text"))


def visual_toc_page(pages: DataFrame) -> DataFrame:
    """doc_id, page_no: the first of pages 1 to 3 that looks like a printed outline: by a word at its head, or by five lines
    with page numbers among eight or more, blank ones counted."""
    head = F.substring(F.lower("text"), 1, 500)
    lines = F.split("text", "\n")
    numbered = F.size(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("page ")) | X.strip(x).rlike(r"([1-9]|[1-9]0)$")))
    hit = contains_any(head, TOC_KEYWORDS) | ((numbered >= 5) & (F.size(lines) >= 8))
    return pages.where((F.col("page_no") <= 3) & hit).groupBy("doc_id").agg(F.min("page_no").alias("page_no"))


def domain_terms(samples: DataFrame, fixed: tuple[str, ...] = DOMAIN_TERMS) -> DataFrame:
    """Distinct upper-case alphabetic words of at least two letters of the samples, with the fixed terms."""
    w = samples.select(F.explode(F.split("sample", r"\s+")).alias("w"))
    w = w.select(F.upper(F.regexp_replace("w", r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "")).alias("term")).where(F.col("term").rlike(r"^\p{L}{2,}$"))
    return w.union(samples.sparkSession.createDataFrame([(x,) for x in fixed], "term string")).distinct()


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines by their kind: heading (all caps or title case, short, without an end mark), else paragraph, else blank."""
    s = X.strip(F.col("line"))
    heading = (F.length(s) <= 80) & ~s.rlike(r"[.,;:!?]$") & (X.is_all_caps(s) | X.is_title_case(s))
    return lines.withColumn("kind", F.when(s == "", "blank").when(heading, "heading").otherwise("paragraph"))
