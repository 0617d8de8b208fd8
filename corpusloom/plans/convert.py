"""All phases of a conversion as one plan, for a whole corpus at once.

Everything here is about one document, so spans are dealt out by document once for the signatures and once for the text,
and every later window, aggregate and join keeps to that. What is known of a document's signatures is one row a document
(a map by signature key) and is looked up, not joined by signature. The steps are those of the operators; what they need
several passes for is done by windows here. A single document's lines are ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cleaning, fonts, marking, rendering, structure


def _key() -> Column:
    """The signature of a styled span as one text."""
    return F.concat_ws("|", "family", F.col("size").cast("string"), "weight", "style")


def summaries(spans: DataFrame) -> DataFrame:
    """doc_id, sigs map<key, struct<sig, ord, size, candidate, level, gone>>, body: of each document what its signatures are, which
    are removed (running footers, page numbers, watermarks, icons) and its body size. One aggregation over the spans."""
    t = fonts.styled(spans).withColumn("bare", X.strip(F.col("text")))
    full = F.col("bare") != ""
    h = F.col("page_height") if "page_height" in spans.columns else F.lit(800.0)
    own = lambda c: F.when(full, c)
    g = t.groupBy("doc_id", *fonts.KEY).agg(
        F.min(F.when(full & (F.col("page_no") <= fonts.SAMPLE_PAGES), fonts.position())).alias("first"),
        F.max("page_no").alias("last_page"),
        F.count_if(full).alias("cnt"),
        F.min(own(F.col("bare"))).alias("low"),
        F.max(own(F.col("bare"))).alias("high"),
        F.bool_and(own(F.col("origin_y") < fonts.TOP * h)).alias("top"),
        F.bool_and(own(F.col("origin_y") > fonts.BOTTOM * h)).alias("bottom"),
        F.collect_list(F.when(F.col("bare").rlike(r"^(\d{1,18}|[ivxIVX]{1,4})$"), F.struct("page_no", "line_no", "span_no", "bare"))).alias("short"),
        F.count("*").alias("spans"),
        F.sum(F.length("text")).alias("chars"),
        F.bool_or(F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")).alias("private"),
    )
    doc = Window.partitionBy("doc_id")
    known = F.col("first").isNotNull()
    g = g.withColumn("pages", F.max("last_page").over(doc))
    g = g.withColumn("ord", F.when(known, F.row_number().over(Window.partitionBy("doc_id", known).orderBy(F.desc("size"), "first"))))
    g = g.withColumn("sig", F.when(known, F.format_string("sig%03d", "ord")))
    # Spans are matched to the first signature of their family that is nearly their size; of one size the last gives the id.
    dim = Window.partitionBy("doc_id", "family", "size")
    g = g.withColumn("dim", F.when(known, F.struct(F.min("ord").over(dim).alias("at"), F.col("size").alias("size"), F.max_by("sig", "ord").over(dim).alias("sig"))))
    g = g.withColumn("dims", F.collect_set("dim").over(Window.partitionBy("doc_id", "family")))
    g = g.withColumn("match", F.array_min(F.filter("dims", lambda d: F.abs(d["size"] - F.col("size")) < fonts.TOLERANCE))["sig"])
    w = Window.partitionBy("doc_id", "match")
    total = lambda c: F.sum(c).over(w)
    cnt, every = total("cnt"), total("cnt") == F.col("pages")
    g = g.withColumn("texts", F.flatten(F.collect_list("short").over(w))).withColumn("texts", F.transform(F.array_sort("texts"), lambda x: x["bare"]))
    numbers = X.page_numbers(F.col("texts"))
    top, bottom = F.coalesce(F.bool_and("top").over(w), F.lit(False)), F.coalesce(F.bool_and("bottom").over(w), F.lit(False))
    # Low confidence (small print all over a page) is kept, as it may be content.
    footer = (cnt >= 0.8 * F.col("pages")) & ((every & (F.min("low").over(w) == F.max("high").over(w))) | (every & numbers & (top | bottom)) | bottom)
    named = F.exists(F.array(*[F.lit(x) for x in fonts.ICON_FONTS]), lambda x: F.contains(F.lower("family"), x))
    icon = F.bool_or("private").over(w) | (total("chars") / total("spans") <= 2)
    g = g.withColumn("out", F.when(F.col("match").isNotNull(), F.struct(footer.alias("footer"), icon.alias("icon"))))
    # What was found of a match holds for the signature that it names.
    g = g.withColumn("marks", F.collect_set(F.when(F.col("match").isNotNull(), F.struct("match", "out"))).over(doc))
    g = g.withColumn("mark", F.try_element_at(F.map_from_entries("marks"), F.coalesce("sig", F.lit(""))))
    g = g.withColumn("gone", F.coalesce(F.col("mark.footer") | F.col("mark.icon") | (named & F.col("mark").isNotNull()), F.lit(False)))
    number = (F.col("ord") > fonts.CANDIDATES) & F.col("low").rlike(r"(?U)^\d+$") & (F.col("low") == F.col("high"))
    info = F.struct("sig", "ord", "size", (F.col("ord") <= fonts.CANDIDATES).alias("candidate"), F.when(F.col("ord") <= fonts.CANDIDATES, F.least("ord", F.lit(fonts.TOP_LEVEL))).alias("level"), "gone", F.coalesce(number, F.lit(False)).alias("number"))
    sizes = F.when(known & F.col("size").between(8, 12), F.struct("size", "ord"))
    out = g.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(known, F.struct(_key().alias("key"), info.alias("info"))))).alias("sigs"), F.collect_list(sizes).alias("s"))
    count = lambda x: F.size(F.filter("s", lambda y: y["size"] == x["size"]))
    best = F.array_max(F.transform("s", lambda x: F.struct(count(x).alias("n"), (-x["ord"]).alias("o"), x["size"].alias("size"))))["size"]
    return out.select("doc_id", "sigs", F.coalesce(best, F.lit(10.0)).alias("body"))


def _by_sig(known: DataFrame) -> DataFrame:
    """doc_id, info map<sig, ...>, body."""
    return known.select("doc_id", F.transform_keys("sigs", lambda k, v: v["sig"]).alias("info"), "body")


def _titles(toc: DataFrame) -> DataFrame:
    """doc_id, titles map<key, level>: the outline of each document, the least level of each title."""
    t = toc.select("doc_id", X.norm_heading(F.col("title")).alias("key"), "level").repartition("doc_id").where("key <> ''")
    t = t.groupBy("doc_id", "key").agg(F.min("level").alias("level"))
    return t.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "level"))).alias("titles"))


def marked(spans: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, line_no, line: marked lines with page comments, without what is removed, blank lines squeezed and paragraphs joined."""
    t = fonts.styled(spans).select("doc_id", "page_no", "line_no", "span_no", "text", _key().alias("key"))
    t = t.join(known.select("doc_id", "sigs"), "doc_id").withColumn("x", F.try_element_at("sigs", F.col("key")))
    t = t.select("doc_id", "page_no", "line_no", "span_no", "text", F.col("x.sig").alias("sig"), F.coalesce("x.gone", F.lit(False)).alias("gone"))
    # Runs are formed before anything is removed, so what is left on both sides of it stays apart.
    found = marking.runs(t.withColumn("sig", F.when(F.col("gone"), F.concat("sig", F.lit("!"))).otherwise(F.col("sig"))))
    lines = marking.marked_lines(found.where(~F.coalesce(F.col("sig").endswith("!"), F.lit(False))))
    lines = lines.withColumn("_first", F.min("line_no").over(Window.partitionBy("doc_id", "page_no")))
    first = F.col("line_no") == F.col("_first")
    comment = F.concat(F.lit("<!-- Page "), F.col("page_no").cast("string"), F.lit(" -->"))
    lines = lines.select("doc_id", "page_no", F.posexplode(F.when(first, F.array(comment, "line")).otherwise(F.array("line"))).alias("p", "line"), (F.col("line_no") * 2).alias("at"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", F.col("at"), "p"))
    lines = lines.select("doc_id", (n - 1).alias("line_no"), "line")
    lines = cleaning.squeeze_lines(cleaning.drop_blank_markers(lines.withColumn("line", cleaning.wrap_marked(F.col("line")))))
    return cleaning.merge_paragraphs(lines).select("doc_id", "line_no", "line")


def labelled(lines: DataFrame, toc: DataFrame | None, keywords: tuple[str, ...] = structure.NOTE_KEYWORDS, captured: DataFrame | None = None) -> DataFrame:
    """A row for each marker, and for each line without one: doc_id, line_no, line (of the first marker only), pos, sig, label.
    ``lines`` hold info and body of their document."""
    m = rf"«(sig[a-z0-9]+):([^»]*)»"
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(m), 1).alias("sig"), F.regexp_extract_all("line", F.lit(m), 2).alias("text"))
    first = F.transform(F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("sig"), F.lit(None).cast("string").alias("text")))), lambda p, i: F.struct(i.alias("pos"), p["sig"].alias("sig"), p["text"].alias("text"), F.when(i == 0, F.col("line")).alias("line"), F.try_element_at("info", p["sig"]).alias("x")))
    t = lines.select("doc_id", "line_no", "body", F.explode(first).alias("m"))
    t = t.select("doc_id", "line_no", "m.line", "m.pos", "m.sig", X.unescape_marker(F.col("m.text")).alias("text"), "body", "m.x")
    cols = ["doc_id", "line_no", "line", "pos", "sig", "text", "body", "x.ord", "x.size", "x.candidate", "x.level"]
    level = F.lit(None)
    if toc is not None:
        t = t.select(*cols).join(_titles(toc), "doc_id", "left")
        level = F.try_element_at("titles", X.norm_heading(F.col("text")))
        cols = [c.split(".")[-1] for c in cols]
    t = t.select(*cols, level.cast("int").alias("at_level"))
    own = None
    if captured is not None:
        held = structure.captured_lines(captured).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "label"))).alias("held"))
        t = t.join(held, "doc_id", "left").withColumn("own", F.try_element_at("held", X.strip(F.col("text")))).drop("held")
        own = F.col("own")
    w, doc = Window.partitionBy("doc_id", "sig"), Window.partitionBy("doc_id")
    note = structure.note_label(F.col("text"), keywords, own)
    by = F.when(note.isNotNull(), F.struct("line_no", "pos"))
    cased = F.bool_or(X.is_all_caps(F.col("text")) | X.is_title_case(F.col("text"))).over(w)
    t = t.withColumn("toc_level", F.min("at_level").over(w)).withColumn("has_toc", F.max(F.col("at_level").isNotNull()).over(doc)).withColumn("cased", cased).withColumn("note", F.max_by(note, by).over(w)).withColumn("aloud", F.bool_or(structure.contains_any(F.col("text"), structure.READ_ALOUD)).over(w))
    false = F.lit(False)
    label = structure.label_of(F.lit(None).cast("string"), F.col("toc_level"), F.coalesce("cased", false), F.col("size"), F.col("body"), F.col("candidate"), F.col("level"), F.coalesce("has_toc", false), F.col("note"), F.coalesce("aloud", false))
    t = t.withColumn("label", F.when(F.col("ord").isNotNull(), label))
    head = F.col("label").startswith("H")
    t = t.withColumn("_has", F.max(F.coalesce(F.col("label") == "H1", F.lit(False))).over(doc))
    t = t.withColumn("_top", F.max_by(F.when(head, F.struct("sig", "label")), F.when(head, F.struct("size", -F.col("ord")))).over(doc))
    new = F.when(F.col("_has") | F.col("_top").isNull(), F.col("label")).when(F.col("sig") == F.col("_top.sig"), "H1").when(F.col("label") == F.col("_top.label"), "H2").otherwise(F.col("label"))
    return t.select("doc_id", "line_no", "line", "pos", "sig", new.alias("label"))


def labels(spans: DataFrame, toc: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """doc_id, sig, label of every signature, by the text as it is read, before clean-up."""
    known = summaries(spans) if known is None else known
    t = fonts.styled(spans).select("doc_id", "page_no", "line_no", "span_no", "text", _key().alias("key")).join(known.select("doc_id", "sigs"), "doc_id")
    found = marking.runs(t.select("doc_id", "page_no", "line_no", "span_no", "text", F.try_element_at("sigs", F.col("key"))["sig"].alias("sig")))
    marks, level = marking.markers(marking.marked_lines(found)), F.lit(None).cast("int")
    if toc is not None:
        marks, level = marks.join(_titles(toc), "doc_id", "left"), F.try_element_at("titles", X.norm_heading(F.col("text")))
    marks = marks.select("doc_id", "line_no", "pos", "sig", "text", level.cast("int").alias("at_level"))
    note = structure.note_label(F.col("text"), structure.NOTE_KEYWORDS)
    seen = marks.groupBy("doc_id", "sig").agg(
        F.bool_or(X.is_all_caps(F.col("text")) | X.is_title_case(F.col("text"))).alias("cased"),
        F.max_by(note, F.when(note.isNotNull(), F.struct("line_no", "pos"))).alias("note"),
        F.bool_or(structure.contains_any(F.col("text"), structure.READ_ALOUD)).alias("aloud"),
        F.min("at_level").alias("toc_level"),
    )
    seen = seen.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sig", F.struct("cased", "note", "aloud", "toc_level")))).alias("seen"), F.max(F.col("toc_level").isNotNull()).alias("has_toc"))
    t = known.join(seen, "doc_id", "left").select("doc_id", "body", "has_toc", "seen", F.explode(F.map_values("sigs")).alias("x"))
    t = t.select("doc_id", "body", "has_toc", "x.*", F.try_element_at("seen", F.col("x.sig")).alias("e"))
    false = F.lit(False)
    label = structure.label_of(F.lit(None).cast("string"), F.col("e.toc_level"), F.coalesce("e.cased", false), F.col("size"), F.col("body"), F.col("candidate"), F.col("level"), F.coalesce("has_toc", false), F.col("e.note"), F.coalesce("e.aloud", false))
    return structure.single_top(t.select("doc_id", "sig", "ord", "size", label.alias("label"))).select("doc_id", "sig", "label")


def convert(spans: DataFrame, toc: DataFrame | None = None, ends: DataFrame | None = None, fold_quotes: bool = False, images: DataFrame | None = None, tables: DataFrame | None = None, rules: DataFrame | None = None, keywords: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text: Markdown of each document.

    Spans become signatures and marked lines, without running footers, watermarks, icons and page numbers; lines are cleaned;
    signatures get labels by outline, case and size, and by callouts; lines are rendered, with images and tables at their pages.
    ``rules`` are callouts by start and end text (rule order by ``ord``), and give the end texts too. A document of which
    nothing is left has an empty text.
    """
    known = summaries(spans)
    lines = marked(spans, known).join(_by_sig(known), "doc_id")
    number = cleaning.without_numbers(F.col("line"), F.map_keys(F.map_filter("info", lambda k, v: v["number"])))
    lines = lines.withColumn("_line", number).where((F.col("_line") == F.col("line")) | (X.strip(F.col("_line")) != ""))
    lines = lines.withColumn("line", F.col("_line")).drop("_line")
    lines = lines.withColumn("line", X.normalise_bullet(X.join_hyphens(X.fix_typography(X.fix_spacing(F.col("line")), fold_quotes))))
    captured = None
    if rules is not None:
        marks = marking.markers(lines)
        blocks = marks.groupBy("doc_id", F.col("line_no").alias("ord")).agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"))
        captured = structure.boundary_capture(blocks, rules)
        ends = rules if ends is None else ends
    m = labelled(lines, toc, structure.NOTE_KEYWORDS + tuple(keywords), captured).where("pos = 0")
    out = rendering.render(rendering.callout_state(m.select("doc_id", "line_no", "line", "sig", "label"), ends))
    if images is not None:
        out = rendering.place_images(out, images)
    if tables is not None:
        out = rendering.place_tables(out, tables)
    return spans.select("doc_id").distinct().join(rendering.documents(out), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
