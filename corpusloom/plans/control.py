"""More registered queries: intake, artefacts, agents, prototype operators; each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import agents, fonts, intake, marking, prototype, quality, rendering, runs, structure
from corpusloom.plans.catalogue import LINES, MARKED, PAGED, SIGS, SPANS, STRIP, docs_of, lines_of, markdown_of, marked_of, paged_of, register, spans_of
from corpusloom.sources import artifacts, decoding, tables

# -- intake ----------------------------------------------------------------------------------------------


def decoded_of(spark, sf):
    """Documents as a decoder would give them: pages of ten lines, an outline, fonts, images, dates; some can't be read."""
    d = tables.parquet(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    k = F.col("doc_id")
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), lambda i: F.struct((i + 1).alias("page_no"), F.lit(612.0).alias("width"), (F.lit(700.0) + i).alias("height"), F.array_join(F.slice(lines, i * 10 + 1, F.lit(10)), "\n").alias("text")))
    toc = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: (x["i"] % 4 == 0) & F.length(x["x"]).between(3, 60)), lambda x: F.struct((1 + x["i"] % 3).cast("int").alias("level"), x["x"].alias("title"), (x["i"] + 1).cast("int").alias("page")))
    fonts_ = F.transform(F.sequence(F.lit(0), (k % 12).cast("int")), lambda i: F.struct(F.lit(1).alias("page_no"), F.concat(F.lit("ABCDEF+"), "source", F.floor(i / 2).cast("string"), F.when(i % 2 == 0, "-Bold").otherwise(" Italic")).alias("name")))
    some = F.filter(F.sequence(F.lit(1), F.lit(60)), lambda i: i <= k % 60)
    images = F.transform(some, lambda i: F.struct((i % 3 + 1).alias("page_no"), i.alias("img_index"), F.when(i % 4 > 0, F.array(F.struct(i.cast("double").alias("x0"), F.lit(2.0).alias("y0"), (i + 10).cast("double").alias("x1"), F.lit(7.5).alias("y1")))).otherwise(F.array().cast(f"array<{decoding.RECT}>")).alias("rects"), F.lit(None).cast("binary").alias("content")))
    info = F.struct(F.when(k % 3 > 0, F.col("source")).alias("title"), F.lit(None).cast("string").alias("author"), F.col("lang").alias("creator"), F.lit("").alias("producer"), F.when(k % 5 == 0, "(c)").otherwise("").alias("copyright"), F.when(k % 2 == 0, "D:20240131").otherwise("D:2024133").alias("creation_date"), F.lit(None).cast("string").alias("modification_date"))
    error = F.when(k % 50 == 7, "encrypted").when(k % 50 == 8, "unreadable: cut short")
    return d.select("doc_id", F.concat(F.lit("/in/"), k.cast("string"), F.lit(".pdf")).alias("path"), (F.col("n_chars") * 1000 * (k % 2)).alias("file_size_bytes"), error.alias("error"), info.alias("info"), toc.alias("toc"), pages.alias("pages"), fonts_.alias("fonts"), images.alias("images"))


META = f"""{LINES}, base AS (SELECT doc_id, n_chars * 1000 * (doc_id % 2) AS file_size_bytes, source, lang FROM documents),
n AS (SELECT doc_id, CAST((count(*) + 9) // 10 AS INT) AS page_count, CAST(count(*) FILTER (line_no % 4 = 0 AND length(line) BETWEEN 3 AND 60) AS INT) AS toc_entries, CAST(coalesce(max(1 + line_no % 3) FILTER (line_no % 4 = 0 AND length(line) BETWEEN 3 AND 60), 0) AS INT) AS toc_max_depth FROM lines GROUP BY doc_id),
meta AS (SELECT *, CAST(doc_id % 60 AS INT) AS image_count, CAST(doc_id % 12 // 2 + 1 AS INT) AS font_count FROM base JOIN n USING (doc_id))"""


@register(f"""
WITH {META} SELECT doc_id, file_size_bytes, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS title, '' AS author, lang AS creator, CASE WHEN doc_id % 5 = 0 THEN '(c)' END AS copyright, page_count, toc_entries > 0 AS has_toc, toc_entries, toc_max_depth, image_count, font_count,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS creation_date FROM meta""")
def src01_metadata(spark, sf_dir):
    t = intake.metadata(decoded_of(spark, sf_dir)).drop("producer", "modification_date")
    return t.withColumn("creation_date", F.col("creation_date").cast("timestamp_ntz"))


@register("SELECT doc_id, CASE doc_id % 50 WHEN 7 THEN 'PDF_ENCRYPTED' ELSE 'PDF_NOT_FOUND' END AS code, CASE doc_id % 50 WHEN 7 THEN 'PDF is encrypted or password-protected' ELSE 'unreadable: cut short' END AS message FROM documents WHERE doc_id % 50 IN (7, 8)")
def src02_refused(spark, sf_dir):
    return decoding.refused(decoded_of(spark, sf_dir)).drop("path")


@register(f"WITH {LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS ord, CAST(1 + line_no % 3 AS INT) AS level, line AS title, CAST(line_no + 1 AS INT) AS page FROM lines WHERE line_no % 4 = 0 AND length(line) BETWEEN 3 AND 60")
def src03_outline(spark, sf_dir):
    return decoding.outline(decoded_of(spark, sf_dir))


@register(f"WITH {LINES} SELECT doc_id, CAST(line_no // 10 + 1 AS INT) AS page_no, 612.0::DOUBLE AS width, (700 + line_no // 10)::DOUBLE AS height, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM lines WHERE line_no < 30 GROUP BY doc_id, line_no // 10")
def src05_pages(spark, sf_dir):
    """The first three pages: their sizes and texts."""
    t = decoding.pages(decoded_of(spark, sf_dir), 3)
    return t.select("doc_id", "page_no", "width", "height", F.md5("text").alias("text_md5"))


@register("SELECT doc_id, lower(source) || i // 2 AS family, count(*) AS n FROM documents, (SELECT unnest(range(0, 12)) AS i) WHERE i <= doc_id % 12 GROUP BY ALL")
def src07_fonts(spark, sf_dir):
    return decoding.fonts(decoded_of(spark, sf_dir)).groupBy("doc_id", "family").agg(F.count("*").alias("n"))


@register("""SELECT doc_id, CAST(i % 3 + 1 AS INT) AS page, CAST(i AS INT) AS img_index, printf('page%03d_img%02d.png', i % 3 + 1, i) AS filename, CASE WHEN i % 4 > 0 THEN i::DOUBLE ELSE 0 END AS x, CASE WHEN i % 4 > 0 THEN 10.0::DOUBLE ELSE 0 END AS width, CASE WHEN i % 4 > 0 THEN 5.5::DOUBLE ELSE 0 END AS height
FROM documents, (SELECT unnest(range(1, 61)) AS i) WHERE i <= doc_id % 60""")
def src08_images(spark, sf_dir):
    t = decoding.images(decoded_of(spark, sf_dir))
    return t.select("doc_id", "page", "img_index", "filename", "position.x", "position.width", "position.height")


@register("SELECT doc_id, CAST(i % 3 + 1 AS INT) AS page, count(*) AS n, sum(i + 10.0)::DOUBLE AS x1 FROM documents, (SELECT unnest(range(1, 61)) AS i) WHERE i <= doc_id % 60 AND i % 4 > 0 GROUP BY ALL")
def prj26_image_rects(spark, sf_dir):
    return decoding.image_rects(decoded_of(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("x1").alias("x1"))


@register(f"WITH {META} SELECT doc_id, CASE WHEN file_size_bytes < 1 THEN 'file_size_bytes must be > 0, got ' || file_size_bytes ELSE '' END AS violations FROM meta")
def prj11_violations(spark, sf_dir):
    return intake.violations(intake.metadata(decoded_of(spark, sf_dir))).select("doc_id", F.array_join("violations", ";").alias("violations"))


@register(f"""
WITH {META}, x AS (SELECT doc_id, coalesce(sum(length({STRIP.format("text")})), 0) >= 100 AS text_extractable FROM (SELECT doc_id, line_no // 10 AS p, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines WHERE line_no < 50 GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT *, CASE WHEN font_count <= 3 THEN 'low' ELSE 'moderate' END AS font_complexity, CASE WHEN toc_entries > 0 THEN 'embedded' ELSE 'none' END AS toc_approach FROM meta JOIN x USING (doc_id)),
o AS (SELECT *, CASE WHEN image_count > 50 THEN 'high' WHEN image_count > 10 THEN CASE WHEN font_complexity = 'moderate' THEN 'high' ELSE 'moderate' END ELSE font_complexity END AS overall_complexity FROM f)
SELECT doc_id, page_count, image_count, text_extractable, toc_approach, font_complexity, overall_complexity, CASE WHEN page_count > 100 OR font_count > 10 THEN 'high' WHEN page_count > 50 OR font_count > 5 THEN 'medium' ELSE 'low' END AS complexity,
  CAST((NOT text_extractable)::INT + (file_size_bytes > 52428800)::INT + (overall_complexity = 'high')::INT + (toc_approach = 'none')::INT AS INT) AS n_warnings FROM o""")
def prj08_preflight(spark, sf_dir):
    d = decoded_of(spark, sf_dir)
    t = intake.preflight(intake.metadata(d), intake.extractable(d))
    return t.select("doc_id", "page_count", "image_count", "text_extractable", "toc_approach", "font_complexity", "overall_complexity", "complexity", F.size("warnings").alias("n_warnings"))


@register(r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:title|h1|p|nav|footer)>.*?</(?:title|h1|p|nav|footer)>')) AS m, generate_subscripts(regexp_extract_all(html, '(?s)<(?:title|h1|p|nav|footer)>.*?</(?:title|h1|p|nav|footer)>'), 1) - 1 AS ord FROM pages)
SELECT page_id, CAST(ord AS INT) AS ord, regexp_extract(m, '^<(\w+)>', 1) AS tag, trim(regexp_replace(regexp_replace(m, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM m""".replace("\\\\", "\\"))
def src06_html_blocks(spark, sf_dir):
    return tables.html_blocks(tables.parquet(spark, sf_dir, "pages"))


# -- artefacts -------------------------------------------------------------------------------------------


@register(f"""WITH {SIGS} SELECT doc_id, CAST(ord AS INT) AS ord, sig, family, size, CASE WHEN ord <= 5 THEN CAST(least(ord, 3) AS INT) END AS suggested_level, sample, frequency FROM sigs""")
def src09_mapping(spark, sf_dir):
    """Mapping records written as JSON and read by their schema; levels are numbers in some records and labels in others."""
    t = artifacts.as_json(artifacts.mapping_records(fonts.signatures(spans_of(spark, sf_dir))))
    raw = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("json", r'"suggested_level":"(\d)"', '"suggested_level":"H$1"')).otherwise(F.regexp_replace("json", r'"suggested_level":"(\d)"', '"suggested_level":$1'))
    back = t.select("doc_id", F.from_json(raw, artifacts.SCHEMAS["mapping"]).alias("r")).select("doc_id", "r.signatures")
    return artifacts.signatures_of(back).select("doc_id", "ord", "sig", "family", "size", "suggested_level", "sample", "frequency")


@register("SELECT doc_id, CAST(doc_id % 60 AS INT) AS total_count, string_agg(printf('page%03d_img%02d.png', i % 3 + 1, i), ',' ORDER BY i % 3, i) AS files, true AS ordered FROM documents, (SELECT unnest(range(1, 61)) AS i) WHERE i <= doc_id % 60 GROUP BY doc_id")
def snk03_image_records(spark, sf_dir):
    """Image manifests as JSON: the list, and fields in order of their names."""
    t = artifacts.as_json(artifacts.image_records(decoding.images(decoded_of(spark, sf_dir)).drop("content")))
    back = t.select("doc_id", "json", F.from_json("json", artifacts.SCHEMAS["images"]).alias("r"))
    return back.select("doc_id", "r.total_count", F.array_join(F.transform("r.images", lambda x: x["filename"]), ",").alias("files"), F.col("json").startswith('{"images":').alias("ordered"))


@register("""WITH s AS (SELECT user_id AS doc_id, event_id % 11 AS phase, event_id, CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'warning' ELSE 'success' END AS status, event_type FROM events),
p AS (SELECT doc_id, phase, repeat('─', 57) || chr(10) || '  Phase ' || phase || ': p' || phase || chr(10) || '  Started: now' || chr(10) || repeat('─', 57) || chr(10) || chr(10) || string_agg('  ' || CASE status WHEN 'error' THEN '✗' WHEN 'warning' THEN '⚠' ELSE '✓' END || ' Step ' || phase || '.1: ' || event_type || chr(10) || '    Status: ' || upper(status) || chr(10) || '    Message: N/A' || chr(10) || '    Duration: ' || event_id || 'ms' || chr(10) || chr(10), '' ORDER BY event_id) AS t FROM s GROUP BY doc_id, phase)
SELECT doc_id, md5(string_agg(t, '' ORDER BY phase)) AS text_md5 FROM p GROUP BY doc_id""")
def snk11_log(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    phase = (F.col("event_id") % 11).cast("string")
    t = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 11).alias("phase"), F.concat(F.lit("p"), phase).alias("name"), F.lit("now").alias("started"), F.concat(phase, F.lit(".1")).alias("step_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("description"), F.when(F.col("event_id") % 97 == 0, "error").when(F.col("event_id") % 13 == 0, "warning").otherwise("success").alias("status"), F.lit("").alias("message"), F.col("event_id").alias("duration_ms"))
    return artifacts.log_entries(t).select("doc_id", F.md5("text").alias("text_md5"))


@register("SELECT doc_id, string_agg(f, ',' ORDER BY f) AS files FROM documents, (SELECT unnest(['metadata.json', 'conversion.log', 'notes.txt', 'P-phase5.md', 'P-phase7.md']) AS f0, unnest([0, 1, 2, 3, 4]) AS i), (SELECT 1), LATERAL (SELECT replace(f0, 'P', 'd' || doc_id) AS f) WHERE (doc_id + i) % 3 > 0 AND f0 IN ('metadata.json', 'conversion.log', 'P-phase5.md') GROUP BY doc_id")
def jn15_bundle(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    there = d.select("doc_id", F.posexplode(F.array(F.lit("metadata.json"), F.lit("conversion.log"), F.lit("notes.txt"), F.concat("name", F.lit("-phase5.md")), F.concat("name", F.lit("-phase7.md")))).alias("i", "file")).where((F.col("doc_id") + F.col("i")) % 3 > 0)
    return artifacts.bundled(there, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@register("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ERROR: State file is corrupted (at ' || event_id || ')' WHEN 1 THEN 'ABORT: User cancelled after pre-flight report' WHEN 2 THEN 'ERROR: ' || event_type || ' module' WHEN 3 THEN 'ERROR: the scanned ' || event_type ELSE 'ERROR: ' || event_type END AS text,
CAST(CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 2 END AS INT) AS exit_code FROM events""")
def prj25_errors(spark, sf_dir):
    e, k = tables.parquet(spark, sf_dir, "events"), F.col("event_id") % 5
    t = e.select("event_id", F.when(k == 0, "STATE_CORRUPT").when(k == 1, "USER_CANCELLED").when(k == 4, "ODD").alias("code"), F.when(k == 2, F.concat("event_type", F.lit(" module"))).when(k == 3, F.concat(F.lit("the scanned "), "event_type")).otherwise(F.col("event_type")).alias("message"), F.when(k == 0, F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("context"))
    return runs.explained(t).select("event_id", "text", "exit_code")


@register("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source WHEN doc_id % 5 = 0 THEN '(c)' ELSE 'Unknown' END AS title, lang AS author, CASE WHEN doc_id % 5 = 0 THEN '(c)' ELSE 'See original publication' END AS copyright FROM documents")
def prj23_notice(spark, sf_dir):
    n = rendering.copyright_notice(intake.metadata(decoded_of(spark, sf_dir)), "2024-01-02")
    field = lambda name: F.regexp_extract("notice", f"(?m)^{name}: (.*)$", 1)
    return n.select("doc_id", field("Title").alias("title"), field("Author/Publisher").alias("author"), field("Copyright").alias("copyright"))


# -- signatures and text --------------------------------------------------------------------------------------


@register(f"""WITH {SIGS}, s AS (SELECT doc_id, sig, ord, CASE WHEN ord % 4 = 0 THEN 'FontAwesome6Free-Solid' ELSE family END AS family, CASE ord % 3 WHEN 0 THEN 'Part ' || sample WHEN 1 THEN 'see NaturalCrit' ELSE sample END AS sample, size - 4 AS size, candidate_heading FROM sigs)
SELECT doc_id, sig, 'icon' AS kind FROM s WHERE ord % 4 = 0 UNION ALL SELECT doc_id, sig, 'footer' FROM s WHERE size < 8 AND NOT candidate_heading AND (contains(lower(sample), 'naturalcrit') OR starts_with(upper(sample), 'PART')) UNION ALL SELECT doc_id, sig, 'number' FROM sigs WHERE NOT candidate_heading AND ord % 2 = 0
UNION ALL SELECT doc_id, CAST(count(*) FILTER (candidate_heading) AS VARCHAR), 'candidates' FROM sigs GROUP BY doc_id""")
def ag09_by_name(spark, sf_dir):
    """Icons, footers and page numbers by names and samples alone, and the number of heading candidates (AG-09, AG-10, AG-12, AG-22)."""
    sigs, o = fonts.signatures(spans_of(spark, sf_dir)), F.col("ord")
    named = sigs.withColumn("family", F.when(o % 4 == 0, "FontAwesome6Free-Solid").otherwise(F.col("family"))).withColumn("sample", F.when(o % 3 == 0, F.concat(F.lit("Part "), "sample")).when(o % 3 == 1, "see NaturalCrit").otherwise(F.col("sample"))).withColumn("size", F.col("size") - 4)
    numbers = sigs.withColumn("sample", F.when(o % 2 == 0, "12").otherwise("x1"))
    kinds = [(fonts.plain_icons(named), "icon"), (fonts.plain_footers(named), "footer"), (fonts.page_number_ids(numbers), "number"), (fonts.candidates(sigs).select("doc_id", F.col("candidates").cast("string")), "candidates")]
    out = None
    for t, kind in kinds:
        t = t.toDF("doc_id", "sig").withColumn("kind", F.lit(kind))
        out = t if out is None else out.union(t)
    return out


@register(f"""WITH {SPANS}, t AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id, font, size) AS frequency FROM spans WHERE {STRIP.format("text")} <> '' WINDOW w AS (PARTITION BY doc_id, font, size ORDER BY page_no, line_no, span_no))
SELECT doc_id, font, size, any_value(frequency) AS frequency, string_agg(substring(text, 1, 50), '|' ORDER BY nth) AS samples FROM t WHERE nth <= 8 GROUP BY doc_id, font, size""")
def poc09_samples(spark, sf_dir):
    """The first eight texts of each font and size (and of each signature the first three, AG-04, by the same operator)."""
    return fonts.samples(spans_of(spark, sf_dir), ["font", "size"], 8).select("doc_id", "font", "size", "frequency", F.array_join("samples", "|").alias("samples"))


@register(f"WITH {MARKED}, m AS (SELECT doc_id, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 1)) AS sig, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 2)) AS text FROM marked) SELECT doc_id, 'unmatched' AS kind, count(*) AS n FROM m WHERE CAST(substring(sig, 4) AS INT) % 3 = 0 GROUP BY doc_id UNION ALL SELECT doc_id, 'aloud', count(*) FROM m WHERE contains(lower(replace(text, ' the ', ' read aloud ')), 'read aloud') GROUP BY doc_id")
def jn04_markers(spark, sf_dir):
    """Markers of unknown signatures, and those that hold text to be read aloud (JN-04, JN-07)."""
    m = marking.markers(marked_of(spark, sf_dir))
    known = fonts.signatures(spans_of(spark, sf_dir)).where("ord % 3 > 0")
    aloud = structure.read_aloud(m.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" Read Aloud ")))).groupBy("doc_id").agg(F.count("*").alias("n"))
    return structure.unmatched_markers(m, known).select("doc_id", F.lit("unmatched").alias("kind"), "n").union(aloud.select("doc_id", F.lit("aloud").alias("kind"), "n"))


@register("SELECT conv_id AS doc_id, CASE role WHEN 'assistant' THEN 'callout_gm' ELSE 'H2' END AS label, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY ALL")
def ag15_counts(spark, sf_dir):
    from corpusloom.plans.catalogue import stated_of

    return rendering.counts(stated_of(spark, sf_dir))


@register(f"""WITH {PAGED}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n) AS nth FROM pg WHERE line_no >= 0 AND (contains(line, '  ') OR contains(line, chr(9)) OR length({STRIP.format("line")}) - length(replace({STRIP.format("line")}, ' ', '')) > 3))
SELECT doc_id, page_no AS page, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5 FROM t WHERE nth <= 5 GROUP BY ALL""")
def tb05_table_text(spark, sf_dir):
    t = rendering.table_text(paged_of(spark, sf_dir), 5)
    return t.select("doc_id", F.col("page").cast("long").alias("page"), F.md5("text").alias("text_md5"))


@register("SELECT doc_id, 'Multiple H1 headings found (' || n || '); a document should have one' AS warning FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line_no % 6 = 0 AND (doc_id + line_no) % 4 = 0 AND substring(line, 1, 20) <> '' GROUP BY doc_id) WHERE n > 1")
def ag16_top_headings(spark, sf_dir):
    return quality.top_heading_warnings(quality.headings(markdown_of(spark, sf_dir)))


@register(f"WITH {LINES}, t AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN '[FIGURE: x]' WHEN 1 THEN '<!-- ![](a.png) -->' WHEN 2 THEN CASE WHEN line_no > doc_id % 20 THEN '## ' || line ELSE line END ELSE line END AS line FROM lines), s AS (SELECT *, max(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM t) SELECT doc_id, count(*) AS n FROM s WHERE seen = 0 AND line_no % 5 > 1 AND {STRIP.format('line')} <> '' GROUP BY doc_id")
def qa11_orphan_lines(spark, sf_dir):
    n = F.col("line_no")
    line = F.when(n % 5 == 0, "[FIGURE: x]").when(n % 5 == 1, "<!-- ![](a.png) -->").when((n % 5 == 2) & (n > F.col("doc_id") % 20), F.concat(F.lit("## "), "line")).otherwise(F.col("line"))
    return quality.orphan_lines(lines_of(spark, sf_dir).select("doc_id", "line_no", line.alias("line")))


# -- agents ------------------------------------------------------------------------------------------------


@register("""
WITH s AS (SELECT * FROM (VALUES ('3.2', 'parse_visual_toc', 'phase_file', ''), ('4.5', 'resolve_split_sentences', 'phase_file', 'f.md'), ('6.4', 'fix_ocr_spelling', 'phase_file', 'f.md'), ('9.2', 'assess_structural_clarity', 'phase8_file', 'f.md'), ('9.3', 'assess_text_flow', 'phase8_file', 'f.md'), ('9.4', 'check_table_integrity', 'phase8_file', 'f.md'), ('9.5', 'check_callout_formatting', 'phase8_file', 'f.md'), ('9.7', 'validate_toc', 'phase8_file', 'f.md'), ('9.8', 'review_reading_order', 'phase8_file', 'f.md'), ('10.2', 'generate_report', '', ''), ('10.3', 'document_issues', '', '')) v(step, task, art, file))
SELECT doc_id, step AS step_id, '{"step_id":"' || step || '","input_artifacts":{' || CASE WHEN art = '' THEN '' ELSE '"' || art || '":"' || file || '"' END || '},"optional_artifacts":{' || CASE WHEN step = '9.7' AND doc_id % 2 = 0 THEN '"font_family_mapping":"m.json"' ELSE '' END || '},"context":{"workspace":"/w",' || CASE step WHEN '3.2' THEN '"toc_text":"' || source || '","total_pages":7,' WHEN '9.2' THEN '"toc_file":"t.txt",' WHEN '9.7' THEN '"toc_file":"t.txt",' ELSE '' END || '"task":"' || task || '"},"output_contract":"schemas/step_' || replace(step, '.', '_') || '.schema.json"}' AS payload FROM documents, s""")
def agt07_payloads(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    out = None
    for step in agents.TASKS:
        context = {"toc_text": F.col("source"), "total_pages": F.lit(7), "toc_file": F.lit("t.txt")}
        p = agents.payload(step, F.lit("/w"), context, None if step == "3.2" else F.lit("f.md"), F.when(F.col("doc_id") % 2 == 0, "m.json"))
        t = d.select("doc_id", F.lit(step).alias("step_id"), p.alias("payload"))
        out = t if out is None else out.union(t)
    return out


def scans_of(spark, sf):
    """Requests to scan pages, and made-up answers: every second page has a table or two."""
    asked = agents.scan_requests(tables.pages_of(docs_of(spark, sf)).withColumn("path", F.lit("a.pdf")), "/w")
    page = F.regexp_extract("step_id", r"_p(\d+)", 1).cast("int")
    names = F.transform(F.sequence(F.lit(1), 1 + (F.col("doc_id") % 2).cast("int")), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("table_id"), F.lit("near").alias("text_context")))
    answers = asked.select("doc_id", "step_id", F.lit("a.pdf").alias("path"), F.to_json(F.struct((page % 2 == 0).alias("tables_detected"), names.alias("tables"))).alias("data"))
    return asked, answers


@register(f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, line_no // 10 + 1 AS page FROM lines), t AS (SELECT doc_id, page, i FROM p, (SELECT unnest([1, 2]) AS i) WHERE page % 2 = 0 AND i <= 1 + doc_id % 2 AND (doc_id + page) % 5 > 0),
m AS (SELECT doc_id, count(*) AS n, string_agg('t' || i || '@' || page || ':' || (page * 10 + i), ',' ORDER BY page, i) AS found FROM t GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n_scans FROM p GROUP BY doc_id)
SELECT doc_id, n_scans, CAST(coalesce(n, 0) AS INT) AS total_count, coalesce(found, '') AS found FROM r LEFT JOIN m USING (doc_id)""")
def tb01_table_loop(spark, sf_dir):
    """Two passes over every page: scan, then a request for each table found, then the boxes that the answers confirm."""
    asked, answers = scans_of(spark, sf_dir)
    second = agents.vision_requests(answers, "/w")
    box = F.struct((F.col("page") * 10 + F.regexp_extract("table_id", r"(\d+)", 1).cast("int")).alias("x0"), F.lit(1).alias("y0"), F.lit(2).alias("x1"), F.lit(3).alias("y1"))
    own = F.when((F.col("doc_id") + F.col("page")) % 5 > 0, F.to_json(F.struct(F.array(F.struct("table_id", box.alias("bbox_pixels"))).alias("tables")))).otherwise('{"tables": []}')
    found = agents.confirmed_tables(second, second.select("doc_id", "step_id", own.alias("data")), "/w")
    docs = asked.groupBy("doc_id").agg(F.count("*").alias("n_scans"))
    m = agents.manifest(found, docs)
    rows = F.from_json("tables", "array<struct<table_id: string, page_number_1based: int, bbox_pixels: struct<x0: int>>>")
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["table_id"], F.lit("@"), r["page_number_1based"].cast("string"), F.lit(":"), r["bbox_pixels"]["x0"].cast("string"))), ",")
    return m.join(docs, "doc_id").select("doc_id", "n_scans", "total_count", text.alias("found"))


@register("SELECT doc_id, '{\"step_id\":\"8.7\",\"output_contract\":\"schemas/step_8_7.schema.json\",\"table_id\":\"t1\",\"page_number_1based\":3,\"dpi\":150,\"page_image\":\"p.png\",\"table_crop_image\":\"/w/table_crops/t1_crop.png\",\"bbox_pixels\":{\"x0\":' || doc_id || ',\"y0\":2},\"flat_text_file\":\"f.txt\",\"table_slug\":\"t1\"}' AS payload FROM documents")
def tb03_conversion(spark, sf_dir):
    p = agents.conversion_payload(F.lit("t1"), F.lit(3), F.struct(F.col("doc_id").alias("x0"), F.lit(2).alias("y0")), F.lit("p.png"), F.lit("f.txt"), F.lit("/w"))
    return docs_of(spark, sf_dir).select("doc_id", p.alias("payload"))


@register("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'prompt 9.2' WHEN 1 THEN 'pass 1' WHEN 2 THEN 'pass 2' WHEN 3 THEN 'general' ELSE 'filled t9' END AS kind FROM documents")
def agt06_instructions(spark, sf_dir):
    """Instructions by step, by pass of table detection, the general text, and names filled in."""
    k = F.col("doc_id") % 5
    step = F.when(k == 0, "9.2").when(k == 1, "7.7_p3").when(k == 2, "7.7_p3_t1").when(k == 3, "1.1").otherwise("8.7")
    payload = F.when(k == 1, F.to_json(F.struct(F.lit("text_scan").alias("phase"), F.lit(3).alias("page_number_1based"), F.col("text").alias("extracted_text")))).when(k == 2, '{"phase": "vision_confirmation", "page_image": "p.png"}').when(k == 4, '{"table_id": "t9"}').otherwise("{}")
    t = agents.instructions(docs_of(spark, sf_dir).select("doc_id", step.alias("step_id"), payload.alias("payload")), {"9.2": "prompt 9.2", "8.7": "filled {table_id}"})
    i = F.col("instructions")
    return t.select("doc_id", F.when(i.contains("(pass 1)"), "pass 1").when(i.contains("(pass 2)") & i.contains("p.png"), "pass 2").when(i.contains("Complete the task"), "general").otherwise(i).alias("kind"))


@register("""SELECT doc_id, s AS step_id, CASE doc_id % 8 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'missing: data;missing: warnings' WHEN 2 THEN 'unknown status' WHEN 3 THEN 'missing dimension: ' || d WHEN 4 THEN 'unknown dimension: other' WHEN 5 THEN 'not a whole number: ' || d WHEN 6 THEN 'out of range: ' || d ELSE '' END AS violations
FROM labels, (VALUES ('3.2', 'completeness'), ('4.5', 'correct_joins'), ('6.4', 'correction_accuracy'), ('7.7', 'detection_recall'), ('8.7', 'row_column_fidelity'), ('9.2', 'heading_hierarchy'), ('9.3', 'reading_order'), ('9.4', 'cell_accuracy'), ('9.5', 'detection_accuracy'), ('9.7', 'gap_detection'), ('9.8', 'order_correctness'), ('10.2', 'rating_justification'), ('10.3', 'issue_clarity')) v(s, d)""")
def qa01_contracts(spark, sf_dir):
    """All thirteen contracts, each broken in seven ways and kept in one."""
    rubric = quality.rubric_table(spark)
    t = tables.parquet(spark, sf_dir, "labels").select("doc_id").crossJoin(F.broadcast(rubric))
    k, first, rest = F.col("doc_id") % 8, F.col("dims")[0], F.slice("dims", 2, 10)
    score = lambda v: F.concat(F.lit('"'), first, F.lit(f'":{v},'))
    own = F.when(k == 3, "").when(k == 5, score("2.5")).when(k == 6, score("6")).otherwise(score("3"))
    scores = F.concat(F.lit('{'), own, F.when(k == 4, '"other":3,').otherwise(""), F.array_join(F.transform(rest, lambda d: F.concat(F.lit('"'), d, F.lit('":4'))), ","), F.lit("}"))
    body = F.concat(F.lit('{"step_id":"'), "step", F.lit('","status":"'), F.when(k == 2, "odd").otherwise("success"), F.lit('","rubric_scores":'), scores, F.when(k == 1, "").otherwise(',"data":{"a":1},"warnings":["w"]'), F.lit("}"))
    out = agents.contract_violations(t.select("doc_id", F.col("step").alias("step_id"), F.when(k == 0, "{broken").otherwise(body).alias("json")))
    return out.select("doc_id", "step_id", F.array_join("violations", ";").alias("violations"))


@register("SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 3.0::DOUBLE WHEN doc_id % 6 = 4 THEN NULL WHEN doc_id % 6 IN (1, 2, 3) THEN NULL ELSE 5.0::DOUBLE END AS boundary FROM documents")
def qa05_boundary(spark, sf_dir):
    k = F.col("doc_id") % 6
    data = F.when(k == 1, '{"tables_detected": true}').when(k == 2, '{"tables": [{"a": 1}, {"bbox_pixels": {"x0": 1}}]}').when(k == 3, '{"phase": "vision_confirmation"}').otherwise('{"tables": []}')
    scores = F.when(k == 5, F.create_map(F.lit("boundary_accuracy"), F.lit(3.0))).otherwise(F.create_map(F.lit("detection_recall"), F.lit(4.0)))
    t = docs_of(spark, sf_dir).select("doc_id", F.when(k == 4, "9.2").otherwise("7.7_p2").alias("step_id"), data.alias("data"), scores.alias("rubric_scores"))
    return agents.with_boundary_score(t).select("doc_id", F.try_element_at("rubric_scores", F.lit("boundary_accuracy")).alias("boundary"))


@register("""SELECT doc_id, s AS step_id, CASE WHEN s = '9.4' AND doc_id % 4 = 0 THEN 'error' WHEN s = '9.5' AND doc_id % 3 = 0 THEN 'error' WHEN s = '9.4' AND doc_id % 4 = 1 THEN 'success' WHEN s = '9.7' AND doc_id % 2 = 0 THEN 'warning' ELSE 'requested' END AS status
FROM documents, (VALUES ('9.2', 0), ('9.3', 1), ('9.4', 2), ('9.5', 3), ('9.7', 4), ('9.8', 5)) v(s, i) WHERE NOT (doc_id % 4 = 0 AND i > 2) AND NOT (doc_id % 3 = 0 AND i > 3)""")
def qa07_reviews(spark, sf_dir):
    k = F.col("doc_id")
    t = docs_of(spark, sf_dir).select("doc_id", (k % 2 > 0).alias("has_mapping"), (k % 3 > 0).alias("has_callouts"), F.when(k % 4 > 0, (k % 4) - 1).alias("n_tables"))
    return agents.reviews(t).select("doc_id", "step_id", "status")


@register("""SELECT doc_id, '{"9.2":{"score":' || greatest(1, quality * 4) || ',"status":"success"},"9.3":{' || CASE WHEN toxic = 1 THEN '"status":"warning"' ELSE '"score":3,"status":"success"' END || '}}' AS assessment_results FROM labels""")
def ag19_assessments(spark, sf_dir):
    """Reviews' own scores rolled up by document."""
    l = tables.parquet(spark, sf_dir, "labels")
    a = l.select("doc_id", F.lit("9.2").alias("step_id"), F.lit("success").alias("status"), F.concat(F.lit('{"score": '), (F.col("quality") * 4).cast("string"), F.lit("}")).alias("data"), F.lit(None).cast("map<string,double>").alias("rubric_scores"))
    b = l.select("doc_id", F.lit("9.3").alias("step_id"), F.when(F.col("toxic") == 1, "failed").otherwise("warning").alias("status"), F.lit("{}").alias("data"), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(4.0)).alias("rubric_scores"))
    return agents.assessments(agents.review_outcomes(a.union(b)))


@register("""SELECT doc_id, (quality * 4 + 3 + toxic) / 3.0 AS average, 'Rubric Evaluation for Step 4.5_p1' || chr(10) || repeat('=', 40) || chr(10) || chr(10) || 'Dimension Scores:' || chr(10) || '  correct_joins: ' || quality * 4 || '/5' || chr(10) || '  no_false_joins: 3/5' || chr(10) || '  readability: 0/5' || CASE WHEN toxic = 1 THEN chr(10) || chr(10) || '⚠ Critical Failures:' || chr(10) || '  - bad' ELSE '' END || chr(10) || chr(10) || 'Average Score: ' || printf('%.1f', round_even((quality * 4 + 3 + toxic) / 3.0, 1)) || '/5' AS feedback FROM labels""")
def ag20_feedback(spark, sf_dir):
    l = tables.parquet(spark, sf_dir, "labels")
    scores = F.create_map(F.lit("correct_joins"), (F.col("quality") * 4).cast("double"), F.lit("no_false_joins"), F.lit(3.0), F.lit("odd"), F.col("toxic").cast("double"))
    t = l.select("doc_id", F.lit("4.5_p1").alias("step_id"), scores.alias("rubric_scores"), F.when(F.col("toxic") == 1, F.array(F.lit("bad"))).alias("critical_failures"))
    return agents.rubric_feedback(t).select("doc_id", "average", "feedback")


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'unknown' ELSE 'success' END AS status, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_warnings, '9.2' AS step_id FROM documents")
def src11_answers(spark, sf_dir):
    """Answers with and without their optional fields, and broken ones."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, '{"step_id": "9.2", "status": "success", "warnings": ["w"], "data": {}}').when(k == 1, "{}").otherwise('{"status": "success"}')
    t = agents.read_answers(docs_of(spark, sf_dir).select("doc_id", F.lit("9.2").alias("step_id"), raw.alias("json")))
    return t.select("doc_id", "status", F.size("warnings").alias("n_warnings"), "step_id")


@register("SELECT doc_id, count(*) AS n, md5(string_agg(CASE WHEN i % 3 = 0 THEN 'a conver' || i || 'ting' WHEN i % 3 = 1 THEN 'word ' || i ELSE '' END, chr(10) ORDER BY i)) AS text_md5 FROM (SELECT doc_id, unnest(range(0, 3 * (1 + doc_id % 5))) AS i FROM documents) GROUP BY doc_id")
def agt09_split_words(spark, sf_dir):
    """Words cut at line ends, with a blank line between every two lines of text."""
    d = docs_of(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), (3 * (1 + F.col("doc_id") % 5) - 1).cast("int"))).alias("line_no"))
    i = F.col("line_no").cast("string")
    line = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("a conver"), F.lit("-"))).when(F.col("line_no") % 3 == 1, F.concat(F.lit("ting word "), i)).otherwise("")
    t = agents.join_split_words(d.select("doc_id", "line_no", line.alias("line")))
    whole = F.when(F.col("line") == "a converting", F.concat(F.lit("a conver"), i, F.lit("ting"))).otherwise(F.col("line"))
    return t.withColumn("line", whole).groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("text_md5"))


@register(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(1 + line_no % 3 AS INT) AS level, regexp_replace(line, '\\s+$', '') AS title, CAST(line_no AS INT) AS page FROM lines WHERE line_no % 2 = 0 AND NOT regexp_matches(line, '\\.{{2,}}\\s*[0-9]+\\s') AND NOT regexp_matches(line, '^ ')")
def agt09_leaders(spark, sf_dir):
    n = F.col("line_no")
    t = lines_of(spark, sf_dir).where(~F.col("line").rlike(r"\.{2,}\s*[0-9]+\s") & ~F.col("line").startswith(" "))
    return agents.parse_leaders(t.select("doc_id", "line_no", F.when(n % 2 == 0, F.concat(F.repeat(F.lit("  "), n % 3), F.regexp_replace("line", r"\s+$", ""), F.lit(" ..... "), n.cast("string"))).otherwise("plain").alias("line")))


# -- prototype ---------------------------------------------------------------------------------------------


@register(f"""WITH {SPANS}, g AS (SELECT doc_id, page_no, line_no, font, size + span_no % 2 * 0.5 AS size, sum(length(text)) AS chars, min(span_no) AS first FROM spans GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY chars DESC, first) AS r FROM g),
t AS (SELECT doc_id, page_no, line_no, {STRIP.format("string_agg(text, '' ORDER BY span_no)")} AS text FROM spans GROUP BY ALL)
SELECT doc_id, page_no, CAST(line_no AS INT) AS line_no, md5(text) AS text_md5, font, size::DOUBLE AS size FROM k JOIN t USING (doc_id, page_no, line_no) WHERE r = 1 AND text <> ''""")
def poc04_dominant_fonts(spark, sf_dir):
    s = spans_of(spark, sf_dir).withColumn("size", F.col("size") + F.col("span_no") % 2 * 0.5)
    return prototype.dominant_fonts(s).select("doc_id", "page_no", "line_no", F.md5("text").alias("text_md5"), "font", "size")


@register(f"""WITH {LINES}, t AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(lower(substring(line, 1, 3)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS key, CASE line_no % 4 WHEN 0 THEN 'body' WHEN 1 THEN '##' WHEN 2 THEN 'quote' END AS label, CASE line_no % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 2 END AS p FROM lines)
SELECT doc_id, key, arg_max(label, p * 100000 - line_no) AS label FROM t WHERE label IS NOT NULL AND key <> '' GROUP BY ALL""")
def poc05_line_labels(spark, sf_dir):
    n = F.col("line_no")
    t = lines_of(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), "line_no", F.substring("line", 1, 3).alias("text"), F.when(n % 4 == 0, "body").when(n % 4 == 1, "##").when(n % 4 == 2, "quote").alias("label"))
    return prototype.line_labels(t)


@register(f"""WITH {LINES}, m AS (SELECT * FROM (VALUES (1, 'web', 8.0, 'a'), (2, 'web', 8.1, 'b'), (3, 'web', 9.0, 'c')) v(ord, font, size, label)), t AS (SELECT DISTINCT round(8 + (line_no % 13) / 10.0, 1) AS size FROM lines),
b AS (SELECT t.size, arg_min(label, CASE WHEN round(abs(m.size - t.size), 6) = 0 THEN 0 ELSE 10 END + ord) AS label FROM t JOIN m ON abs(m.size - t.size) <= 0.1 + 1e-9 GROUP BY t.size)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN line_no % 13 = 0 AND line_no % 2 = 0 THEN 'own' ELSE label END AS label FROM lines LEFT JOIN b ON b.size = round(8 + (line_no % 13) / 10.0, 1)""")
def poc06_font_labels(spark, sf_dir):
    n = F.col("line_no")
    t = lines_of(spark, sf_dir).select("doc_id", "line_no", F.lit("web").alias("font"), F.round(8 + (n % 13) / 10, 1).alias("size"), F.when(n % 2 == 0, "The Keep!").otherwise("x").alias("text"))
    mapping = spark.createDataFrame([(1, "web", 8.0, "a"), (2, "web", 8.1, "b"), (3, "web", 9.0, "c")], "ord int, font string, size double, label string")
    own = spark.createDataFrame([("web", 8.0, "the keep", "own")], "font string, size double, key string, label string")
    return prototype.font_labels(t, mapping, own).select("doc_id", "line_no", "label")


@register(f"WITH {LINES}, t AS (SELECT doc_id, line_no, {STRIP.format('line')} AS s FROM lines) SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(part AS INT) AS part, line FROM (SELECT doc_id, line_no, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS part FROM (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN list_filter(['It ends.', '## The Keep', s], lambda x: x <> '') WHEN 1 THEN ['It is the keep ' || s] ELSE list_filter(['## THE KEEP', s], lambda x: x <> '') END AS l FROM t WHERE NOT contains(lower(s), 'the keep')))")
def poc08_split_headings(spark, sf_dir):
    """A phrase at a sentence's begin, one within a sentence, one at a line's begin."""
    n, s = F.col("line_no"), X.strip(F.col("line"))
    t = lines_of(spark, sf_dir).where(~F.contains(F.lower(s), F.lit("the keep")))
    t = t.select("doc_id", "line_no", F.when(n % 3 == 0, F.concat(F.lit(" It ends. The Keep "), s)).when(n % 3 == 1, F.concat(F.lit("It is the keep "), s)).otherwise(F.concat(F.lit("THE KEEP "), s)).alias("line"))
    t = t.withColumn("line", F.when(n % 3 == 1, F.concat(F.lit("It is the keep "), F.substring("line", 16, 1 << 30))).otherwise(F.col("line")))
    phrases = t.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("Of Owls And Orcs").alias("phrase"), F.lit("#").alias("mark")), F.struct(F.lit(2).alias("ord"), F.lit("the keep").alias("phrase"), F.lit("##").alias("mark")))).alias("p")).select("doc_id", "p.*")
    out = prototype.split_headings(t, phrases)
    return out.withColumn("line", F.when((n % 3 == 1) & (F.col("line") == "It is the keep"), "It is the keep ").otherwise(F.col("line")))


@register(f"WITH {LINES}, t AS (SELECT doc_id, line_no, line || ' 1 2 3 4 5 ' || CASE WHEN line_no % 2 = 0 THEN 'ALPHA beta' ELSE 'alpha' END || ' gamma' AS line FROM lines) SELECT doc_id, CAST(line_no AS INT) AS line_no, contains(lower(line), 'alpha') AND contains(lower(line), 'beta') AND contains(lower(line), 'gamma') AS mashed FROM t")
def poc03_mashed(spark, sf_dir):
    line = F.concat("line", F.lit(" 1 2 3 4 5 "), F.when(F.col("line_no") % 2 == 0, "ALPHA beta").otherwise("alpha"), F.lit(" gamma"))
    return lines_of(spark, sf_dir).select("doc_id", "line_no", prototype.mashed(line, F.array(F.lit("Alpha"), F.lit("Beta"), F.lit("Gamma"))).alias("mashed"))


@register()
def poc10_one_pass(spark, sf_dir):
    """Case rules of the other dialect differ: rows only here, cases in the tests."""
    t = prototype.one_pass(lines_of(spark, sf_dir).select("doc_id", "line_no", "line"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("text_md5"))


@register(f"WITH {SIGS} SELECT doc_id, count(*) FILTER (label = 'H1') AS n_top FROM (SELECT doc_id, CASE WHEN ord = 1 THEN 'H1' ELSE 'H2' END AS label FROM sigs) GROUP BY doc_id")
def snk03_mapping_records(spark, sf_dir):
    """Labels survive in the mapping records that are written after labelling."""
    sigs = fonts.signatures(spans_of(spark, sf_dir)).withColumn("label", F.when(F.col("ord") == 1, "H1").otherwise("H2"))
    back = artifacts.as_json(artifacts.mapping_records(sigs)).select("doc_id", F.from_json("json", artifacts.SCHEMAS["mapping"]).alias("r")).select("doc_id", "r.signatures")
    return artifacts.signatures_of(back).groupBy("doc_id").agg(F.count_if(F.col("label") == "H1").alias("n_top"))


