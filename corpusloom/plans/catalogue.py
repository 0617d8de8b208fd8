"""Registered queries of the document-structuring operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cleaning, fonts, intake, layout, marking, quality, rendering, runs, structure
from corpusloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINES = """lines AS (
  SELECT doc_id, source, lang, i - 1 AS line_no, line FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""
SPANS = f"""{LINES}, spans AS (
  SELECT doc_id, CAST(line_no // 10 AS INT) + 1 AS page_no, CAST(line_no % 10 // 5 AS INT) AS block_no, line_no, k - 1 AS span_no, text,
         source || CASE WHEN (k - 1) % 3 = 2 THEN '-alt' ELSE '' END AS font, CAST(8 + length(line) % 10 AS DOUBLE) AS size, CAST(doc_id % 4 AS INT) AS flags, CAST(line_no % 10 * 80 + 40 AS DOUBLE) AS origin_y
  FROM (SELECT *, unnest(string_split(line, ',')) AS text, generate_subscripts(string_split(line, ','), 1) AS k FROM lines)
), styled AS (
  SELECT *, font AS family, CASE WHEN flags & 1 <> 0 THEN 'bold' ELSE 'normal' END AS weight, CASE WHEN flags & 2 <> 0 THEN 'italic' ELSE 'normal' END AS style FROM spans
)"""
SIGS = f"""{SPANS}, sig0 AS (
  SELECT doc_id, family, size, weight, style, count(*) AS frequency, min(page_no * 100000000 + line_no * 10000 + span_no) AS first,
         arg_min(substring(text, 1, 50), page_no * 100000000 + line_no * 10000 + span_no) AS sample
  FROM styled WHERE page_no <= 5 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL
), sigs AS (
  SELECT *, printf('sig%03d', ord) AS sig, ord <= 5 AS candidate_heading, CASE WHEN ord <= 5 THEN least(ord, 3) END AS suggested_level
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, first) AS ord FROM sig0)
)"""
UPPER = "(regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '[\\p{{Ll}}\\p{{Lt}}ªº]'))"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NORM = "regexp_replace(lower(regexp_replace({0}, '\\s+', ' ', 'g')), '^[ .:\\-\\t\\r\\n]+|[ .:\\-\\t\\r\\n]+$', '', 'g')"
MARKED = f"""{SIGS}, sp AS (
  SELECT s.doc_id, s.page_no, s.line_no, s.span_no, s.text, g.sig FROM styled s LEFT JOIN sigs g USING (doc_id, family, size, weight, style) WHERE s.text <> ''
), lagged AS (
  SELECT *, coalesce(sig = lag(sig) OVER w, false) AS same, lag(text) OVER w AS before FROM sp WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY span_no)
), numbered AS (
  SELECT *, CASE WHEN same AND regexp_matches(before, '\\S$') AND regexp_matches(text, '^\\S') THEN ' ' || text ELSE text END AS part,
         sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY span_no) AS run FROM lagged
), runs AS (
  SELECT doc_id, page_no, line_no, run, sig, string_agg(part, '' ORDER BY span_no) AS text FROM numbered GROUP BY ALL
), marked AS (
  SELECT doc_id, page_no, line_no, string_agg(CASE WHEN sig IS NULL THEN CASE WHEN run > 1 AND regexp_matches(text, '^\\S') THEN ' ' || text ELSE text END
         ELSE '«' || sig || ':' || replace(replace(replace(text, '&', '&amp;'), '«', '&laquo;'), '»', '&raquo;') || '»' END, '' ORDER BY run) AS line FROM runs GROUP BY ALL
)"""
TOC = "toc AS (SELECT doc_id, line_no AS ord, 1 + line_no % 3 AS level, line AS title FROM lines WHERE line_no % 4 = 0 AND length(line) BETWEEN 3 AND 60)"


def register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle.strip()
        return f

    return add


def docs_of(spark, sf):
    return tables.parquet(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def lines_of(spark, sf):
    return tables.lines_of(docs_of(spark, sf))


def spans_of(spark, sf):
    return tables.spans_of_text(docs_of(spark, sf))


def marked_of(spark, sf):
    spans = spans_of(spark, sf)
    return marking.marked_lines(marking.runs(fonts.with_signature(spans, fonts.signatures(spans))))


def toc_of(spark, sf):
    t = lines_of(spark, sf).where((F.col("line_no") % 4 == 0) & F.length("line").between(3, 60))
    return t.select("doc_id", F.col("line_no").alias("ord"), (1 + F.col("line_no") % 3).alias("level"), F.col("line").alias("title"))


# -- flagship and paragraphs ------------------------------------------------------------------------

PARAGRAPHS = f"""{LINES}, p AS (
  SELECT *, {STRIP.format("line")} AS s FROM lines
), q AS (
  SELECT *, (s <> '' AND NOT starts_with(s, '<!--') AND NOT starts_with(s, '#') AND NOT starts_with(s, '«') AND NOT {UPPER.format("s")}) AS plain FROM p
), r AS (
  SELECT *, coalesce(lag(plain) OVER w, false) AS before FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), i AS (
  SELECT *, sum(CASE WHEN plain AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM r
), merged AS (
  SELECT doc_id, island, min(line_no) AS line_no, string_agg(CASE WHEN plain THEN s ELSE line END, ' ' ORDER BY line_no) AS line FROM i GROUP BY doc_id, island
)"""
TITLE = "(regexp_matches({0}, '^\\p{{Lu}}') AND len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: NOT (list_contains(['a','an','the','in','on','of','for','with','and','but','or'], lower(w)) OR regexp_matches(w, '^\\p{{Lu}}')))) = 0)"


@register(f"""
WITH {PARAGRAPHS}, k AS (SELECT m.doc_id, {STRIP.format("m.line")} AS s FROM merged m)
SELECT lang, count(*) FILTER (s <> '') AS n_parts,
  count(*) FILTER (length(s) <= 80 AND NOT regexp_matches(s, '[.,;:!?]$') AND (({UPPER.format("s")} AND length(s) > 3) OR {TITLE.format("s")})) AS n_headings
FROM k JOIN documents d USING (doc_id) GROUP BY lang""")
def flagship_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are dealt out by document before they are taken apart, and the language rides along.
    docs = docs_of(spark, sf_dir).select("doc_id", "text", "lang").repartition("doc_id")
    kinds = structure.heading_candidates(cleaning.merge_paragraphs(tables.lines_of(docs), ("lang",)))
    return kinds.groupBy("lang").agg(F.count_if(F.col("kind") != "blank").alias("n_parts"), F.count_if(F.col("kind") == "heading").alias("n_headings"))


@register(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM merged GROUP BY doc_id")
def rw07_paragraph_merge(spark, sf_dir):
    docs = docs_of(spark, sf_dir).select("doc_id", "text").repartition("doc_id")
    merged = cleaning.merge_paragraphs(tables.lines_of(docs))
    return merged.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("text_md5"))


# -- sources ------------------------------------------------------------------------------------------


@register(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, '|' ORDER BY line_no)) AS lines_md5 FROM lines GROUP BY doc_id")
def src04_lines(spark, sf_dir):
    return lines_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.expr("listagg(line, '|') WITHIN GROUP (ORDER BY line_no)")).alias("lines_md5"))


@register(f"WITH {SPANS} SELECT doc_id, page_no, block_no, count(*) AS n_spans, count(DISTINCT font) AS n_fonts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM spans GROUP BY ALL")
def src06_blocks(spark, sf_dir):
    return spans_of(spark, sf_dir).groupBy("doc_id", "page_no", "block_no").agg(F.count("*").alias("n_spans"), F.count_distinct("font").alias("n_fonts"), F.sum(F.length("text")).alias("n_chars"))


@register(f"WITH {LINES}, {TOC} SELECT doc_id, CAST(ord AS INT) AS line_no, CAST(level AS INT) AS level, {STRIP.format('title')} AS title, CAST(ord + 1 AS INT) AS page FROM toc")
def src10_toc_parse(spark, sf_dir):
    toc = toc_of(spark, sf_dir).withColumn("title", X.strip(F.col("title")))
    written = toc.select("doc_id", F.col("ord").alias("line_no"), F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "title", F.lit(" (page "), (F.col("ord") + 1).cast("string"), F.lit(")")).alias("line"))
    return tables.parse_toc(written)


@register(f"WITH {LINES}, {TOC}, e AS (SELECT DISTINCT doc_id FROM toc), v AS (SELECT DISTINCT doc_id FROM lines WHERE line_no >= 3) SELECT d.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'embedded' WHEN v.doc_id IS NOT NULL THEN 'visual' ELSE 'none' END AS source FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN v USING (doc_id)")
def src13_toc_source(spark, sf_dir):
    return tables.toc_source(toc_of(spark, sf_dir), lines_of(spark, sf_dir).where("line_no >= 3"), docs_of(spark, sf_dir))


@register(f"WITH {LINES}, {TOC} SELECT doc_id, md5('# Table of contents' || chr(10) || '# Source: embedded' || chr(10) || '#' || chr(10) || string_agg(repeat('  ', CAST(level - 1 AS BIGINT)) || title || ' (page ' || (ord + 1) || ')', chr(10) ORDER BY ord)) AS text_md5 FROM toc GROUP BY doc_id")
def snk04_toc_text(spark, sf_dir):
    return tables.toc_text(toc_of(spark, sf_dir).withColumn("page", F.col("ord") + 1)).select("doc_id", F.md5("text").alias("text_md5"))


@register("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_p, regexp_matches(html, '<footer>') AS has_footer FROM pages")
def src05_html(spark, sf_dir):
    p = tables.parquet(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_p"), F.contains("html", F.lit("<footer>")).alias("has_footer"))


# -- projections --------------------------------------------------------------------------------------


@register("SELECT event_id, try_strptime(CASE WHEN event_id % 7 = 0 THEN '99999999' WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d') || '000000' ELSE strftime(ts, '%Y%m%d%H%M%S') END, '%Y%m%d%H%M%S') AS at FROM events")
def prj02_pdf_date(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "D:99999999").when(F.col("event_id") % 3 == 0, F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMdd"))).otherwise(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+02'00'")))
    return e.select("event_id", X.pdf_date(raw).cast("timestamp_ntz").alias("at"))


@register("SELECT doc_id, source AS family, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', round_even(n_chars / 1024.0, 1)) WHEN n_chars < 1073741824 THEN printf('%.1f MB', round_even(n_chars / 1048576.0, 1)) WHEN n_chars < 1099511627776 THEN printf('%.1f GB', round_even(n_chars / 1073741824.0, 1)) WHEN n_chars IS NOT NULL THEN printf('%.1f TB', round_even(n_chars / 1099511627776.0, 1)) END AS size, translate(source || ':' || lang || '?', '<>:\"|?*', '_______') AS filename, n_chars // 4 AS tokens FROM documents")
def prj03_scalars(spark, sf_dir):
    d = tables.parquet(spark, sf_dir, "documents")
    font = F.concat(F.lit("ABCDEF+"), F.initcap("source"), F.lit("-Bold Italic"))
    return d.select("doc_id", X.font_family(font).alias("family"), X.file_size(F.col("n_chars")).alias("size"), X.safe_filename(F.concat("source", F.lit(":"), "lang", F.lit("?"))).alias("filename"), F.floor(F.col("n_chars") / 4).alias("tokens"))


@register(f"""
WITH {SPANS}, m AS (SELECT doc_id, max(page_no) AS pages, count(DISTINCT font) + doc_id % 10 AS fonts, doc_id % 70 AS images, max(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) AS wide FROM spans GROUP BY doc_id)
SELECT doc_id, pages, fonts, CASE WHEN fonts <= 3 THEN 'low' WHEN fonts <= 8 THEN 'moderate' ELSE 'high' END AS font_complexity,
  CASE WHEN pages > 100 OR fonts > 10 THEN 'high' WHEN pages > 50 OR fonts > 5 THEN 'medium' ELSE 'low' END AS complexity,
  CASE WHEN fonts > 8 OR images > 50 THEN 'high' WHEN images > 10 THEN CASE WHEN fonts > 3 THEN 'high' ELSE 'moderate' END WHEN wide = 1 THEN 'high' WHEN doc_id % 3 = 0 THEN CASE WHEN fonts <= 3 THEN 'moderate' ELSE 'high' END WHEN fonts <= 3 THEN 'low' ELSE 'moderate' END AS overall
FROM m""")
def prj05_complexity(spark, sf_dir):
    m = spans_of(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("pages"), (F.count_distinct("font") + F.col("doc_id") % 10).alias("fonts"), F.max(F.length("text") > 200).alias("wide"))
    n = F.col("fonts")
    return m.select("doc_id", "pages", "fonts", X.font_complexity(n).alias("font_complexity"), X.quick_complexity(F.col("pages"), n).alias("complexity"), X.complexity(n, F.col("doc_id") % 70, F.col("wide"), F.col("doc_id") % 3 == 0).alias("overall"))


@register(f"""
WITH {LINES}, p AS (SELECT doc_id, line_no // 10 + 1 AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL),
x AS (SELECT doc_id, coalesce(sum(length({STRIP.format("text")})) FILTER (page_no <= 5), 0) >= 100 AS text_extractable FROM p GROUP BY doc_id)
SELECT doc_id, text_extractable, CAST((NOT text_extractable)::INT + (doc_id % 7 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 3 = 0)::INT AS INT) AS n_warnings,
  concat_ws('|', CASE WHEN NOT text_extractable THEN 'Scanned' END, CASE WHEN doc_id % 7 = 0 THEN 'Very' END, CASE WHEN doc_id % 5 = 0 THEN 'Complex' END, CASE WHEN doc_id % 3 = 0 THEN 'No' END) AS first_words FROM x""")
def prj10_extractable(spark, sf_dir):
    x = intake.extractable_pages(tables.pages_of(docs_of(spark, sf_dir)))
    k = F.col("doc_id")
    w = intake.warnings(F.col("text_extractable"), F.when(k % 7 == 0, 60 << 20).otherwise(50 << 20), F.when(k % 5 == 0, "high").otherwise("low"), F.when(k % 3 == 0, "none").otherwise("embedded"))
    return x.withColumn("w", w).select("doc_id", "text_extractable", F.size("w").alias("n_warnings"), F.array_join(F.transform("w", lambda m: F.split(m, " ")[0]), "|").alias("first_words"))


@register(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, {NORM.format('line')} AS norm FROM lines")
def prj18_norm_heading(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", X.norm_heading(F.col("line")).alias("norm"))


@register("SELECT doc_id, n // 4 AS tokens, CASE WHEN n // 4 > 2000 THEN CASE doc_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'proceed' ELSE 'auto' END ELSE 'proceed' END AS choice, n // 4 // 800 AS pages FROM (SELECT doc_id, length(text) AS n FROM documents)")
def prj21_tokens(spark, sf_dir):
    n = X.token_estimate(F.col("text"))
    answer = F.when(F.col("doc_id") % 3 == 0, "skip").when(F.col("doc_id") % 3 == 1, "proceed")
    return docs_of(spark, sf_dir).select("doc_id", n.alias("tokens"), X.token_choice(n, 2000, answer).alias("choice"), F.floor(n / 800).alias("pages"))


@register("SELECT doc_id, greatest(1, least(5, CAST(round_even(coalesce(CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 9 AS DOUBLE) END, (quality * 4 + toxic) / 2.0), 0) AS INT))) AS score FROM labels")
def prj22_rating(spark, sf_dir):
    t = tables.parquet(spark, sf_dir, "labels")
    rubric = F.create_map(F.lit("a"), (F.col("quality") * 4).cast("double"), F.lit("b"), F.col("toxic").cast("double"))
    return t.select("doc_id", X.rating(F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 9).cast("double")), rubric).alias("score"))


@register("SELECT event_id, CASE WHEN event_id >= 3600 THEN event_id // 3600 || 'h ' || event_id % 3600 // 60 || 'm ' || event_id % 60 || 's' WHEN event_id >= 60 THEN event_id // 60 || 'm ' || event_id % 60 || 's' ELSE event_id || 's' END AS text FROM events")
def prj24_duration(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "events").select("event_id", X.duration(F.col("event_id")).alias("text"))


# -- signatures ----------------------------------------------------------------------------------------


@register(f"WITH {SIGS} SELECT doc_id, sig, CAST(ord AS INT) AS ord, family, size, weight, style, frequency, sample, candidate_heading, CAST(suggested_level AS INT) AS suggested_level FROM sigs")
def wn02_signatures(spark, sf_dir):
    return fonts.signatures(spans_of(spark, sf_dir))


@register(f"""
WITH {SIGS}, dims AS (SELECT doc_id, family, size, min(ord) AS at, arg_max(sig, ord) AS sig FROM sigs GROUP BY ALL)
SELECT s.doc_id, s.page_no, CAST(s.line_no AS INT) AS line_no, CAST(s.span_no AS INT) AS span_no, arg_min(d.sig, d.at) AS sig FROM styled s JOIN dims d ON s.doc_id = d.doc_id AND s.family = d.family AND abs(s.size + 0.3 - d.size) < 0.5 GROUP BY ALL""")
def jn02_tolerance_match(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    return fonts.tolerant(spans.withColumn("size", F.col("size") + 0.3), fonts.signatures(spans)).select("doc_id", "page_no", "line_no", "span_no", "sig")


@register("""
WITH t AS (
  SELECT doc_id, page, kind, CASE kind WHEN 'w' THEN 'DRAFT' WHEN 'n' THEN CAST(page AS VARCHAR) WHEN 'f' THEN source || page % 2 ELSE 'x' || page END AS text,
         CASE kind WHEN 'n' THEN 780.0 WHEN 'f' THEN 770.0 ELSE 300.0 END AS y, CASE kind WHEN 's' THEN 7.5 ELSE 12.0 END AS size
  FROM documents, (SELECT unnest(range(1, 5)) AS page), (SELECT unnest(['w', 'n', 'f', 's']) AS kind)
)
SELECT DISTINCT doc_id, kind AS sig, CASE kind WHEN 'w' THEN 'watermark' WHEN 'n' THEN 'page_number' ELSE 'footer' END AS category, CASE kind WHEN 'f' THEN 'medium' WHEN 's' THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN kind IN ('n', 'f') THEN 'bottom' ELSE 'mixed' END AS position, CAST(4 AS BIGINT) AS cnt FROM t""")
def ag07_footer_classes(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page_no"))
    d = d.withColumn("sig", F.explode(F.array(*[F.lit(x) for x in "wnfs"]))).withColumn("line_no", F.lit(0)).withColumn("span_no", F.lit(0))
    k = F.col("sig")
    d = d.withColumn("text", F.when(k == "w", "DRAFT").when(k == "n", F.col("page_no").cast("string")).when(k == "f", F.concat("source", (F.col("page_no") % 2).cast("string"))).otherwise(F.concat(F.lit("x"), F.col("page_no").cast("string"))))
    d = d.withColumn("origin_y", F.when(k == "n", 780.0).when(k == "f", 770.0).otherwise(300.0)).withColumn("size", F.when(k == "s", 7.5).otherwise(12.0))
    return fonts.footer_classes(d, d.groupBy("doc_id").agg(F.lit(4).alias("pages")))


@register(f"""
WITH {SPANS}, g AS (SELECT doc_id, lower(CASE WHEN doc_id % 20 = 0 THEN 'FontAwesome' ELSE font END) AS family, bool_or(doc_id % 30 = 1 AND line_no = 0) AS private, avg(length({STRIP.format("text")}) + CASE WHEN doc_id % 30 = 1 AND line_no = 0 THEN 1 ELSE 0 END) AS mean_length, count(*) AS n_spans FROM spans WHERE {STRIP.format("text")} <> '' GROUP BY ALL)
SELECT doc_id, family, CASE WHEN family = 'fontawesome' OR private THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN family = 'fontawesome' THEN 'name' WHEN private THEN 'private_use' ELSE 'short_text' END AS reason, n_spans
FROM g WHERE family = 'fontawesome' OR private OR mean_length <= 2""")
def ag08_icon_classes(spark, sf_dir):
    s = spans_of(spark, sf_dir).withColumn("font", F.when(F.col("doc_id") % 20 == 0, "FontAwesome").otherwise(F.col("font")))
    keep = X.strip(F.col("text")) != ""
    s = s.where(keep).withColumn("text", F.when((F.col("doc_id") % 30 == 1) & (F.col("line_no") == 0), F.concat(X.strip(F.col("text")), F.lit(chr(0xE000)))).otherwise(F.col("text")))
    return fonts.icon_classes(s)


@register(f"""
WITH {SIGS}, g AS (SELECT doc_id, size, count(*) AS n, min(ord) AS ord FROM sigs WHERE size BETWEEN 8 AND 12 GROUP BY ALL), b AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS k FROM g)
SELECT s.doc_id, coalesce(b.size, 10.0) AS body_size FROM (SELECT DISTINCT doc_id FROM sigs) s LEFT JOIN b ON b.doc_id = s.doc_id AND k = 1""")
def ag13_body_size(spark, sf_dir):
    return fonts.body_size(fonts.signatures(spans_of(spark, sf_dir)))


@register(f"""
WITH {SIGS}, w AS (SELECT unnest(regexp_split_to_array(sample, '\\s+')) AS w FROM sigs)
SELECT DISTINCT upper(replace(t, 'ß', 'SS')) AS term FROM (SELECT regexp_replace(w, '^[.,;:!?()\\[\\]{{}}]+|[.,;:!?()\\[\\]{{}}]+$', '', 'g') AS t FROM w) WHERE regexp_matches(upper(replace(t, 'ß', 'SS')), '^\\p{{L}}{{2,}}$') UNION SELECT unnest(['AC','HP','DC','STR','DEX','CON','INT','WIS','CHA','THAC0','XP','GP','SP','CP','PP','EP','DM','GM','PC','NPC','BBEG'])""")
def ag21_domain_terms(spark, sf_dir):
    return structure.domain_terms(fonts.signatures(spans_of(spark, sf_dir)))


# -- marking -------------------------------------------------------------------------------------------


@register(f"WITH {SPANS}, g AS (SELECT doc_id, max(page_no) AS n FROM spans GROUP BY doc_id), s AS (SELECT doc_id, n, unnest(range(0, n, 3)) AS start FROM g) SELECT doc_id, CAST(start // 3 AS INT) AS chunk, CAST(start + 1 AS INT) AS first_page, CAST(least(start + 3, n) AS INT) AS last_page FROM s")
def txt01_chunks(spark, sf_dir):
    return marking.chunks(spans_of(spark, sf_dir).select("doc_id", "page_no"), 3)


@register(f"WITH {MARKED} SELECT doc_id, page_no, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS marked_md5 FROM marked GROUP BY ALL")
def txt03_runs(spark, sf_dir):
    return marked_of(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.md5(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("marked_md5"))


@register(f"""
WITH {MARKED}, p AS (SELECT doc_id, page_no, chr(10) || '<!-- Page ' || page_no || ' -->' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS body FROM marked GROUP BY doc_id, page_no)
SELECT doc_id, md5(string_agg(body, '' ORDER BY page_no)) AS text_md5 FROM p GROUP BY doc_id""")
def txt06_page_merge(spark, sf_dir):
    return marking.merged(marked_of(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@register(f"WITH {LINES} SELECT doc_id, line_no // 10 + 1 AS page_no, CAST(line_no AS INT) AS line_no, 'hyphen' AS type, right(regexp_replace(line || CASE WHEN line_no % 5 = 0 THEN '- ' ELSE '' END, '\\s+$', ''), 20) AS text FROM lines WHERE line_no % 5 = 0 OR regexp_matches(line, '-\\s*$')")
def txt07_boundaries(spark, sf_dir):
    t = lines_of(spark, sf_dir).withColumn("line", F.concat("line", F.when(F.col("line_no") % 5 == 0, "- ").otherwise(""))).withColumn("page_no", F.floor(F.col("line_no") / 10) + 1)
    return marking.boundaries(t)


@register(f"WITH {MARKED}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 1)) AS sig, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 2)) AS text FROM marked) SELECT doc_id, sig, count(*) AS n, CAST(sum(length(replace(replace(replace(text, '&raquo;', '»'), '&laquo;', '«'), '&amp;', '&'))) AS BIGINT) AS n_chars FROM m GROUP BY ALL")
def hd01_markers(spark, sf_dir):
    return marking.markers(marked_of(spark, sf_dir)).groupBy("doc_id", "sig").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# -- cleaning ------------------------------------------------------------------------------------------

DIRTY = "replace(replace(text, ', ', ' , '), ' de ', '  —  ( de ) … ')"


def dirty(c):
    return F.replace(F.replace(c, F.lit(", "), F.lit(" , ")), F.lit(" de "), F.lit("  —  ( de ) … "))


@register()
def rw01_wrap(spark, sf_dir):
    """Look-around isn't in the other dialect: rows only here, cases in the tests."""
    t = lines_of(spark, sf_dir).withColumn("line", F.replace("line", F.lit(" the "), F.lit(" <i>the</i> {x} \\note: ")))
    return t.select("doc_id", "line_no", F.md5(cleaning.wrap_marked(F.col("line"))).alias("line_md5"))


@register(f"""
WITH {MARKED}, keep AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM sigs s WHERE s.doc_id = r.doc_id AND s.sig = r.sig AND s.ord % 3 = 0) AND sig IS NOT NULL)
SELECT doc_id, count(*) AS n_runs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM keep GROUP BY doc_id""")
def rw03_remove_signatures(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    sigs = fonts.signatures(spans)
    found = marking.runs(fonts.with_signature(spans, sigs)).where("sig is not null")
    return cleaning.drop_signatures(found, sigs.where("ord % 3 = 0")).groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))


@register(f"WITH {LINES}, m AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 1 THEN '«sig001:  »' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE '«sig002:' || line_no || '»' END WHEN 3 THEN 'page ' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '«sig002:' || line_no || '»' END || '«sig003:' || line_no || '»' ELSE line END AS line FROM lines) SELECT doc_id, count(*) AS n, md5(string_agg(line, '|' ORDER BY line_no)) AS lines_md5 FROM m WHERE line <> '«sig001:  »' AND NOT (line = '' AND line_no % 4 = 2) GROUP BY doc_id")
def rw05_blank_markers(spark, sf_dir):
    """Blank markers, and page numbers in half of the documents, in lines of their own and within others."""
    n, number = F.col("line_no") % 4, F.concat(F.lit("«sig002:"), F.col("line_no").cast("string"), F.lit("»"))
    inner = F.concat(F.lit("page "), number, F.lit("«sig003:"), F.col("line_no").cast("string"), F.lit("»"))
    t = lines_of(spark, sf_dir).select("doc_id", "line_no", F.when(n == 1, "«sig001:  »").when(n == 2, number).when(n == 3, inner).otherwise(F.col("line")).alias("line"))
    pages = t.where("doc_id % 2 = 0").select("doc_id", F.lit("sig002").alias("sig")).distinct()
    return cleaning.drop_page_numbers(cleaning.drop_blank_markers(t), pages).groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.expr("listagg(line, '|') WITHIN GROUP (ORDER BY line_no)")).alias("lines_md5"))


@register(f"WITH {LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 > 0 THEN ' ' ELSE line END AS line FROM lines), b AS (SELECT *, trim(line) = '' AS blank, coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS was FROM m) SELECT doc_id, count(*) AS n, md5(string_agg(line, '|' ORDER BY line_no)) AS lines_md5 FROM b WHERE NOT (blank AND was) GROUP BY doc_id")
def rw06_squeeze(spark, sf_dir):
    t = lines_of(spark, sf_dir).select("doc_id", "line_no", F.when(F.col("line_no") % 3 > 0, " ").otherwise(F.col("line")).alias("line"))
    return cleaning.squeeze_lines(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.expr("listagg(line, '|') WITHIN GROUP (ORDER BY line_no)")).alias("lines_md5"))


@register(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({DIRTY}, ' {{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g'), '([\\[(]) +', '\\1', 'g'), ' +([\\])])', '\\1', 'g')) AS text_md5 FROM documents")
def rw08_spacing(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.md5(X.fix_spacing(dirty(F.col("text")))).alias("text_md5"))


@register(f"SELECT doc_id, md5(replace(replace(replace({DIRTY}, '—', '--'), '–', '-'), '…', '...')) AS text_md5 FROM documents")
def rw09_typography(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.md5(X.fix_typography(dirty(F.col("text")))).alias("text_md5"))


@register("SELECT doc_id, md5(regexp_replace(replace(replace(text, 'in ', 'in-' || chr(10)), 'er', 'e' || chr(173) || 'r'), '([a-z0-9_])-\\n([a-z0-9_])', '\\1\\2', 'g')) AS text_md5 FROM (SELECT doc_id, replace(regexp_replace(lower(text), '[^a-z \\n]', '', 'g'), chr(173), '') AS text FROM documents)".replace("'e' || chr(173) || 'r'", "'er'"))
def rw10_hyphens(spark, sf_dir):
    low = F.regexp_replace(F.lower("text"), "[^a-z \\n]", "")
    t = F.replace(F.replace(low, F.lit("in "), F.lit("in-\n")), F.lit("er"), F.lit("e­r"))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(X.join_hyphens(t)).alias("text_md5"))


@register(f"WITH {LINES} SELECT doc_id, count(*) FILTER (starts_with(x, '- ')) AS n, md5(string_agg(x, '|' ORDER BY line_no)) AS lines_md5 FROM (SELECT doc_id, line_no, regexp_replace(regexp_replace(CASE line_no % 3 WHEN 0 THEN '  • ' WHEN 1 THEN ' *  ' ELSE '' END || line, '^\\s*[•·]\\s+', '- '), '^\\s*[-*]\\s+', '- ') AS x FROM lines) GROUP BY doc_id")
def rw12_bullets(spark, sf_dir):
    n = F.col("line_no") % 3
    t = lines_of(spark, sf_dir).withColumn("x", X.normalise_bullet(F.concat(F.when(n == 0, "  • ").when(n == 1, " *  ").otherwise(""), "line")))
    return t.groupBy("doc_id").agg(F.count_if(F.startswith("x", F.lit("- "))).alias("n"), F.md5(F.expr("listagg(x, '|') WITHIN GROUP (ORDER BY line_no)")).alias("lines_md5"))


@register(f"""
WITH {LINES}, f AS (SELECT doc_id, line_no // 10 + 1 AS page_no, line_no, CASE WHEN line_no % 10 = 0 THEN 'Running head' ELSE line END AS line FROM lines WHERE {STRIP.format("CASE WHEN line_no % 10 = 0 THEN 'Running head' ELSE line END")} <> ''),
e AS (SELECT doc_id, page_no, arg_min(line, line_no) AS a, arg_max(line, line_no) AS b FROM f GROUP BY ALL), n AS (SELECT doc_id, count(*) AS pages FROM e GROUP BY doc_id),
u AS (SELECT doc_id, page_no, a AS line FROM e UNION SELECT doc_id, page_no, b FROM e), c AS (SELECT doc_id, line, count(*) AS n_pages FROM u GROUP BY ALL)
SELECT doc_id, line, n_pages FROM c JOIN n USING (doc_id) WHERE pages > 1 AND n_pages >= 0.5 * pages""")
def poc01_repeated_edges(spark, sf_dir):
    t = lines_of(spark, sf_dir).select("doc_id", (F.floor(F.col("line_no") / 10) + 1).alias("page_no"), "line_no", F.when(F.col("line_no") % 10 == 0, "Running head").otherwise(F.col("line")).alias("line"))
    return cleaning.repeated_edges(t)


# -- structure -----------------------------------------------------------------------------------------


@register(f"WITH {LINES}, s AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 AND regexp_matches(line, '^[a-zA-Z ,.]+$') THEN upper(line) ELSE line END AS s FROM lines) SELECT doc_id, count(*) FILTER ({UPPER.format('s')} AND length(s) > 3) AS n_caps, count(*) FILTER ({TITLE.format(STRIP.format('s'))}) AS n_title FROM s GROUP BY doc_id")
def hd03_caps_and_titles(spark, sf_dir):
    t = lines_of(spark, sf_dir).withColumn("s", F.when((F.col("line_no") % 5 == 0) & F.col("line").rlike("^[a-zA-Z ,.]+$"), F.upper("line")).otherwise(F.col("line")))
    return t.groupBy("doc_id").agg(F.count_if(X.is_all_caps(F.col("s"))).alias("n_caps"), F.count_if(X.is_title_case(F.col("s"))).alias("n_title"))


@register(f"""
WITH {MARKED}, {TOC}, m AS (SELECT doc_id, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 1)) AS sig, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 2)) AS text FROM marked),
t AS (SELECT doc_id, {NORM.format("title")} AS key, min(level) AS level FROM toc GROUP BY ALL)
SELECT doc_id, sig, min(level) AS toc_level FROM (SELECT doc_id, sig, {NORM.format("replace(replace(replace(text, '&raquo;', '»'), '&laquo;', '«'), '&amp;', '&')")} AS key FROM m) JOIN t USING (doc_id, key) WHERE key <> '' GROUP BY ALL""")
def jn03_toc_levels(spark, sf_dir):
    return structure.toc_levels(marking.markers(marked_of(spark, sf_dir)), toc_of(spark, sf_dir)).select("doc_id", "sig", F.col("toc_level").cast("long").alias("toc_level"))


@register(f"""
WITH {LINES}, c AS (SELECT doc_id + 1 AS doc_id, line_no // 3 AS ord, CASE WHEN line_no % 2 = 0 THEN 'box' ELSE 'aside' END AS label, {STRIP.format("line")} AS key FROM lines WHERE {STRIP.format("line")} <> ''),
k AS (SELECT doc_id, key, arg_min(label, ord * 10 + CASE WHEN label = 'box' THEN 0 ELSE 1 END) AS label FROM c GROUP BY ALL)
SELECT l.doc_id, CAST(l.line_no AS INT) AS line_no, k.label FROM (SELECT doc_id + line_no % 2 AS doc_id, line_no, line FROM lines) l JOIN k ON k.doc_id = l.doc_id AND k.key = {STRIP.format("l.line")}""")
def jn05_callout_members(spark, sf_dir):
    """Captured texts of a document are looked for in that document alone: here in the next one, where every second line moved to."""
    t = lines_of(spark, sf_dir)
    m = t.select((F.col("doc_id") + F.col("line_no") % 2).alias("doc_id"), "line_no", F.col("line").alias("text"))
    label = F.when(F.col("line_no") % 2 == 0, "box").otherwise("aside")
    c = t.select((F.col("doc_id") + 1).alias("doc_id"), (F.floor(F.col("line_no") / 3) * 10 + F.when(F.col("line_no") % 2 == 0, 0).otherwise(1)).alias("ord"), label.alias("label"), F.col("line").alias("text"))
    return structure.callout_members(m, c).select("doc_id", "line_no", "label")


@register(f"WITH {LINES} SELECT doc_id, count(*) FILTER (contains(lower(line), 'note') OR contains(lower(line), 'licensed')) AS n_hits FROM lines GROUP BY doc_id")
def jn06_keywords(spark, sf_dir):
    return lines_of(spark, sf_dir).groupBy("doc_id").agg(F.count_if(structure.contains_any(F.col("line"), ("note", "licensed"))).alias("n_hits"))


LABELS = f"""{SIGS}, base AS (SELECT doc_id, sig, ord, size, CASE WHEN ord = 3 THEN NULL WHEN ord % 2 = 0 THEN 'H2' ELSE 'H3' END AS label FROM sigs),
top AS (SELECT doc_id, sig, label, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS k FROM base WHERE label IS NOT NULL)"""


@register(f"WITH {LABELS} SELECT b.doc_id, b.sig, CASE WHEN t.sig IS NULL THEN b.label WHEN b.sig = t.sig THEN 'H1' WHEN b.label = t.label THEN 'H2' ELSE b.label END AS label FROM base b LEFT JOIN top t ON t.doc_id = b.doc_id AND k = 1")
def wn09_single_top(spark, sf_dir):
    t = fonts.signatures(spans_of(spark, sf_dir))
    t = t.select("doc_id", "sig", "ord", "size", F.when(F.col("ord") == 3, None).when(F.col("ord") % 2 == 0, "H2").otherwise("H3").alias("label"))
    return structure.single_top(t).select("doc_id", "sig", "label")


UNESCAPED = "replace(replace(replace(text, '&raquo;', '»'), '&laquo;', '«'), '&amp;', '&')"


@register(f"""
WITH {MARKED}, {TOC}, mk AS (SELECT doc_id, page_no, line_no, sig, {UNESCAPED} AS text, pos FROM (SELECT doc_id, page_no, line_no, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 1)) AS sig, unnest(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 2)) AS text, generate_subscripts(regexp_extract_all(line, '«(sig[a-z0-9]+):([^»]*)»', 1), 1) AS pos FROM marked)),
b AS (SELECT s.doc_id, coalesce(q.size, 10.0) AS body FROM (SELECT DISTINCT doc_id FROM sigs) s LEFT JOIN (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(ord)) AS k FROM sigs WHERE size BETWEEN 8 AND 12 GROUP BY doc_id, size) q ON q.doc_id = s.doc_id AND k = 1),
tl AS (SELECT doc_id, sig, min(level) AS toc_level FROM (SELECT doc_id, sig, {NORM.format("text")} AS key FROM mk) JOIN (SELECT doc_id, {NORM.format("title")} AS key, min(level) AS level FROM toc GROUP BY ALL) USING (doc_id, key) WHERE key <> '' GROUP BY ALL),
ev AS (SELECT doc_id, sig, bool_or({UPPER.format("text")} AND length(text) > 3) AS caps, bool_or({TITLE.format(STRIP.format("text"))}) AS title,
  bool_or(len(list_filter({list(structure.NOTE_KEYWORDS)}, lambda w: contains(lower(text), w))) > 0) AS note, bool_or(len(list_filter({list(structure.READ_ALOUD)}, lambda w: contains(lower(text), w))) > 0) AS aloud FROM mk GROUP BY ALL),
l AS (SELECT s.doc_id, s.sig, s.ord, s.size, CASE WHEN EXISTS (SELECT 1 FROM tl x WHERE x.doc_id = s.doc_id) AND NOT candidate_heading AND toc_level IS NULL AND (caps OR title) AND s.size > body THEN NULL WHEN note THEN 'callout_gm' WHEN aloud THEN 'callout_read_aloud'
  WHEN toc_level IS NOT NULL THEN 'H' || least(toc_level, 4) WHEN (caps OR title) AND s.size > body THEN CASE WHEN suggested_level IS NOT NULL THEN 'H' || suggested_level WHEN s.size > 1.5 * body THEN 'H2' ELSE 'H3' END END AS label
  FROM sigs s JOIN b USING (doc_id) LEFT JOIN tl ON tl.doc_id = s.doc_id AND tl.sig = s.sig LEFT JOIN ev ON ev.doc_id = s.doc_id AND ev.sig = s.sig),
t AS (SELECT doc_id, sig, label, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS k, bool_or(label = 'H1') OVER (PARTITION BY doc_id) AS has FROM l WHERE starts_with(label, 'H'))
SELECT l.doc_id, l.sig, CASE WHEN t.sig IS NULL OR has THEN l.label WHEN l.sig = t.sig THEN 'H1' WHEN l.label = t.label THEN 'H2' ELSE l.label END AS label FROM l LEFT JOIN t ON t.doc_id = l.doc_id AND k = 1""")
def hd05_labels(spark, sf_dir):
    """The whole chain from spans to labels."""
    from corpusloom.plans.convert import labels

    return labels(spans_of(spark, sf_dir), toc_of(spark, sf_dir))


@register(f"""
WITH {LINES}, p AS (SELECT doc_id, line_no // 10 + 1 AS page_no, string_agg(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN line_no % 10 IN (2, 4) THEN '' ELSE line || ' 17' END ELSE line END, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)
SELECT doc_id, CAST(min(page_no) AS INT) AS page_no FROM p WHERE page_no <= 3 AND (contains(lower(substring(text, 1, 500)), 'contents') OR contains(lower(substring(text, 1, 500)), 'index') OR (len(string_split(text, chr(10))) >= 8 AND len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'page ') OR regexp_matches(rtrim(x), '([1-9]|[1-9]0)$'))) >= 5)) GROUP BY doc_id""")
def wn08_visual_toc(spark, sf_dir):
    """Half of the documents have page numbers at the ends of lines, and blank lines between."""
    n = F.col("line_no") % 10
    line = F.when(F.col("doc_id") % 2 == 0, F.when(n.isin(2, 4), "").otherwise(F.concat("line", F.lit(" 17")))).otherwise(F.col("line"))
    pages = lines_of(spark, sf_dir).select("doc_id", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page_no"), "line_no", line.alias("line"))
    return structure.visual_toc_page(pages.groupBy("doc_id", "page_no").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text")))


@register(f"""
WITH {LINES}, e AS (SELECT doc_id, line_no, CASE WHEN contains(line, ' the ') OR contains(line, ' la ') THEN 'START ' || replace(line, 'STOP', '') ELSE replace(line, 'a ', 'STOP ') END AS t FROM lines),
v AS (SELECT *, CASE WHEN starts_with(t, 'START ') THEN CASE WHEN contains(t, 'STOP') THEN 'b' ELSE 'o' END WHEN contains(t, 'STOP') THEN 'c' END AS ev FROM e),
s AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'o' AS inside FROM v),
c AS (SELECT doc_id, line_no, CASE WHEN ev = 'b' THEN substring(t, 1, strpos(t, 'STOP') + 3) WHEN ev = 'o' THEN t WHEN inside AND ev = 'c' THEN substring(t, 1, strpos(t, 'STOP') + 3) WHEN inside THEN t END AS text FROM s)
SELECT doc_id, count(*) AS n_captured, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text_md5 FROM c WHERE text IS NOT NULL GROUP BY doc_id""")
def wn06_boundaries(spark, sf_dir):
    t = lines_of(spark, sf_dir)
    hit = F.contains("line", F.lit(" the ")) | F.contains("line", F.lit(" la "))
    blocks = t.select("doc_id", F.col("line_no").alias("ord"), F.when(hit, F.concat(F.lit("START "), F.replace("line", F.lit("STOP"), F.lit("")))).otherwise(F.replace("line", F.lit("a "), F.lit("STOP "))).alias("text"))
    rules = spark.createDataFrame([("box", "START", "STOP")], "label string, start_text string, end_text string")
    return structure.boundary_capture(blocks, rules).groupBy("doc_id").agg(F.count("*").alias("n_captured"), F.md5(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY ord)")).alias("text_md5"))


# -- rendering -----------------------------------------------------------------------------------------

STATED = """l AS (SELECT conv_id AS doc_id, turn AS line_no, text, role, CASE role WHEN 'assistant' THEN CASE WHEN contains(text, '. ') THEN '' ELSE 'callout_gm' END WHEN 'system' THEN '' END AS after FROM conversations),
cu AS (SELECT *, last_value(after IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS cur FROM l),
st AS (SELECT *, role = 'assistant' OR (role = 'user' AND coalesce(cur, '') <> '') AS inside FROM cu)"""


def stated_of(spark, sf):
    c = tables.parquet(spark, sf, "conversations")
    # Two markers to a line, each of which gets its prefix.
    mark = lambda sig: F.concat(F.lit(f"«{sig}:"), "text", F.lit(f"» «{sig}:x»"))
    lines = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", mark("sig009")).otherwise(mark("sig001")).alias("line"))
    one = lines.select("doc_id").distinct()
    labelled = one.select("doc_id", F.lit("sig001").alias("sig"), F.lit("callout_gm").alias("label")).union(one.select("doc_id", F.lit("sig009"), F.lit("H2")))
    ends = spark.createDataFrame([("callout_gm", "never", 1), ("callout_gm", ". ", 2), ("callout_gm", "", 3), ("callout_gm", None, 4)], "label string, end_text string, ord int")
    return rendering.callout_state(rendering.first_label(lines, labelled), ends)


@register(f"WITH {STATED} SELECT doc_id, md5(string_agg(CASE WHEN role = 'system' THEN '## ' || text || ' ## x' WHEN role = 'assistant' THEN '> ' || text || ' > x' WHEN inside THEN '> ' || text ELSE text END, chr(10) ORDER BY line_no)) AS text_md5 FROM st GROUP BY doc_id")
def wn04_callouts(spark, sf_dir):
    return rendering.documents(rendering.render(stated_of(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"))


@register(f"WITH {STATED}, z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS k FROM st) SELECT doc_id, 'callout_gm' AS callout FROM z WHERE k = 1 AND inside AND NOT (role = 'assistant' AND contains(text, '. '))")
def wn05_unclosed(spark, sf_dir):
    return rendering.unclosed_callouts(stated_of(spark, sf_dir))


PAGED = f"""{LINES}, pg AS (SELECT doc_id, page_no, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) - 1 AS n FROM (SELECT doc_id, line_no // 10 + 1 AS page_no, line_no, line FROM lines UNION ALL SELECT DISTINCT doc_id, line_no // 10 + 1, -1, '<!-- Page ' || (line_no // 10 + 1) || ' -->' FROM lines))"""


def paged_of(spark, sf):
    return marking.with_page_markers(lines_of(spark, sf).select("doc_id", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page_no"), "line_no", "line"))


@register(f"WITH {PAGED} SELECT doc_id, page_no AS page, count(*) AS n_lines, min(n) AS first_line FROM pg GROUP BY ALL")
def wn07_page_of_lines(spark, sf_dir):
    return marking.page_of_lines(paged_of(spark, sf_dir)).groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


@register(f"""
WITH {PAGED}, im AS (SELECT doc_id, page_no, k, '[FIGURE: ' || k || ']' || chr(10) || '<!-- ![](' || printf('page%03d_img%02d.png', page_no, k) || ') -->' AS line FROM (SELECT DISTINCT doc_id, page_no FROM pg), (SELECT unnest([1, 2]) AS k)),
u AS (SELECT doc_id, n, -1000000 AS s, line FROM pg UNION ALL SELECT im.doc_id, pg.n, -k, im.line FROM im JOIN pg ON pg.doc_id = im.doc_id AND pg.page_no = im.page_no AND pg.line_no = -1)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY n, s)) AS text_md5 FROM u GROUP BY doc_id""")
def jn10_images(spark, sf_dir):
    lines = paged_of(spark, sf_dir)
    pages = marking.page_of_lines(lines).select("doc_id", "page").distinct()
    images = pages.withColumn("img_index", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("filename", F.format_string("page%03d_img%02d.png", "page", "img_index")).withColumn("alt_text", F.col("img_index").cast("string"))
    out = rendering.place_images(lines, images)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)")).alias("text_md5"))


@register(f"""
WITH {PAGED}, g AS (SELECT *, coalesce(trim(lead(line) OVER (PARTITION BY doc_id ORDER BY n)) = '', false) AS gap FROM pg), slot AS (SELECT doc_id, page_no, coalesce(min(n) FILTER (gap), min(n)) AS n FROM g GROUP BY ALL),
u AS (SELECT doc_id, n, 0 AS s, line FROM pg UNION ALL SELECT doc_id, n, 1, chr(10) || '| a |' FROM slot)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n, s)) AS text_md5 FROM u GROUP BY doc_id""")
def jn11_tables(spark, sf_dir):
    lines = paged_of(spark, sf_dir)
    t = marking.page_of_lines(lines).select("doc_id", "page").distinct().select("doc_id", "page", F.lit("t1").alias("table_id"), F.lit("| a |").alias("markdown"))
    return rendering.documents(rendering.place_tables(lines, t)).select("doc_id", F.md5("text").alias("text_md5"))


# -- quality -------------------------------------------------------------------------------------------

MD = f"{LINES}, md AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN repeat('#', CAST(1 + (doc_id + line_no) % 4 AS BIGINT)) || ' ' || substring(line, 1, 20) WHEN 2 THEN '' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE line END WHEN 4 THEN ' - ' || line ELSE line END AS line FROM lines)"


def markdown_of(spark, sf):
    n = F.col("line_no") % 6
    out = F.when(n == 0, F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + F.col("line_no")) % 4).cast("int")), F.lit(" "), F.substring("line", 1, 20))).when(n == 2, "").when(n == 3, F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("line"))).when(n == 4, F.concat(F.lit(" - "), "line")).otherwise(F.col("line"))
    return lines_of(spark, sf).select("doc_id", "line_no", out.alias("line"))


LINT = f"""{MD}, a AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN length(regexp_extract(line, '^(#{{1,6}}) ', 1)) END AS level, trim(line) = '' AS blank FROM md),
b AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(blank) OVER w AS pb, lead(blank) OVER w AS nb, row_number() OVER w AS nth FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT doc_id, line_no, 'MD001' AS rule FROM b WHERE level > before + 1 UNION ALL SELECT doc_id, line_no, 'MD012' FROM b WHERE blank AND pb UNION ALL SELECT doc_id, line_no, 'MD022' FROM b WHERE level IS NOT NULL AND (NOT pb OR NOT nb) UNION ALL SELECT doc_id, line_no, 'MD041' FROM b WHERE nth = 1 AND coalesce(level, 0) <> 1 UNION ALL SELECT doc_id, line_no, 'MD003' FROM b WHERE regexp_matches(line, '^#{{1,6}} .*\\s#+\\s*$') UNION ALL SELECT doc_id, line_no, 'MD007' FROM b WHERE regexp_matches(line, '^( |   )[-*] '))"""


@register(f"WITH {LINT} SELECT doc_id, rule, count(*) AS n, min(line_no) AS first_line FROM r GROUP BY ALL")
def qa06_lint(spark, sf_dir):
    return quality.lint(markdown_of(spark, sf_dir)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first_line"))


@register(f"WITH {LINT}, g AS (SELECT doc_id, rule, min(line_no) AS fst, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fst, rule) AS i FROM g) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_issues, string_agg(rule, ',' ORDER BY fst, rule) FILTER (i <= 3) AS rules, CASE WHEN sum(n) > 20 THEN 'warning' ELSE 'success' END AS status, any_value(samples) AS samples FROM k JOIN (SELECT doc_id, string_agg(rule || ' in line ' || (line_no + 1), '; ' ORDER BY line_no, rule) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, rule) AS q FROM r) WHERE q <= 3 GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def ag17_lint_summary(spark, sf_dir):
    return quality.lint_summary(quality.lint(markdown_of(spark, sf_dir)))


@register(f"WITH {MD}, h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}}) (.+)$', 1)) AS level FROM md WHERE regexp_matches(line, '^#{{1,6}} .+$')), s AS (SELECT *, level - lag(level) OVER w > 1 AS skip, level > 1 AND coalesce(min(level) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= level, true) AS orphan FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, count(*) FILTER (skip) AS skips, count(*) FILTER (level = 1) AS n_h1, count(*) AS n_headings, count(*) FILTER (orphan) AS orphans, count(*) FILTER (level = 1) = 1 AND count(*) FILTER (skip) = 0 AND count(*) FILTER (orphan) = 0 AS valid FROM s GROUP BY doc_id")
def qa11_hierarchy(spark, sf_dir):
    return quality.hierarchy(quality.headings(markdown_of(spark, sf_dir)))


@register(f"""
WITH {MD}, {TOC}, a AS (SELECT doc_id, {NORM.format("title")} AS key, min(level) AS tl FROM toc GROUP BY ALL), b AS (SELECT doc_id, {NORM.format("regexp_extract(line, '^(#{1,6}) (.+)$', 2)")} AS key, min(length(regexp_extract(line, '^(#{{1,6}}) (.+)$', 1))) AS hl, count(*) AS n FROM md WHERE regexp_matches(line, '^#{{1,6}} .+$') GROUP BY ALL),
j AS (SELECT doc_id, key, tl, hl, n FROM a FULL JOIN b USING (doc_id, key))
SELECT doc_id, problem, count(*) AS n FROM (SELECT doc_id, 'missing_in_doc' AS problem FROM j WHERE hl IS NULL UNION ALL SELECT doc_id, 'level_mismatch' FROM j WHERE hl <> tl UNION ALL SELECT doc_id, 'duplicate' FROM j WHERE n > 1) GROUP BY ALL""")
def qa08_toc_gaps(spark, sf_dir):
    return quality.toc_gaps(toc_of(spark, sf_dir), quality.headings(markdown_of(spark, sf_dir))).groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


@register(f"WITH {LINES} SELECT doc_id, round(100.0 * count(*) FILTER (length(line) > 200) / count(*), 2) AS affected_percentage, count(*) FILTER (length(line) > 200) > 0.15 * count(*) AS pervasive_flag FROM lines GROUP BY doc_id")
def qa09_pervasive(spark, sf_dir):
    return quality.pervasive(lines_of(spark, sf_dir).select("doc_id", (F.length("line") > 200).alias("affected")))


@register(f"""
WITH {LINES}, g AS (SELECT doc_id, line_no // 10 + 1 AS page_no, count(*) FILTER (length(line) % 10 = 1) AS headers, count(*) FILTER (length(line) % 10 = 2) AS rows FROM lines GROUP BY ALL),
s AS (SELECT *, CASE WHEN headers > 0 THEN 40 ELSE 0 END + least(30, 10 * rows) + least(20, 3 * rows) AS likelihood FROM g)
SELECT doc_id, page_no, headers, rows, likelihood, likelihood >= 60 AND headers > 0 AND rows >= 2 AS detected FROM s""")
def tb07_table_signal(spark, sf_dir):
    n = F.length("line") % 10
    m = lines_of(spark, sf_dir).select("doc_id", (F.floor(F.col("line_no") / 10) + 1).alias("page_no"), F.when(n == 1, "sig012").when(n == 2, "sig011").otherwise("sig001").alias("sig"))
    return quality.table_signal(m, "sig012", "sig011")


def envelopes(spark, sf):
    t = tables.parquet(spark, sf, "labels").withColumn("step_id", F.when(F.col("doc_id") % 3 == 0, "9.2").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("7.7_p"), (F.col("doc_id") % 5).cast("string"))).otherwise("1.1"))
    names = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("heading_hierarchy"), F.lit("section_coherence"), F.lit("nesting_correctness"))).otherwise(F.array(F.lit("detection_recall"), F.lit("detection_precision"), F.lit("boundary_accuracy")))
    values = F.array((F.col("doc_id") % 7).cast("int"), F.lit(3), (1 + F.col("quality") * 2).cast("int"))
    return t.select("doc_id", "step_id", F.when(F.col("toxic") == 1, "odd").otherwise("success").alias("status"), F.map_from_arrays(names, values).alias("rubric_scores"), F.lit(None).cast("array<string>").alias("critical_failures"))


@register("SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 IN (0, 6) THEN 1 ELSE 0 END AS n_violations FROM labels")
def qa01_envelopes(spark, sf_dir):
    return quality.envelope_violations(envelopes(spark, sf_dir), quality.step_table(spark)).select("doc_id", F.size("violations").alias("n_violations"))


@register("SELECT doc_id, doc_id % 3 = 2 OR (doc_id % 7 >= 2 AND quality = 1) AS passed FROM labels")
def qa03_gate(spark, sf_dir):
    return quality.gate(envelopes(spark, sf_dir), quality.rubric_table(spark)).select("doc_id", "passed")


@register("SELECT doc_id, CASE WHEN quality = 1 THEN 'done' WHEN 1 + doc_id % 3 < 3 THEN 'retry' ELSE CASE doc_id % 2 WHEN 0 THEN 'failed' ELSE 'flagged' END END AS action FROM labels")
def agt04_retry_policy(spark, sf_dir):
    t = tables.parquet(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "9.3").otherwise("7.7_p1_t2").alias("step_id"), (1 + F.col("doc_id") % 3).alias("attempt"), (F.col("quality") == 1).alias("passed"))
    return runs.retry_policy(t, quality.step_table(spark)).select("doc_id", "action")


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'stale' ELSE 'awaiting' END AS state FROM documents")
def agt03_freshness(spark, sf_dir):
    asked = runs.requests(docs_of(spark, sf_dir).select("doc_id", F.lit("9.2").alias("step_id"), F.to_json(F.struct("doc_id", "lang")).alias("payload")))
    got = asked.where("doc_id % 3 < 2").select("doc_id", "step_id", F.lit(1).alias("attempt"), F.when(F.col("doc_id") % 3 == 0, F.col("input_hash")).otherwise("other").alias("input_hash"), F.lit("success").alias("status"))
    return runs.matched_outputs(asked, got).select("doc_id", "state")


# -- runs ----------------------------------------------------------------------------------------------

STEPS = "steps AS (SELECT user_id AS doc_id, CAST(event_id % 11 AS INT) AS phase, CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'warning' ELSE 'success' END AS status, event_id FROM events), ph AS (SELECT doc_id, phase, max(CASE status WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS s, count(*) AS n_steps FROM steps GROUP BY ALL)"


def steps_of(spark, sf):
    e = tables.parquet(spark, sf, "events")
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 11).cast("int").alias("phase"), F.when(F.col("event_id") % 97 == 0, "error").when(F.col("event_id") % 13 == 0, "warning").otherwise("success").alias("status"))


@register(f"WITH {STEPS} SELECT doc_id, phase, CASE s WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'success' END AS status, n_steps FROM ph")
def ck09_severity(spark, sf_dir):
    return runs.phase_status(steps_of(spark, sf_dir))


@register(f"WITH {STEPS}, d AS (SELECT doc_id, list(phase) FILTER (s < 2) AS done FROM ph GROUP BY doc_id) SELECT doc_id, CAST(len(coalesce(done, [])) AS INT) AS completed, CAST(list_min(list_filter(range(0, 11), lambda x: NOT list_contains(coalesce(done, []), CAST(x AS INT)))) AS INT) AS next_phase, CASE WHEN len(coalesce(done, [])) = 11 THEN 'completed' ELSE 'in_progress' END AS state FROM d")
def ck05_status(spark, sf_dir):
    return runs.status_table(runs.phase_status(steps_of(spark, sf_dir)))


@register(f"WITH {STEPS} SELECT d.doc_id, CAST(p AS INT) AS phase FROM (SELECT DISTINCT doc_id FROM ph) d, (SELECT unnest(range(0, 8)) AS p) LEFT JOIN ph ON ph.doc_id = d.doc_id AND ph.phase = p AND s < 2 WHERE ph.doc_id IS NULL")
def jn16_missing_phases(spark, sf_dir):
    return runs.missing_phases(runs.phase_status(steps_of(spark, sf_dir)), 8)


@register("SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) WHERE p <= 3")
def wn10_recent(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return runs.recent(e, ["event_type"], "at", ["user_id"], 3).select("user_id", "event_type", "ts", "event_id")


REPORT_TAIL = "\\n\\n## License Notice\\n\\n" + runs.LICENSE + "\\n"


@register(f"""
WITH {STEPS}, d AS (SELECT * FROM (VALUES {", ".join(f"({f[0]}, '{f[1]}', '{f[2]}', '{n[0]}', '{n[1]}')" for f, n in zip(runs.PHASE_FILES, runs.PHASE_NOTES))}) v(phase, name, files, changes, compare)),
x AS (SELECT ph.*, name, files, changes, compare FROM ph JOIN d USING (phase)), b AS (SELECT user_id AS doc_id, min(ts) AS began FROM events GROUP BY user_id),
g AS (SELECT doc_id, string_agg(CAST(phase AS VARCHAR), ', ' ORDER BY phase) FILTER (s < 2) AS phases,
  string_agg('| ' || phase || ' | ' || name || ' | ' || files || ' |', chr(10) ORDER BY phase) FILTER (s < 2) AS rows,
  string_agg('### Phase ' || phase || ': ' || name || e'\\n\\n**Output Files:** ' || files || e'\\n\\n**Changes Made:**\\n' || changes || e'\\n\\n**What to Compare:**\\n' || compare || chr(10), chr(10) ORDER BY phase) FILTER (s < 2) AS details,
  string_agg('- slow ' || phase || e'\\n- twice', chr(10) ORDER BY phase) FILTER (s = 1) AS warned, string_agg('- broken ' || phase, chr(10) ORDER BY phase) FILTER (s = 2) AS failed, CAST(sum(n_steps) AS BIGINT) AS sec FROM x GROUP BY doc_id)
SELECT doc_id, md5(e'# PDF Conversion Report\\n\\n**Source:** Book ' || doc_id || e'\\n**Author:** Unknown\\n**Pages:** 7\\n**Converted:** ' || strftime(began + sec * INTERVAL 1 SECOND, '%Y-%m-%d') || e'\\n\\n## Pipeline Summary\\n\\nCompleted Phases: ' || coalesce(phases, '')
  || e'\\n\\n## Phase Summary\\n\\n| Phase | Name | Output Files |\\n|-------|------|--------------|\\n' || coalesce(rows, '') || e'\\n\\n## Phase Details\\n\\n' || coalesce(details, '')
  || e'\\n## Performance\\n\\n**Conversion Started:** ' || strftime(began, '%Y-%m-%dT%H:%M:%S') || e'\\n**Conversion Completed:** ' || strftime(began + sec * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') || e'\\n**Total Duration:** '
  || CASE WHEN sec >= 3600 THEN sec // 3600 || 'h ' || sec % 3600 // 60 || 'm ' WHEN sec >= 60 THEN sec // 60 || 'm ' ELSE '' END || sec % 60 || 's' || chr(10)
  || coalesce(e'\\n## Warnings\\n\\n' || warned || chr(10), '') || coalesce(e'\\n## Errors\\n\\n' || failed || chr(10), '')
  || e'\\n## Output Files\\n\\n- `b' || doc_id || '-final.md` - Final converted markdown' || e'\\n- `font-family-mapping.json` - Font signature mapping\\n- `toc-extracted.txt` - Extracted table of contents\\n- `images/image-manifest.json` - Image positions' || e'{REPORT_TAIL}') AS text_md5 FROM g JOIN b USING (doc_id)""")
def snk09_report(spark, sf_dir):
    """Every section of the report: runs are users, and steps with errors or warnings are events."""
    r = runs.phase_status(steps_of(spark, sf_dir))
    none = F.array().cast("array<string>")
    p = F.col("phase").cast("string")
    began = tables.parquet(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min("ts").alias("started"))
    r = r.join(began, "doc_id").withColumn("seconds", F.col("n_steps"))
    r = r.withColumn("warnings", F.when(F.col("status") == "warning", F.array(F.concat(F.lit("slow "), p), F.lit("twice"))).otherwise(none)).withColumn("errors", F.when(F.col("status") == "error", F.array(F.concat(F.lit("broken "), p))).otherwise(none))
    meta = r.select("doc_id").distinct().select("doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit(7).alias("page_count"))
    return runs.report(r, meta, runs.phase_table(spark)).select("doc_id", F.md5("text").alias("text_md5"))


# -- more of the same kinds ----------------------------------------------------------------------------


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || chr(65533) || 'b' || source ELSE source || lang END AS safe FROM documents")
def prj01_safe_string(spark, sf_dir):
    """Nulls, and bytes that are no UTF-8."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 1, F.concat(F.unhex(F.lit("61FF62")).cast("string"), "source")).when(k > 1, F.concat("source", "lang"))
    return docs_of(spark, sf_dir).select("doc_id", X.safe_string(raw).alias("safe"))


@register("SELECT vec_id, CAST(trunc(label * 1.5 * 1275 / 612.0) AS INT) AS x0, CAST(trunc((label * 1.5 + 100) * 1650 / 792.0) AS INT) AS y1 FROM embeddings")
def prj20_pixels(spark, sf_dir):
    t = tables.parquet(spark, sf_dir, "embeddings")
    box = F.struct((F.col("label") * 1.5).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), (F.col("label") * 1.5 + 100).alias("y1"))
    p = layout.to_pixels(box, F.lit(612.0), F.lit(792.0), F.lit(1275), F.lit(1650))
    return t.select("vec_id", p["x0"].alias("x0"), p["y1"].alias("y1"))


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS INT) WHEN 1 THEN 7 ELSE 5 END AS x0 FROM documents")
def jn13_bbox_choice(spark, sf_dir):
    box = lambda x: F.struct(x.cast("int").alias("x0"))
    k = F.col("doc_id") % 3
    rows = F.array(F.struct(F.lit("t0").alias("table_id"), F.lit(None).cast("struct<x0:int>").alias("bbox")), F.struct(F.lit("t1").alias("table_id"), box(F.lit(5)).alias("bbox")), F.struct(F.lit("t2").alias("table_id"), box(F.lit(7)).alias("bbox")))
    return docs_of(spark, sf_dir).select("doc_id", layout.confirmed_box(F.when(k == 0, box(F.col("doc_id"))), rows, F.when(k == 1, "t2").otherwise("t0"))["x0"].alias("x0"))


@register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '| a |' WHEN doc_id % 4 = 1 THEN '| b |' END AS markdown FROM documents")
def tb04_table_markdown(spark, sf_dir):
    k = F.col("doc_id")
    raw = F.when(k % 2 == 0, '{"markdown_table": "| a |"}').when(k % 4 == 1, '{"tables": [{"id": 1}, {"markdown": "| b |"}]}').otherwise("{}")
    return docs_of(spark, sf_dir).select("doc_id", layout.table_markdown(raw).alias("markdown"))


@register("SELECT event_id, CASE WHEN event_id % 11 >= 9 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM events")
def ck06_state_rules(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    n = (F.col("event_id") % 11).cast("int")
    t = e.select("event_id", F.lit(9).alias("current"), F.array(F.lit(0), n).alias("completed"), F.when(F.col("event_id") % 5 == 0, "nine").otherwise("7.7_p1_t2").alias("current_step"))
    return runs.state_violations(t).select("event_id", F.size("violations").alias("n"))


@register("SELECT user_id AS doc_id, greatest(1, least(5, CAST(round_even(avg(event_id % 6), 0) AS INT))) AS overall FROM events GROUP BY user_id")
def qa10_overall(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    return quality.overall_rating(e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 6).alias("score")))


@register("SELECT user_id AS doc_id, rank, event_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, event_id) AS rank FROM events) WHERE rank <= 3")
def qa10_top_issues(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    return quality.top_issues(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("severity"))).select("doc_id", F.col("rank").cast("long").alias("rank"), "ord")


@register("SELECT doc_id, string_agg(message, '|' ORDER BY phase, k) AS messages, count(*) AS n FROM (SELECT user_id AS doc_id, event_id % 11 AS phase, event_id AS k, 'Phase ' || event_id % 11 || ': ' || event_type AS message FROM events) GROUP BY doc_id")
def ag18_warnings(spark, sf_dir):
    e = tables.parquet(spark, sf_dir, "events")
    t = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 11).alias("phase"), F.col("event_id").alias("ord"), F.array("event_type").alias("warnings"))
    return runs.warning_rollup(t)


ROMANS = "['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x']"


@register(f"""
WITH {LINES}, t AS (SELECT doc_id, line_no, CASE doc_id % 5 WHEN 0 THEN CAST(line_no + 3 AS VARCHAR) WHEN 1 THEN CAST(line_no * 2 AS VARCHAR) WHEN 2 THEN upper({ROMANS}[line_no + 1]) WHEN 3 THEN CASE WHEN line_no % 2 = 0 THEN CAST(line_no // 2 AS VARCHAR) ELSE {ROMANS}[line_no] END ELSE line END AS text FROM lines),
n AS (SELECT doc_id, line_no, lower(text) AS x FROM t WHERE text IS NOT NULL),
d AS (SELECT doc_id, count(*) AS c, bool_and(coalesce(v = p + 1, p IS NULL)) AS ok FROM (SELECT doc_id, v, lag(v) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (SELECT doc_id, line_no, CAST(x AS BIGINT) AS v FROM n WHERE regexp_matches(x, '^[0-9]+$'))) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS c, bool_and(coalesce(v = p + 1, p IS NULL)) AS ok FROM (SELECT doc_id, v, lag(v) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (SELECT doc_id, line_no, list_position({ROMANS}, x) AS v FROM n WHERE list_contains({ROMANS}, x))) GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN coalesce(d.c, 0) >= 2 THEN d.ok WHEN coalesce(r.c, 0) >= 2 THEN r.ok ELSE false END AS sequential FROM (SELECT DISTINCT doc_id FROM lines) a LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)""")
def wn03_page_numbers(spark, sf_dir):
    """Texts that count, skip, count in Roman numbers, count beside Roman numbers, or are none."""
    k, n = F.col("doc_id") % 5, F.col("line_no")
    roman = lambda i: F.try_element_at(F.array(*[F.lit(r) for r in X.ROMAN]), F.nullif(i, F.lit(0)).cast("int"))
    text = F.when(k == 0, (n + 3).cast("string")).when(k == 1, (n * 2).cast("string")).when(k == 2, F.upper(roman(n + 1))).when(k == 3, F.when(n % 2 == 0, F.floor(n / 2).cast("string")).otherwise(roman(n))).otherwise(F.col("line"))
    t = lines_of(spark, sf_dir).select("doc_id", "line_no", text.alias("text"))
    t = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_no", "text")))), lambda x: x["text"]).alias("texts"))
    return t.select("doc_id", X.page_numbers(F.col("texts")).alias("sequential"))


@register(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_replace(line || ' ..... ' || line_no, '\\s*\\.{{2,}}\\s*([0-9]+)\\s*$', ' \\1') AS line FROM lines")
def poc03_leaders(spark, sf_dir):
    t = lines_of(spark, sf_dir)
    return t.select("doc_id", "line_no", cleaning.clean_leaders(F.concat("line", F.lit(" ..... "), F.col("line_no").cast("string"))).alias("line"))


@register(f"WITH {SIGS} SELECT doc_id, sig FROM sigs WHERE ord % 4 = 0 OR ord % 4 = 1 UNION SELECT doc_id, sig FROM sigs WHERE ord % 4 = 2")
def ag11_footer_ids(spark, sf_dir):
    s = fonts.signatures(spans_of(spark, sf_dir))
    k = F.col("ord") % 4
    c = s.select("doc_id", "sig", F.when(k == 0, "watermark").when(k == 1, "page_number").otherwise("footer").alias("category"), F.when(k == 3, "low").when(k == 2, None).otherwise("high").alias("confidence"))
    return fonts.footer_ids(c)


@register("SELECT user_id AS doc_id, event_id AS seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 11 = 9) WHERE k = 1")
def wn11_latest(spark, sf_dir):
    """The last result of phase 9 in each run."""
    e = tables.parquet(spark, sf_dir, "events")
    t = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 11).alias("phase"), F.struct("ts", "event_id").alias("at"), "event_type")
    return runs.latest(t, 9, "at").select("doc_id", F.col("at.event_id").alias("seq"), "event_type")


@register()
def convert_documents(spark, sf_dir):
    """Every phase in one plan: spans to clean Markdown of each document. Its tests compare it with the operators in a row."""
    from corpusloom.plans.convert import convert

    return convert(spans_of(spark, sf_dir), toc_of(spark, sf_dir)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


from corpusloom.plans import control  # noqa: E402,F401  registers more queries
