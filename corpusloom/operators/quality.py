"""Lint rules, outline checks, rubrics and table signals as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

MIN_SCORE, MAX_SCORE = 2, 5
#: The dimensions that each assessed step is scored on.
RUBRICS = {
    "3.2": ("completeness", "level_accuracy", "page_accuracy", "output_format"),
    "4.5": ("correct_joins", "no_false_joins", "readability"),
    "6.4": ("correction_accuracy", "false_positive_rate", "domain_term_preservation"),
    "7.7": ("detection_recall", "detection_precision", "boundary_accuracy"),
    "8.7": ("row_column_fidelity", "markdown_validity", "content_preservation"),
    "9.2": ("heading_hierarchy", "section_coherence", "nesting_correctness"),
    "9.3": ("reading_order", "paragraph_integrity", "flow_continuity"),
    "9.4": ("cell_accuracy", "structure_preservation", "alignment_check"),
    "9.5": ("detection_accuracy", "format_preservation", "boundary_correctness"),
    "9.7": ("gap_detection", "duplicate_detection", "actionable_suggestions", "font_source_awareness"),
    "9.8": ("order_correctness", "confidence_flagging", "threshold_adherence"),
    "10.2": ("rating_justification", "dimension_coverage", "score_consistency"),
    "10.3": ("issue_clarity", "example_quality", "actionable_guidance"),
}
#: How much a run depends on each step.
CRITICALITY = {"3.2": "medium", "4.5": "low", "6.4": "low", "7.7": "medium", "8.7": "medium", "9.2": "high", "9.3": "high", "9.4": "high", "9.5": "high", "9.7": "medium", "9.8": "medium", "10.2": "low", "10.3": "low"}


def base_step(step: Column) -> Column:
    """The step id without its page and table suffix."""
    return F.regexp_replace(step, r"_p\d+(_t\d+)?$", "")


def rubric_table(spark) -> DataFrame:
    return spark.createDataFrame([(s, list(d)) for s, d in RUBRICS.items()], "step string, dims array<string>")


def step_table(spark) -> DataFrame:
    return spark.createDataFrame(list(CRITICALITY.items()), "step string, criticality string")


def envelope_violations(outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """outputs with ``violations``: what breaks the envelope's contract, all of it."""
    t = outputs.withColumn("step", base_step(F.col("step_id"))).join(F.broadcast(steps), "step", "left")
    bad = F.map_filter(F.coalesce("rubric_scores", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))), lambda k, v: (v < 1) | (v > MAX_SCORE))
    rules = [(F.col("step_id").isNull(), F.lit("step_id missing")), (F.col("status").isNull(), F.lit("status missing")), (~F.col("status").isin("success", "warning", "failed"), F.lit("status unknown")), (F.col("step_id").isNotNull() & F.col("criticality").isNull(), F.lit("step unknown"))]
    fixed = F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    return t.withColumn("violations", F.concat(fixed, F.transform(F.array_sort(F.map_keys(bad)), lambda k: F.concat(F.lit("score out of range: "), k)))).drop("step", "criticality")


def gate(outputs: DataFrame, rubrics: DataFrame) -> DataFrame:
    """step_id, missing and low dimensions, passed: all dimensions present and high enough and nothing critical.

    A step without a rubric passes unless something critical failed."""
    t = outputs.withColumn("step", base_step(F.col("step_id"))).join(F.broadcast(rubrics), "step", "left")
    scores = F.coalesce("rubric_scores", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    missing = F.coalesce(F.array_sort(F.array_except("dims", F.map_keys(scores))), F.array().cast("array<string>"))
    low = F.when(F.col("dims").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: v < MIN_SCORE))))
    critical = F.size(F.coalesce("critical_failures", F.array().cast("array<string>"))) > 0
    return t.select(*outputs.columns, missing.alias("missing"), low.alias("low"), ((F.size(missing) == 0) & (F.size(low) == 0) & ~critical).alias("passed"))


def lint(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, rule of the structural Markdown rules, read from the lines alone."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    level = F.when(level > 0, level)
    blank = F.trim("line") == ""
    t = lines.withColumn("level", level).withColumn("blank", blank)
    t = t.withColumn("before", F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("prev_blank", F.lag("blank").over(w)).withColumn("next_blank", F.lead("blank").over(w)).withColumn("nth", F.row_number().over(w))
    found = [
        (F.col("level") > F.col("before") + 1, "MD001"),
        (F.col("blank") & F.col("prev_blank"), "MD012"),
        (F.col("level").isNotNull() & (~F.col("prev_blank") | ~F.col("next_blank")), "MD022"),
        ((F.col("nth") == 1) & (F.coalesce(F.col("level"), F.lit(0)) != 1), "MD041"),
        (F.col("line").rlike(r"^#{1,6} .*\s#+\s*$"), "MD003"),
        (F.col("line").rlike(r"^(?: |   )[-*] "), "MD007"),
    ]
    rules = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in found]))
    return t.select("doc_id", "line_no", F.explode(rules).alias("rule"))


def lint_summary(found: DataFrame, threshold: int = 20, shown: int = 3) -> DataFrame:
    """doc_id, n_issues, the first rules in order of appearance, status, samples (the first lines that break a rule)."""
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "rule"))).where(F.col("nth") <= shown)
    first = first.groupBy("doc_id").agg(F.expr("listagg(concat(rule, ' in line ', line_no + 1), '; ') WITHIN GROUP (ORDER BY nth)").alias("samples"))
    g = found.groupBy("doc_id", "rule").agg(F.min("line_no").alias("at"), F.count("*").alias("n"))
    g = g.groupBy("doc_id").agg(F.sum("n").alias("n_issues"), F.array_sort(F.collect_list(F.struct("at", "rule"))).alias("r"))
    return g.select("doc_id", "n_issues", F.array_join(F.transform(F.slice("r", 1, shown), lambda x: x["rule"]), ",").alias("rules"), F.when(F.col("n_issues") > threshold, "warning").otherwise("success").alias("status")).join(first, "doc_id")


def headings(lines: DataFrame) -> DataFrame:
    m = r"^(#{1,6}) (.+)$"
    return lines.where(F.col("line").rlike(m)).select("doc_id", "line_no", F.length(F.regexp_extract("line", m, 1)).alias("level"), F.regexp_extract("line", m, 2).alias("title"))


#: Lines that are placeholders of figures, or the commented links to their pictures.
FIGURE = r"^(\[FIGURE: .*\]|<!-- !\[.*-->)$"


def hierarchy(found: DataFrame) -> DataFrame:
    """doc_id, skips, n_h1, n_headings, orphans (headings below the first level without any higher one before them) and
    ``valid``: one first-level heading, no skips, no orphans."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    above = F.min("level").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = found.withColumn("skip", F.col("level") - F.lag("level").over(w) > 1).withColumn("orphan", (F.col("level") > 1) & F.coalesce(above >= F.col("level"), F.lit(True)))
    g = t.groupBy("doc_id").agg(F.count_if("skip").alias("skips"), F.count_if(F.col("level") == 1).alias("n_h1"), F.count("*").alias("n_headings"), F.count_if("orphan").alias("orphans"))
    return g.withColumn("valid", (F.col("n_h1") == 1) & (F.col("skips") == 0) & (F.col("orphans") == 0))


def top_heading_warnings(found: DataFrame) -> DataFrame:
    """doc_id, warning: documents with more than one first-level heading."""
    n = found.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("n")).where("n > 1")
    return n.select("doc_id", F.concat(F.lit("Multiple H1 headings found ("), F.col("n").cast("string"), F.lit("); a document should have one")).alias("warning"))


def orphan_lines(lines: DataFrame) -> DataFrame:
    """doc_id, n: lines of content before the first heading; blank lines, comments and figure placeholders are none."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    seen = F.max(F.col("line").rlike("^#{1,6} ")).over(w)
    t = lines.withColumn("seen", seen).where(~F.col("seen") & (X.strip(F.col("line")) != "") & ~F.col("line").rlike(FIGURE) & ~F.col("line").rlike("^<!--.*-->$"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"))


def toc_gaps(toc: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, key, problem: titles missing in the text, at another level, or repeated."""
    a = toc.groupBy("doc_id", X.norm_heading(F.col("title")).alias("key")).agg(F.min("level").alias("toc_level"))
    b = found.groupBy("doc_id", X.norm_heading(F.col("title")).alias("key")).agg(F.min("level").alias("level"), F.count("*").alias("n"))
    t = a.join(b, ["doc_id", "key"], "full")
    problems = F.array_compact(F.array(F.when(F.col("level").isNull(), F.lit("missing_in_doc")), F.when(F.col("level") != F.col("toc_level"), F.lit("level_mismatch")), F.when(F.col("n") > 1, F.lit("duplicate"))))
    return t.select("doc_id", "key", F.explode(problems).alias("problem"))


def pervasive(checked: DataFrame, share: float = 0.15) -> DataFrame:
    """doc_id, affected_percentage, pervasive_flag from (doc_id, affected)."""
    part = F.count_if("affected") / F.count("*")
    return checked.groupBy("doc_id").agg(F.round(100 * part, 2).alias("affected_percentage"), (part > share).alias("pervasive_flag"))


def table_signal(markers: DataFrame, header_sig: str, row_sig: str) -> DataFrame:
    """doc_id, page_no, headers, rows, likelihood, detected from counts of header and row markers of a page."""
    g = markers.groupBy("doc_id", "page_no").agg(F.count_if(F.col("sig") == header_sig).alias("headers"), F.count_if(F.col("sig") == row_sig).alias("rows"))
    score = F.when(F.col("headers") > 0, 40).otherwise(0) + F.least(F.lit(30), 10 * F.col("rows")) + F.least(F.lit(20), 3 * F.col("rows"))
    g = g.withColumn("likelihood", score.cast("long"))
    return g.withColumn("detected", (F.col("likelihood") >= 60) & (F.col("headers") > 0) & (F.col("rows") >= 2))


def overall_rating(scores: DataFrame) -> DataFrame:
    """doc_id, overall: the rounded mean of step scores, 1 to 5."""
    return scores.groupBy("doc_id").agg(F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.avg("score"), 0).cast("int"))).alias("overall"))


def top_issues(issues: DataFrame, n: int = 3) -> DataFrame:
    """The n gravest issues of a document (high, medium, low; then in order)."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    t = issues.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "ord")))
    return t.where(F.col("rank") <= n)
