"""Run records: phases, status, resumption, history, reports, and the hand-off to external agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.quality import base_step

PHASES = 11
SEVERITY = {"success": 0, "warning": 1, "error": 2}


def severity(status: Column) -> Column:
    return F.when(status == "error", 2).when(status == "warning", 1).otherwise(0)


def phase_status(steps: DataFrame) -> DataFrame:
    """doc_id, phase, status (the gravest of its steps), n_steps."""
    worst = F.max(severity(F.col("status")))
    return steps.groupBy("doc_id", "phase").agg(F.when(worst == 2, "error").when(worst == 1, "warning").otherwise("success").alias("status"), F.count("*").alias("n_steps"))


def status_table(results: DataFrame) -> DataFrame:
    """doc_id, completed, next_phase, state of each run: phases count up to the first that isn't complete."""
    ok = results.where("status <> 'error'").groupBy("doc_id").agg(F.array_sort(F.collect_set("phase")).alias("done"))
    docs = results.select("doc_id").distinct().join(ok, "doc_id", "left").withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.lit(PHASES - 1)), "done")
    return docs.select("doc_id", F.size("done").alias("completed"), F.try_element_at(left, F.lit(1)).alias("next_phase"), F.when(F.size(left) == 0, "completed").otherwise("in_progress").alias("state"))


def missing_phases(results: DataFrame, wanted: int) -> DataFrame:
    """doc_id, phase of the phases before ``wanted`` that have no complete result."""
    need = results.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("phase"))
    return need.join(results.where("status <> 'error'"), ["doc_id", "phase"], "left_anti")


def state_violations(states: DataFrame) -> DataFrame:
    """states (current int, completed array<int>, current_step) with what breaks their rules."""
    done = F.col("completed")
    rules = [
        ((F.col("current") < 0) | (F.col("current") >= PHASES), "current phase out of range"),
        (~F.col("current_step").rlike(r"^\d+\.\d+(_p\d+(_t\d+)?)?$"), "step id malformed"),
        (done != F.array_sort(done), "completed phases not sorted"),
        (F.exists(done, lambda p: (p < 0) | (p >= PHASES)), "completed phase out of range"),
        (F.coalesce(F.array_max(done) >= F.col("current"), F.lit(False)), "completed phase not before the current"),
    ]
    return states.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])))


def recent(history: DataFrame, key: list[str], at: str, owner: list[str], keep: int = 20) -> DataFrame:
    """The latest row of each key (of equal times the one with the least other columns), the newest ``keep`` of each owner."""
    rest = [c for c in history.columns if c not in (*key, *owner, at)]
    last = history.withColumn("_n", F.row_number().over(Window.partitionBy(*owner, *key).orderBy(F.desc(at), *rest))).where("_n = 1").drop("_n")
    return last.withColumn("position", F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc(at), *key))).where(F.col("position") <= keep)


def latest(results: DataFrame, phase: int | None = None, seq: str = "seq") -> DataFrame:
    """A document's last result (by seq), of one phase or of any."""
    t = results if phase is None else results.where(F.col("phase") == phase)
    return t.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in t.columns if c != "doc_id"]), seq).alias("r")).select("doc_id", "r.*")


#: Names of the phases and the files that each is known by.
PHASE_FILES = (
    (0, "Pre-flight Analysis", "metadata.json"),
    (1, "Image Extraction", "images/*.png, images/image-manifest.json"),
    (2, "Image Removal", "preprocessed/*-no-images.pdf"),
    (3, "TOC & Font Extraction", "toc-extracted.txt, font-family-mapping.json"),
    (4, "Text Extraction", "*-phase4.md (with font markers)"),
    (5, "Character-Level Fixes", "*-phase5.md"),
    (6, "Structural Formatting", "*-phase6.md"),
    (7, "Font Label Assignment", "Updated font-family-mapping.json"),
    (8, "Heading Insertion", "*-final.md"),
    (9, "Lint & Final Review", "Lint report (in conversion-report.md)"),
    (10, "Report Generation", "conversion-report.md, .completion.json, diagnostic-bundle.zip (if enabled)"),
)
#: What each phase changes, and what to look at when checking it.
PHASE_NOTES = (
    ("reads metadata, the outline and the first pages; rates how hard the document is", "the metadata with the properties of the source"),
    ("takes out every image with its place and a placeholder text", "the list of images with the pages"),
    ("covers images, so that text alone is left", "the covered file with the source"),
    ("reads the outline and samples fonts by family, size, weight and style", "the outline with the bookmarks, the signatures with the looks of headings"),
    ("reads text with a marker for each run of one signature, page by page", "the markers with the fonts of headings"),
    ("drops icons, page numbers and running footers; repairs spaces and dashes; joins lines to paragraphs", "the text with that of the phase before"),
    ("joins words cut at line ends, makes bullets and numbers even", "lists and word breaks"),
    ("gives signatures their heading levels and callouts", "the labels in the mapping"),
    ("writes headings, callouts, images and tables as Markdown", "the structure with the source"),
    ("checks the Markdown and has it reviewed", "the findings in the report"),
    ("writes this report and the record of completion", "that every section is there"),
)
PERFORMANCE_FILES = ("`{name}-final.md` - Final converted markdown", "`font-family-mapping.json` - Font signature mapping", "`toc-extracted.txt` - Extracted table of contents", "`images/image-manifest.json` - Image positions")
LICENSE = "Images taken from this document belong to its publisher. They are commented out; do not pass them on or publish them without permission."


def phase_table(spark) -> DataFrame:
    """phase, name, files, changes, compare."""
    return spark.createDataFrame([(*f, *n) for f, n in zip(PHASE_FILES, PHASE_NOTES)], "phase int, name string, files string, changes string, compare string")


def described(results: DataFrame, phases: DataFrame) -> DataFrame:
    """Results with the names and descriptions of their phases; a phase that is not known is called by its number."""
    t = results.join(F.broadcast(phases), "phase", "left")
    none = F.lit("N/A")
    return t.withColumn("name", F.coalesce("name", F.concat(F.lit("Phase "), F.col("phase").cast("string")))).withColumn("files", F.coalesce("files", none)).withColumn("changes", F.coalesce("changes", none)).withColumn("compare", F.coalesce("compare", none))


def report(results: DataFrame, meta: DataFrame, phases: DataFrame) -> DataFrame:
    """doc_id, text: the Markdown report of a run: source, pipeline, phase table, details, performance, warnings, errors, files, licence.

    ``results``: doc_id, phase, status, started (timestamp), seconds, warnings, errors (arrays); ``meta``: doc_id, name, title,
    author, page_count. Sections of warnings and errors are there only where there are some."""
    n = F.col("phase").cast("string")
    done = F.col("status") != "error"
    t = described(results, phases)
    t = t.withColumn("row", F.concat(F.lit("| "), n, F.lit(" | "), "name", F.lit(" | "), "files", F.lit(" |"))).withColumn("detail", F.concat(F.lit("### Phase "), n, F.lit(": "), "name", F.lit("\n\n**Output Files:** "), "files", F.lit("\n\n**Changes Made:**\n"), "changes", F.lit("\n\n**What to Compare:**\n"), "compare", F.lit("\n")))
    listed = lambda c: F.concat(F.lit("- "), F.array_join(c, "\n- "))
    t = t.withColumn("warned", F.when(F.size("warnings") > 0, listed(F.col("warnings")))).withColumn("failed", F.when(F.size("errors") > 0, listed(F.col("errors"))))
    agg = lambda c, sep, when=None: F.expr(f"listagg({f'case when {when} then {c} end' if when else c}, '{sep}') WITHIN GROUP (ORDER BY phase)")
    t = t.withColumn("p", n).withColumn("done", done)
    g = t.groupBy("doc_id").agg(agg("p", ", ", "done").alias("phases"), agg("row", "\n", "done").alias("rows"), agg("detail", "\n", "done").alias("details"), agg("warned", "\n").alias("warned"), agg("failed", "\n").alias("failed"), F.min("started").alias("began"), F.sum("seconds").alias("seconds"))
    g = g.join(meta, "doc_id", "left")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    end = F.timestamp_add("SECOND", F.col("seconds").cast("int"), F.col("began"))
    known = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    text = F.concat(
        F.lit("# PDF Conversion Report\n\n**Source:** "), known("title", "Unknown"), F.lit("\n**Author:** "), known("author", "Unknown"), F.lit("\n**Pages:** "), known("page_count", "0"), F.lit("\n**Converted:** "), F.date_format(end, "yyyy-MM-dd"),
        F.lit("\n\n## Pipeline Summary\n\nCompleted Phases: "), known("phases", ""),
        F.lit("\n\n## Phase Summary\n\n| Phase | Name | Output Files |\n|-------|------|--------------|\n"), known("rows", ""),
        F.lit("\n\n## Phase Details\n\n"), known("details", ""),
        F.lit("\n## Performance\n\n**Conversion Started:** "), at(F.col("began")), F.lit("\n**Conversion Completed:** "), at(end), F.lit("\n**Total Duration:** "), X.duration(F.col("seconds")), F.lit("\n"),
        F.coalesce(F.concat(F.lit("\n## Warnings\n\n"), "warned", F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n## Errors\n\n"), "failed", F.lit("\n")), F.lit("")),
        F.lit("\n## Output Files\n\n"), F.replace(F.lit("- " + "\n- ".join(PERFORMANCE_FILES)), F.lit("{name}"), known("name", "")),
        F.lit(f"\n\n## License Notice\n\n{LICENSE}\n"),
    )
    return g.select("doc_id", text.alias("text"))


# -- errors ------------------------------------------------------------------------------------------------

#: Exit codes, and the codes of errors with their message and exit code.
EXIT = {"success": 0, "user_abort": 1, "file_error": 2, "pdf_error": 3, "state_error": 4, "dependency_error": 5}
ERRORS = (
    ("PDF_NOT_FOUND", "ERROR", "Cannot open PDF - file not found or corrupted", "file_error"),
    ("SCANNED_PDF", "ERROR", "Scanned PDF detected - very little extractable text", "pdf_error"),
    ("USER_CANCELLED", "ABORT", "User cancelled after pre-flight report", "user_abort"),
    ("OUTPUT_DIR_ERROR", "ERROR", "Cannot create output directory - check permissions", "file_error"),
    ("TEXT_PDF_ERROR", "ERROR", "Failed to create text-only PDF", "pdf_error"),
    ("NO_TEXT", "ERROR", "No text extracted from PDF", "pdf_error"),
    ("PHASE_INPUT_MISSING", "ERROR", "Phase input file not found - run previous phase first", "state_error"),
    ("FONT_MAPPING_ERROR", "ERROR", "font-family-mapping.json not found or malformed", "state_error"),
    ("PDF_PERMISSION", "ERROR", "Cannot read PDF - permission denied", "file_error"),
    ("PDF_ENCRYPTED", "ERROR", "PDF is encrypted or password-protected. Please provide an unprotected PDF", "pdf_error"),
    ("STATE_MISSING", "ERROR", "Cannot resume - state file missing or corrupt", "state_error"),
    ("STATE_CORRUPT", "ERROR", "State file is corrupted", "state_error"),
    ("DISK_FULL", "ERROR", "Disk full - cannot write output file. Free up space and resume", "file_error"),
)
#: Words of a message that tell the exit code of an error without a code, in this order.
EXIT_WORDS = (("file_error", ("permission", "not found", "cannot open")), ("pdf_error", ("pdf", "scanned", "extracted", "encrypted")), ("state_error", ("state", "resume", "phase input", "output")), ("dependency_error", ("installation", "module")))


def explained(errors: DataFrame) -> DataFrame:
    """errors (code, message, context) with ``text`` to show and ``exit_code``: by the code, else by words of the message, else a file error."""
    table = errors.sparkSession.createDataFrame([(c, p, m, EXIT[e]) for c, p, m, e in ERRORS], "code string, prefix string, known string, known_exit int")
    t = errors.join(F.broadcast(table), "code", "left").withColumn("prefix", F.coalesce("prefix", F.lit("ERROR")))
    low = F.lower("message")
    by_words = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(EXIT[name])) for name, words in EXIT_WORDS], F.lit(EXIT["file_error"]))
    text = F.concat("prefix", F.lit(": "), F.coalesce("known", "message", F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.nullif("context", F.lit("")), F.lit(")")), F.lit("")))
    return t.withColumn("text", text).withColumn("exit_code", F.coalesce("known_exit", by_words)).select(*errors.columns, "text", "exit_code")


def requests(inputs: DataFrame) -> DataFrame:
    """(doc_id, step_id, payload json) with a hash of the payload, by which an answer is known to be fresh."""
    return inputs.withColumn("input_hash", F.sha2("payload", 256))


def matched_outputs(asked: DataFrame, outputs: DataFrame) -> DataFrame:
    """Requests with state: ready (an answer to this very payload), stale (to another), awaiting (none)."""
    o = outputs.groupBy("doc_id", "step_id").agg(F.max_by(F.struct("input_hash", "status"), "attempt").alias("o"), F.max("attempt").alias("attempt"))
    t = asked.join(o, ["doc_id", "step_id"], "left")
    state = F.when(F.col("o").isNull(), "awaiting").when((F.col("o.input_hash") == F.col("input_hash")) | (base_step(F.col("step_id")) == "4.5"), "ready").otherwise("stale")
    return t.select(*asked.columns, F.coalesce("attempt", F.lit(0)).alias("attempt"), F.col("o.status").alias("status"), state.alias("state"))


def retry_policy(judged: DataFrame, steps: DataFrame, attempts: int = 3) -> DataFrame:
    """What follows from (step_id, attempt, passed): done, retry, or by criticality failed, flagged or skipped."""
    t = judged.withColumn("step", base_step(F.col("step_id"))).join(F.broadcast(steps), "step", "left")
    end = F.when(F.col("criticality") == "high", "failed").when(F.col("criticality") == "medium", "flagged").otherwise("skipped")
    return t.select(*judged.columns, F.when(F.col("passed"), "done").when(F.col("attempt") < attempts, "retry").otherwise(end).alias("action"))


def warning_rollup(results: DataFrame) -> DataFrame:
    """doc_id, messages (in order, each with its phase, joined by a bar), n."""
    t = results.select("doc_id", "phase", "ord", F.explode("warnings").alias("w")).withColumn("m", F.concat(F.lit("Phase "), F.col("phase").cast("string"), F.lit(": "), "w"))
    return t.groupBy("doc_id").agg(F.expr("listagg(m, '|') WITHIN GROUP (ORDER BY phase, ord)").alias("messages"), F.count("*").alias("n"))
