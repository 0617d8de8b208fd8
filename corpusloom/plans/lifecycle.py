"""Conversion in phases over a whole corpus: each phase writes its tables, a later run goes on from the last one written.

A phase is a function of the run that returns tables by name. A row of its first table with a non-null ``error`` is a
document that failed: it is recorded and takes no part in later phases, and the others go on. Only a failure of the
phase itself stops a run, and it is recorded too.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cleaning, fonts, intake, marking, quality, rendering, structure
from corpusloom.operators import runs as R
from corpusloom.sources import artifacts, decoding

Tables = dict[str, DataFrame]
RESULTS = "doc_id long, phase int, status string, message string"
STATE = "phase int, status string, message string, started timestamp, seconds double"


@dataclass(frozen=True)
class Phase:
    number: int
    name: str
    run: Callable[[Run], Tables]


class Registry:
    """Phases by number: each once, within 0 and 10."""

    def __init__(self, phases: list[Phase] = ()):
        self.phases: dict[int, Phase] = {}
        for p in phases:
            self.add(p)

    def add(self, phase: Phase) -> None:
        if not 0 <= phase.number < R.PHASES:
            raise ValueError(f"phase {phase.number} is out of range")
        if phase.number in self.phases:
            raise ValueError(f"phase {phase.number} is there already")
        self.phases[phase.number] = phase

    @property
    def complete(self) -> bool:
        return len(self.phases) == R.PHASES

    def __iter__(self):
        return iter(self.phases[n] for n in sorted(self.phases))


class Run:
    """One run over the decoded documents at ``root``. ``toc``, ``images``, ``tables`` and ``rules`` may add to what decoding gave."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, rules: DataFrame | None = None, tables: DataFrame | None = None, keywords: tuple[str, ...] = ()):
        self.spark, self.root, self.registry, self.rules, self.tables, self.keywords = spark, root.rstrip("/"), registry or default_phases(), rules, tables, keywords

    # -- tables ------------------------------------------------------------------------------------------

    def table(self, name: str, phase: int) -> DataFrame:
        return artifacts.read_phase(self.spark, f"{self.root}/{name}", phase)

    def done(self) -> list[int]:
        """Phases whose results, and texts if they make them, are all written; what a phase left half written is not among them."""
        texts = set(artifacts.phases_written(self.spark, f"{self.root}/text"))
        made = {n for n in artifacts.PHASE_TEXTS if n in self.registry.phases and self.registry.phases[n].run in TEXT_MAKERS}
        return [n for n in artifacts.phases_written(self.spark, f"{self.root}/results") if n not in made or n in texts]

    def results(self) -> DataFrame:
        out = self.spark.createDataFrame([], RESULTS)
        for n in self.done():
            out = out.unionByName(self.table("results", n))
        return out

    def states(self) -> DataFrame:
        out = self.spark.createDataFrame([], STATE)
        for n in artifacts.phases_written(self.spark, f"{self.root}/state"):
            out = out.unionByName(self.table("state", n))
        return out

    def alive(self, table: DataFrame, phase: int) -> DataFrame:
        """Rows of documents that no earlier phase failed on."""
        done = [n for n in self.done() if n < phase]
        for n in done:
            table = table.join(self.table("results", n).where("status = 'error'").select("doc_id"), "doc_id", "left_anti")
        return table

    # -- running -----------------------------------------------------------------------------------------

    def _state(self, phase: int, status: str, message: str, began: float) -> None:
        row = self.spark.createDataFrame([(phase, status, message, time.time() - began)], "phase int, status string, message string, seconds double")
        artifacts.write_phase(row.select("phase", "status", "message", F.timestamp_seconds(F.lit(began)).alias("started"), "seconds"), f"{self.root}/state", phase)

    def one(self, number: int) -> bool:
        """Runs a phase; its tables and results replace those of an earlier run. False if the phase itself failed."""
        phase, began = self.registry.phases[number], time.time()
        self._state(number, "in_progress", "", began)
        try:
            made = phase.run(self)
            main = None
            for name, t in made.items():
                artifacts.write_phase(t, f"{self.root}/{name}", number)
                main = main or name
            found = self.spark.createDataFrame([], RESULTS)
            if main is not None:
                t = self.table(main, number)
                bad = F.max("error") if "error" in t.columns else F.max(F.lit(None).cast("string"))
                t = t.groupBy("doc_id").agg(bad.alias("message"))
                found = t.select("doc_id", F.lit(number).alias("phase"), F.when(F.col("message").isNull(), "success").otherwise("error").alias("status"), F.coalesce("message", F.lit("")).alias("message"))
            artifacts.write_phase(found, f"{self.root}/results", number)
        except Exception as e:  # recorded, so that status and resume see it
            self._state(number, "error", f"{type(e).__name__}: {e}"[:2000], began)
            return False
        self._state(number, "success", "", began)
        return True

    def go(self, start: int = 0, stop: int = R.PHASES - 1) -> bool:
        """Runs phases in order; ends at the first that fails."""
        return all(self.one(p.number) for p in self.registry if start <= p.number <= stop)

    def missing(self, number: int) -> list[int]:
        """Phases that must be there before a phase can run."""
        done = set(self.done())
        return [p.number for p in self.registry if p.number < number and p.number not in done]

    def resume(self) -> bool:
        """Goes on with the first phase whose results, or whose tables' rows, are not all there."""
        left = [p.number for p in self.registry if p.number not in self.done()]
        return self.go(left[0]) if left else True

    def single(self, number: int) -> bool:
        """Runs one phase again; earlier ones must be there."""
        if number not in self.registry.phases:
            raise ValueError(f"phase {number} is not known")
        if need := self.missing(number):
            raise ValueError(f"phase {number} needs phases {need} first")
        return self.one(number)

    def from_step(self, step: str) -> bool:
        """Runs again from the phase that a step (phase.step) belongs to."""
        phase, dot, rest = step.partition(".")
        if not (phase.isdigit() and dot and rest.isdigit()) or int(phase) >= R.PHASES:
            raise ValueError(f"{step!r} is no step")
        if need := self.missing(int(phase)):
            raise ValueError(f"phase {phase} needs phases {need} first")
        return self.go(int(phase))

    def status(self) -> DataFrame:
        """phase, name, state, documents, failed: a row for each phase."""
        names = self.spark.createDataFrame([(p.number, p.name) for p in self.registry], "phase int, name string")
        got = self.results().groupBy("phase").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "error").alias("failed"))
        t = names.join(self.states().select("phase", F.col("status").alias("s"), "message"), "phase", "left").join(got, "phase", "left")
        state = F.when(F.col("s") == "success", "completed").when(F.col("s") == "error", "failed").when(F.col("s").isNotNull(), "in_progress").otherwise("pending")
        return t.select("phase", "name", state.alias("state"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("message", F.lit("")).alias("message")).orderBy("phase")


# -- the phases ---------------------------------------------------------------------------------------------


def _intake(run: Run) -> Tables:
    """``decoded`` must be written below the root before; documents that can't be read, have odd counts or hold no text fail."""
    decoded = run.spark.read.parquet(f"{run.root}/decoded")
    meta = intake.metadata(decoded)
    t = meta.join(intake.violations(meta), "doc_id").join(intake.extractable(decoded), "doc_id").join(decoded.select("doc_id", "path", F.col("error").alias("_e")), "doc_id")
    error = F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.size("violations") > 0, F.array_join("violations", "; ")).when(~F.col("text_extractable"), "Scanned PDF detected - very little extractable text")
    report = intake.preflight(meta, t.select("doc_id", "text_extractable"))
    return {"metadata": t.withColumn("error", error).drop("_e", "violations"), "preflight": report}


def _decoded(run: Run, phase: int) -> DataFrame:
    return run.alive(run.spark.read.parquet(f"{run.root}/decoded"), phase)


def _images(run: Run) -> Tables:
    return {"images": decoding.images(_decoded(run, 1))}


def _cover(run: Run) -> Tables:
    return {"covered": decoding.image_rects(_decoded(run, 2))}


def _signatures(run: Run) -> Tables:
    d = _decoded(run, 3)
    spans = decoding.spans(d)
    sigs = fonts.signatures(spans)
    pages = d.select("doc_id", F.size("pages").alias("pages"))
    matched = fonts.tolerant(spans, sigs)
    footers = fonts.footer_classes(matched, pages, F.col("page_height"))
    return {"signatures": sigs, "outline": decoding.outline(d), "footers": footers, "icons": fonts.icon_signatures(matched, sigs)}


def _marked(run: Run) -> Tables:
    found = marking.runs(fonts.with_signature(decoding.spans(_decoded(run, 4)), run.table("signatures", 3)))
    return {"runs": found, "text": marking.with_page_markers(marking.marked_lines(found))}


def _characters(run: Run) -> Tables:
    sigs, found = run.table("signatures", 3), run.table("runs", 4)
    classes, icons = run.table("footers", 3), run.table("icons", 3)
    # Documents without classes fall back to what is known by name alone.
    without = lambda t, known: t.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    gone = fonts.footer_ids(classes).union(without(fonts.plain_footers(sigs), classes)).union(icons.select("doc_id", "sig")).union(without(fonts.plain_icons(sigs), icons)).distinct()
    kept = cleaning.drop_signatures(found.where("sig is not null"), gone).select(*found.columns).unionByName(found.where("sig is null"))
    lines = marking.with_page_markers(marking.marked_lines(kept))
    lines = cleaning.drop_page_numbers(lines, fonts.page_number_ids(sigs))
    lines = cleaning.squeeze_lines(cleaning.drop_blank_markers(lines.withColumn("line", cleaning.wrap_marked(F.col("line")))))
    lines = cleaning.merge_paragraphs(lines).select("doc_id", "line_no", X.fix_typography(X.fix_spacing(F.col("line"))).alias("line"))
    return {"text": lines}


def _structure(run: Run) -> Tables:
    return {"text": run.table("text", 5).withColumn("line", X.normalise_bullet(X.join_hyphens(F.col("line"))))}


def _labels(run: Run) -> Tables:
    sigs, marks = run.table("signatures", 3), marking.markers(run.table("text", 6))
    if run.rules is not None:
        blocks = marks.groupBy("doc_id", F.col("line_no").alias("ord")).agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"))
        held = structure.captured_lines(structure.boundary_capture(blocks, run.rules)).withColumnRenamed("label", "own")
        marks = marks.withColumn("key", X.strip(F.col("text"))).join(held, ["doc_id", "key"], "left").drop("key")
    seen = structure.evidence(marks, structure.NOTE_KEYWORDS + tuple(run.keywords))
    out = structure.labels(sigs, fonts.body_size(sigs), structure.toc_levels(marks, run.table("outline", 3)), seen)
    return {"labels": structure.single_top(out)}


def _rendered(run: Run) -> Tables:
    ends = run.spark.createDataFrame([], "label string, end_text string") if run.rules is None else run.rules.select("label", "end_text")
    stated = rendering.callout_state(rendering.first_label(run.table("text", 6), run.table("labels", 7)), ends)
    lines = rendering.place_images(rendering.render(stated), run.table("images", 1))
    if run.tables is not None:
        lines = rendering.place_tables(lines, run.tables)
    return {"text": lines, "callouts": rendering.unclosed_callouts(stated), "headings": rendering.counts(stated)}


def _linted(run: Run) -> Tables:
    lines = run.table("text", 8)
    found = quality.lint(lines)
    heads = quality.headings(lines)
    return {"lint": found, "summary": quality.lint_summary(found), "hierarchy": quality.hierarchy(heads), "gaps": quality.toc_gaps(run.table("outline", 3), heads)}


def _report(run: Run) -> Tables:
    results, states = run.results(), run.states()
    warned = run.table("callouts", 8).select("doc_id", F.lit(8).alias("phase"), F.concat(F.lit("Callout '"), "callout", F.lit("' reached end of document without explicit end_text marker")).alias("w"))
    lint = run.table("summary", 9).where("status = 'warning'").select("doc_id", F.lit(9).alias("phase"), F.concat(F.col("n_issues").cast("string"), F.lit(" lint issues: "), "rules").alias("w"))
    w = warned.union(lint).groupBy("doc_id", "phase").agg(F.array_sort(F.collect_list("w")).alias("warnings"))
    none = F.array().cast("array<string>")
    t = results.join(states.select("phase", "started", "seconds"), "phase").join(w, ["doc_id", "phase"], "left")
    t = t.withColumn("warnings", F.coalesce("warnings", none)).withColumn("errors", F.when(F.col("status") == "error", F.array("message")).otherwise(none))
    meta = run.table("metadata", 0).select("doc_id", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), F.nullif("title", F.lit("")).alias("title"), F.nullif("author", F.lit("")).alias("author"), "page_count")
    return {"report": R.report(t, meta, R.phase_table(run.spark)), "final": rendering.documents(run.table("text", 8))}


TEXT_MAKERS = (_marked, _characters, _structure, _rendered)


def default_phases() -> Registry:
    work = (_intake, _images, _cover, _signatures, _marked, _characters, _structure, _labels, _rendered, _linted, _report)
    return Registry([Phase(n, name, f) for (n, name, _), f in zip(R.PHASE_FILES, work)])
