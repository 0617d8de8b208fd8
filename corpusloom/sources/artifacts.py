"""Artefacts of a conversion: JSON records, phase texts, state, logs and bundles, kept as tables and written as files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import json_or_empty

#: Schemas of the records that phases leave; numbers that older records hold as text are cast when read.
SCHEMAS = {
    "mapping": "doc_id long, signatures array<struct<id: string, family: string, size: double, weight: string, style: string, frequency: long, samples: array<string>, candidate_heading: boolean, suggested_level: string, label: string>>",
    "metadata": "doc_id long, title string, author string, creator string, producer string, copyright string, page_count int, file_size_bytes long, has_toc boolean, toc_entries int, toc_max_depth int, image_count int, font_count int, extracted_at string, creation_date string, modification_date string",
    "state": "doc_id long, version string, pdf_path string, output_dir string, started_at string, updated_at string, current_phase int, current_step string, completed_phases array<int>, status string, error struct<phase: int, step: string, code: string, message: string, recoverable: boolean, suggestion: string>, diagnostics_enabled boolean, agent_step_status string, attempt int",
    "footers": "doc_id long, watermark_signatures array<struct<sig_id: string, confidence: string>>, page_number_signatures array<struct<sig_id: string, confidence: string>>, footer_signatures array<struct<sig_id: string, confidence: string>>",
    "icons": "doc_id long, icon_signatures array<struct<sig_id: string, family: string, confidence: string>>",
    "callouts": "doc_id long, rules array<struct<label: string, start_text: string, end_text: string>>",
    "images": "doc_id long, images array<struct<page: int, filename: string, alt_text: string, position: struct<x: double, y: double, width: double, height: double>>>, total_count int",
    "tables": "doc_id long, tables array<struct<table_id: string, page_number_1based: int, bbox_pixels: struct<x0: int, y0: int, x1: int, y1: int>, page_image: string>>, total_count int",
    "completion": "doc_id long, completed_at string, total_phases int, warnings_count int, errors_count int",
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Records of a kind; a missing file is an empty table, a malformed one a row of nulls."""
    return json_or_empty(spark, path, SCHEMAS[kind])


def signatures_of(mapping: DataFrame) -> DataFrame:
    """Signature rows of mapping records; a level may be a number or a label such as H1."""
    t = mapping.select("doc_id", F.posexplode("signatures").alias("n", "s")).select("doc_id", (F.col("n") + 1).alias("ord"), F.col("s.id").alias("sig"), "s.*").drop("id")
    return t.withColumn("suggested_level", F.regexp_extract("suggested_level", r"(\d+)", 1).try_cast("int")).withColumn("sample", F.try_element_at("samples", F.lit(1)))


def footer_rows(footers: DataFrame) -> DataFrame:
    """doc_id, sig, category, confidence of footer records."""
    out = None
    for name in ("watermark", "page_number", "footer"):
        t = footers.select("doc_id", F.explode(f"{name}_signatures").alias("s")).select("doc_id", F.col("s.sig_id").alias("sig"), F.lit(name).alias("category"), F.col("s.confidence").alias("confidence"))
        out = t if out is None else out.union(t)
    return out.where("sig is not null")


def rule_rows(callouts: DataFrame) -> DataFrame:
    """doc_id, ord, label (callout_gm if it is missing), start_text, end_text of callout rules."""
    t = callouts.select("doc_id", F.posexplode("rules").alias("ord", "r"))
    return t.select("doc_id", "ord", F.coalesce("r.label", F.lit("callout_gm")).alias("label"), "r.start_text", "r.end_text")


def image_records(images: DataFrame) -> DataFrame:
    """The image manifest of each document, images in page order."""
    g = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "img_index", "filename", "alt_text", "position"))).alias("i"))
    return g.select("doc_id", F.transform("i", lambda x: F.struct(x["page"].alias("page"), x["filename"].alias("filename"), x["alt_text"].alias("alt_text"), x["position"].alias("position"))).alias("images"), F.size("i").alias("total_count"))


def mapping_records(sigs: DataFrame) -> DataFrame:
    """The mapping record of each document from its signature rows."""
    label = F.col("label") if "label" in sigs.columns else F.lit(None).cast("string")
    s = F.struct("ord", F.col("sig").alias("id"), "family", "size", "weight", "style", "frequency", F.array("sample").alias("samples"), "candidate_heading", F.col("suggested_level").cast("string").alias("suggested_level"), label.alias("label"))
    g = sigs.groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    keep = ("id", "family", "size", "weight", "style", "frequency", "samples", "candidate_heading", "suggested_level", "label")
    return g.select("doc_id", F.transform("s", lambda x: F.struct(*[x[k].alias(k) for k in keep])).alias("signatures"))


def footer_records(classes: DataFrame) -> DataFrame:
    """The footer record of each document from its classes."""
    kinds = ("watermark", "page_number", "footer")
    lists = [F.array_sort(F.collect_list(F.when(F.col("category") == k, F.struct(F.col("sig").alias("sig_id"), "confidence")))).alias(f"{k}_signatures") for k in kinds]
    return classes.groupBy("doc_id").agg(*lists)


def completion_records(results: DataFrame, at: str) -> DataFrame:
    """doc_id, completed_at, total_phases, warnings_count, errors_count from phase results (warnings and errors are arrays)."""
    return results.groupBy("doc_id").agg(F.lit(at).alias("completed_at"), F.count("*").cast("int").alias("total_phases"), F.sum(F.size("warnings")).cast("int").alias("warnings_count"), F.sum(F.size("errors")).cast("int").alias("errors_count"))


def as_json(records: DataFrame) -> DataFrame:
    """doc_id, json: a record as one JSON text, fields by name."""
    return records.select("doc_id", F.to_json(F.struct(*sorted(c for c in records.columns if c != "doc_id")), {"ignoreNullFields": "false"}).alias("json"))


def write_json(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one for each document."""
    records.write.mode("overwrite").json(path)


# -- phase texts and state: one partition a phase, so that one phase can be written again ------------------


def write_phase(table: DataFrame, root: str, phase: int) -> None:
    """Replaces the rows of one phase; other phases stay. A phase is there for readers only when it is all written."""
    table.write.mode("overwrite").parquet(f"{root}/phase={phase}")


def phases_written(spark: SparkSession, root: str) -> list[int]:
    """The phases whose rows are all there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("phase=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_phase(spark: SparkSession, root: str, phase: int) -> DataFrame:
    return spark.read.parquet(f"{root}/phase={phase}")


def export_texts(documents: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """A folder for each document name with its text, for readers outside."""
    documents.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


# -- logs and bundles -----------------------------------------------------------------------------------

#: Marks of a step's status in the log, and the files of a bundle.
MARKS = {"success": "✓", "warning": "⚠", "error": "✗", "skipped": "⏸"}
BUNDLE = (".state.json", "metadata.json", "font-family-mapping.json", "toc-extracted.txt", "images/image-manifest.json", "conversion-report.md", "conversion.log")
PHASE_TEXTS = (4, 5, 6, 8)
RULE = "─" * 57


def log_entries(steps: DataFrame) -> DataFrame:
    """doc_id, text: a log of phases and their steps (doc_id, phase, name, started, step_id, ord, description, status, message, duration_ms)."""
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.col("status")], F.lit("▶"))
    entry = F.concat(F.lit("  "), mark, F.lit(" Step "), "step_id", F.lit(": "), "description", F.lit("\n    Status: "), F.upper("status"), F.lit("\n    Message: "), F.coalesce(F.nullif("message", F.lit("")), F.lit("N/A")), F.lit("\n    Duration: "), F.coalesce(F.col("duration_ms").cast("string"), F.lit("None")), F.lit("ms\n\n"))
    head = F.concat(F.lit(f"{RULE}\n  Phase "), F.col("phase").cast("string"), F.lit(": "), "name", F.lit("\n  Started: "), "started", F.lit(f"\n{RULE}\n\n"))
    t = steps.withColumn("entry", entry).groupBy("doc_id", "phase").agg(F.max(head).alias("head"), F.expr("listagg(entry, '') WITHIN GROUP (ORDER BY ord)").alias("body"))
    return t.withColumn("part", F.concat("head", "body")).groupBy("doc_id").agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY phase)").alias("text"))


def wanted_files(documents: DataFrame) -> DataFrame:
    """doc_id, file: the files that belong in a document's bundle (doc_id, name)."""
    texts = [F.concat("name", F.lit(f"-phase{n}.md")) for n in PHASE_TEXTS]
    return documents.select("doc_id", F.explode(F.array(*[F.lit(f) for f in BUNDLE], *texts)).alias("file"))


def bundled(files: DataFrame, documents: DataFrame) -> DataFrame:
    """The files (doc_id, file, ...) that are wanted."""
    return files.join(wanted_files(documents), ["doc_id", "file"], "left_semi")


def bundles(files: DataFrame, documents: DataFrame, arguments: str = "") -> DataFrame:
    """doc_id, content: a zip of each document's wanted files (doc_id, file, content) and of the command's arguments."""

    def pack(t: pa.Table) -> pa.Table:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(t["file"].to_pylist(), t["content"].to_pylist())):
                z.writestr(name, content or b"")
            z.writestr("cli-args.txt", arguments)
        return pa.table({"doc_id": t["doc_id"].slice(0, 1), "content": pa.array([buf.getvalue()], pa.binary())})

    return bundled(files.select("doc_id", "file", "content"), documents).groupBy("doc_id").applyInArrow(pack, "doc_id long, content binary")
