"""Work for external agents: payloads, instructions, contracts, gates, and what can be repaired without one.

A step's payload is a JSON text made by one expression, so requests for a whole corpus are one projection.
Answers come back as rows (see ``runs.matched_outputs``); an agent itself is a plug-in (``dispatch``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import layout
from corpusloom.operators.quality import RUBRICS, base_step
from corpusloom.operators.structure import DOMAIN_TERMS
from corpusloom.sources.decoding import by_plugin

#: The task that each step's payload names, and the context fields that it takes from its inputs.
TASKS = {
    "3.2": ("parse_visual_toc", ("toc_text", "total_pages")),
    "4.5": ("resolve_split_sentences", ("chunk_boundaries",)),
    "6.4": ("fix_ocr_spelling", ("font_signatures", "preserve_terms")),
    "9.2": ("assess_structural_clarity", ("toc_file",)),
    "9.3": ("assess_text_flow", ()),
    "9.4": ("check_table_integrity", ("tables_manifest",)),
    "9.5": ("check_callout_formatting", ("gm_callout_config",)),
    "9.7": ("validate_toc", ("toc_file",)),
    "9.8": ("review_reading_order", ("pdf_metadata",)),
    "10.2": ("generate_report", ("assessment_results",)),
    "10.3": ("document_issues", ("assessment_results",)),
}
REPAIRS, REVIEWS, REPORTS = ("3.2", "4.5", "6.4"), ("9.2", "9.3", "9.4", "9.5", "9.7", "9.8"), ("10.2", "10.3")
#: What each review is called, and those without which a run can't go on.
REVIEW_NAMES = {"9.2": "Structural clarity assessment", "9.3": "Text flow assessment", "9.4": "Table integrity check", "9.5": "Callout formatting check", "9.7": "TOC validation", "9.8": "Reading order review"}
#: Command lines of agents. Those with ``stdin`` read the prompt from it.
COMMANDS = {
    "claude": {"cli": "claude", "args": ("--print", "--dangerously-skip-permissions")},
    "codex": {"cli": "codex", "args": ("exec", "--full-auto", "-s", "workspace-write"), "stdin": True},
    "opencode": {"cli": "opencode", "args": ("run",)},
    "gemini": {"cli": "gemini", "args": ()},
    "qwen": {"cli": "qwen", "args": ()},
}
EMPTY = "struct<>"


def contract(step: str) -> str:
    return f"schemas/step_{step.replace('.', '_')}.schema.json"


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]) if fields else F.from_json(F.lit("{}"), "struct<_none: string>")


def payload(step: str, workspace: Column, context: dict[str, Column] | None = None, phase_file: Column | None = None, font_mapping: Column | None = None) -> Column:
    """The JSON payload of a repair, review or report step. Null context fields stay out, as does a missing font mapping."""
    task, fields = TASKS[step]
    context = context or {}
    inputs: dict[str, Column] = {}
    if step in REPAIRS:
        inputs = {"phase_file": F.coalesce(phase_file, F.lit("")) if phase_file is not None else F.lit("")}
    elif step in REVIEWS:
        inputs = {"phase8_file": phase_file if phase_file is not None else F.lit("")}
    known = {f: context[f] for f in fields if f in context}
    optional = {"font_family_mapping": font_mapping} if step == "9.7" and font_mapping is not None else {}
    body = {"step_id": F.lit(step), "input_artifacts": _struct(inputs), "optional_artifacts": _struct(optional), "context": _struct({"workspace": workspace, **known, "task": F.lit(task)}), "output_contract": F.lit(contract(step))}
    return F.to_json(_struct(body))


def scan_payload(source: Column, page: Column, text: Column, workspace: Column, dpi: int = 150) -> Column:
    """Payload of the first pass of table detection: a page's text."""
    image = F.concat(workspace, F.format_string("/page_images/page_%03d.png", page.cast("int")))
    return F.to_json(_struct({"step_id": F.lit("7.7"), "output_contract": F.lit(contract("7.7")), "source_pdf": source, "page_number_1based": page.cast("int"), "extracted_text": text, "dpi": F.lit(dpi), "page_image": image, "phase": F.lit("text_scan")}))


def vision_payload(source: Column, page: Column, table_id: Column, context: Column, workspace: Column) -> Column:
    """Payload of the second pass: one table that the first pass named."""
    image = F.concat(workspace, F.format_string("/page_images/page_%03d.png", page.cast("int")))
    return F.to_json(_struct({"step_id": F.lit("7.7"), "output_contract": F.lit(contract("7.7")), "source_pdf": source, "page_number_1based": page.cast("int"), "page_image": image, "table_id": table_id, "text_context": F.coalesce(context, F.lit("")), "phase": F.lit("vision_confirmation")}))


def conversion_payload(table_id: Column, page: Column, box: Column, image: Column, flat_text: Column, workspace: Column, dpi: int = 150) -> Column:
    """Payload of a table's conversion to Markdown."""
    crop = F.concat(workspace, F.lit("/table_crops/"), table_id, F.lit("_crop.png"))
    return F.to_json(_struct({"step_id": F.lit("8.7"), "output_contract": F.lit(contract("8.7")), "table_id": table_id, "page_number_1based": page.cast("int"), "dpi": F.lit(dpi), "page_image": image, "table_crop_image": crop, "bbox_pixels": box, "flat_text_file": flat_text, "table_slug": table_id}))


# -- requests and the table loop --------------------------------------------------------------------------


def scan_requests(pages: DataFrame, workspace: str) -> DataFrame:
    """doc_id, step_id, payload: a request for each page (doc_id, page_no, text, path)."""
    return pages.select("doc_id", F.concat(F.lit("7.7_p"), F.col("page_no").cast("string")).alias("step_id"), scan_payload(F.col("path"), F.col("page_no"), F.col("text"), F.lit(workspace)).alias("payload"))


def vision_requests(scans: DataFrame, workspace: str) -> DataFrame:
    """doc_id, step_id, payload, table_id: a request for each table that an answer to a page's scan found.

    ``scans`` has doc_id, step_id, path and data, the answer's JSON."""
    t = scans.where(F.get_json_object("data", "$.tables_detected") == "true")
    tables = F.from_json(F.get_json_object("data", "$.tables"), "array<struct<table_id: string, text_context: string>>")
    t = t.select("doc_id", "step_id", "path", F.posexplode(tables).alias("n", "t"))
    page = F.regexp_extract("step_id", r"_p(\d+)", 1).cast("int")
    return t.select("doc_id", F.concat("step_id", F.lit("_t"), (F.col("n") + 1).cast("string")).alias("step_id"), vision_payload(F.col("path"), page, F.col("t.table_id"), F.col("t.text_context"), F.lit(workspace)).alias("payload"), F.col("t.table_id").alias("table_id"), page.alias("page"))


def confirmed_tables(asked: DataFrame, answers: DataFrame, workspace: str) -> DataFrame:
    """doc_id, table_id, page, bbox_pixels, page_image of the tables whose box an answer (doc_id, step_id, data) gives."""
    box = "struct<x0: int, y0: int, x1: int, y1: int>"
    top = F.from_json(F.get_json_object("data", "$.bbox_pixels"), box)
    rows = F.from_json(F.get_json_object("data", "$.tables"), f"array<struct<table_id: string, bbox_pixels: {box}>>")
    rows = F.transform(rows, lambda t: F.struct(t["table_id"].alias("table_id"), t["bbox_pixels"].alias("bbox")))
    t = asked.join(answers.select("doc_id", "step_id", "data"), ["doc_id", "step_id"])
    t = t.withColumn("bbox_pixels", layout.confirmed_box(top, rows, F.col("table_id"))).where("bbox_pixels is not null")
    return t.select("doc_id", "table_id", "page", "bbox_pixels", F.concat(F.lit(workspace), F.format_string("/page_images/page_%03d.png", "page")).alias("page_image"))


def manifest(tables: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, tables, total_count: the tables of each document, an empty list where there is none."""
    row = F.struct("page", "table_id", F.struct("table_id", F.col("page").alias("page_number_1based"), "bbox_pixels", "page_image").alias("t"))
    g = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("g"))
    t = documents.select("doc_id").join(g, "doc_id", "left")
    found = F.transform("g", lambda x: x["t"])
    return t.select("doc_id", F.coalesce(F.to_json(found), F.lit("[]")).alias("tables"), F.greatest(F.coalesce(F.size("g"), F.lit(0)), F.lit(0)).alias("total_count"))


# -- instructions ------------------------------------------------------------------------------------------

SCAN_PROMPT = """# Step 7.7 (pass 1): does this page hold tables?

Page {page}. Repeated signatures in the markers are rows, others near them are headers.

```
{sample}
```

Answer with tables_detected, table_likelihood (0 to 100) and tables (table_id, text_context, confidence).
"""
VISION_PROMPT = """# Step 7.7 (pass 2): where are the tables?

Picture: {image}. Context: {context}

Answer with tables: table_id, page_number and bbox_pixels (x0, y0, x1, y1), rows and columns of each.
"""


def default_prompts() -> dict[str, str]:
    """A prompt for every step that needs no pass of its own."""
    return {s: f"# Step {s}: {TASKS[s][0].replace('_', ' ')}\n\nRead the payload, do the task, and answer by the contract {contract(s)}. Score yourself from 1 to 5 on: {', '.join(RUBRICS[s])}.\n" for s in TASKS} | {"8.7": f"# Step 8.7: convert the table\n\nAnswer with markdown_table, by the contract {contract('8.7')}.\n"}


def instructions(asked: DataFrame, prompts: dict[str, str] | None = None) -> DataFrame:
    """asked (step_id, payload) with ``instructions``: of its step without page and table suffix; table detection by its pass;
    a general text for other steps. Names in braces are filled from the payload."""
    prompts = default_prompts() if prompts is None else prompts
    step, get = base_step(F.col("step_id")), lambda k: F.get_json_object("payload", f"$.{k}")
    scan = layout.fill_template(F.lit(SCAN_PROMPT), {"page": get("page_number_1based"), "sample": layout.sample_window(F.coalesce(get("extracted_text"), F.lit("")))})
    vision = layout.fill_template(F.lit(VISION_PROMPT), {"image": get("page_image"), "context": get("text_context")})
    known = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv]) if prompts else F.create_map().cast("map<string,string>")
    general = F.concat(F.lit("# Step "), "step_id", F.lit("\n\nComplete the task described in the input file and write output to step-output.json.\n"))
    text = F.when((step == "7.7") & (get("phase") == "text_scan"), scan).when((step == "7.7") & (get("phase") == "vision_confirmation"), vision).otherwise(F.coalesce(F.try_element_at(known, step), general))
    return asked.withColumn("instructions", layout.fill_template(text, {k: get(k) for k in ("step_id", "table_id", "page_image")}))


def write_requests(asked: DataFrame, path: str, attempt: int = 1) -> None:
    """Appends requests, with their payload's hash and instructions, as JSON lines for agents to pick up."""
    t = instructions(asked).withColumn("input_hash", F.sha2("payload", 256)).withColumn("attempt", F.lit(attempt)).withColumn("output_contract", F.concat(F.lit("schemas/step_"), F.replace(base_step(F.col("step_id")), F.lit("."), F.lit("_")), F.lit(".schema.json")))
    t.write.mode("append").json(path)


def stub_answers(asked: DataFrame) -> DataFrame:
    """Made-up successful answers to requests, for runs without any agent."""
    return asked.select("doc_id", "step_id", F.lit(1).alias("attempt"), F.sha2("payload", 256).alias("input_hash"), F.lit("success").alias("status"), F.lit('{"stub": true}').alias("data"), F.array(F.lit("Agent stub mode - output not real")).alias("warnings"))


def command(prompt: str, agent: str = "codex") -> list[str]:
    """The command line that hands a prompt to an agent; ``-`` where it reads the prompt from its input."""
    if agent not in COMMANDS:
        raise ValueError(f"agent {agent!r} is not supported; known are {', '.join(COMMANDS)}")
    c = COMMANDS[agent]
    return [c["cli"], *c["args"], "-" if c.get("stdin") else prompt]


def dispatch(asked: DataFrame, invoke: Callable[[str], str]) -> DataFrame:
    """doc_id, step_id, attempt, input_hash, status, json: what an agent, a function from instructions to the text of an answer, gives for
    each request (doc_id, step_id, payload, instructions); what it raises is a failed answer with the reason as its notes."""

    def work(r):
        out = {"doc_id": r["doc_id"], "step_id": r["step_id"], "attempt": 1, "input_hash": r["input_hash"]}
        try:
            return [out | {"status": "answered", "json": invoke(r["instructions"] + "\n" + r["payload"])}]
        except Exception as e:  # an agent that fails is an answer too
            return [out | {"status": "failed", "json": json.dumps({"step_id": r["step_id"], "status": "failed", "notes": str(e)})}]

    rows = asked.select("doc_id", "step_id", "payload", "instructions", F.sha2("payload", 256).alias("input_hash"))
    return by_plugin(rows, work, "doc_id long, step_id string, attempt int, input_hash string, status string, json string")


# -- contracts and gates -----------------------------------------------------------------------------------

ANSWER = "step_id string, status string, data string, warnings array<string>, notes string, rubric_scores map<string,double>, critical_failures array<string>"


def read_answers(raw: DataFrame) -> DataFrame:
    """raw (doc_id, step_id, json) -> the fields of each answer, with the defaults of those that are missing: the step asked for,
    status unknown, no data, no warnings."""
    t = raw.select("doc_id", F.col("step_id").alias("asked"), "json", F.from_json("json", ANSWER).alias("a"))
    return t.select("doc_id", F.coalesce("a.step_id", "asked").alias("step_id"), F.coalesce("a.status", F.lit("unknown")).alias("status"), F.coalesce("a.data", F.lit("{}")).alias("data"), F.coalesce("a.warnings", F.array().cast("array<string>")).alias("warnings"), "a.notes", "a.rubric_scores", "a.critical_failures")


def contract_violations(raw: DataFrame) -> DataFrame:
    """raw (doc_id, step_id, json) with ``violations``: all that breaks the contract of its step, in a fixed order.

    Every contract asks for step_id, status, data, rubric_scores and warnings, of the right types; a known status; and a whole
    number of 1 to 5 for each dimension of the step's rubric and for no other."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(F.col("v"), p, "variant"))
    t = raw.withColumn("v", F.try_parse_json("json"))
    get = lambda k: F.try_variant_get(F.col("v"), f"$.{k}", "string")
    required = ("step_id", "status", "data", "rubric_scores", "warnings")
    kinds = {k: kind(f"$.{k}") for k in (*required, "notes", "critical_failures")}
    known = F.create_map(*[x for s, d in RUBRICS.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in d]))])
    dims = F.coalesce(F.try_element_at(known, base_step(F.col("step_id"))), F.array().cast("array<string>"))
    scores = F.coalesce(F.try_variant_get(F.col("v"), "$.rubric_scores", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    is_map = F.coalesce(kinds["rubric_scores"].startswith("OBJECT"), F.lit(False))
    whole = F.map_filter(scores, lambda k, x: F.schema_of_variant(x) == "BIGINT")
    number = lambda x: F.try_variant_get(x, "$", "double")
    strings = lambda k: F.coalesce(kinds[k].isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    rules = [
        *[(kinds[k].isNull(), F.lit(f"missing: {k}")) for k in required],
        *[(kinds[k].isNotNull() & (kinds[k] != "STRING"), F.lit(f"not a string: {k}")) for k in ("step_id", "status", "notes")],
        ((kinds["status"] == "STRING") & ~get("status").isin("success", "warning", "failed"), F.lit("unknown status")),
        *[(~kinds[k].startswith("OBJECT"), F.lit(f"not an object: {k}")) for k in ("data", "rubric_scores")],
        *[(~strings(k), F.lit(f"not a list of strings: {k}")) for k in ("warnings", "critical_failures")],
    ]
    fixed = F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    say = lambda what, keys: F.transform(keys, lambda k: F.concat(F.lit(f"{what}: "), k))
    names = F.map_keys(scores)
    parts = F.concat(
        say("missing dimension", F.array_except(dims, names)),
        say("unknown dimension", F.array_sort(F.when(F.size(dims) > 0, F.array_except(names, dims)).otherwise(F.array().cast("array<string>")))),
        say("not a whole number", F.array_sort(F.array_except(F.array_intersect(names, dims), F.map_keys(whole)))),
        say("out of range", F.array_sort(F.map_keys(F.map_filter(whole, lambda k, x: F.array_contains(dims, k) & ((number(x) < 1) | (number(x) > 5)))))),
    )
    found = F.when(F.col("v").isNull(), F.array(F.lit("no JSON"))).otherwise(F.concat(fixed, F.when(is_map, parts).otherwise(F.array().cast("array<string>"))))
    return t.withColumn("violations", found).drop("v")


def with_boundary_score(answers: DataFrame) -> DataFrame:
    """Answers (step_id, data, rubric_scores): a table scan that shows no boundary gets full marks for boundary_accuracy."""
    get = lambda k: F.get_json_object("data", f"$.{k}")
    boxes = F.from_json(get("tables"), "array<struct<bbox_pixels: map<string,double>>>")
    some = F.coalesce(F.exists(boxes, lambda t: F.coalesce(F.size(t["bbox_pixels"]) > 0, F.lit(False))), F.lit(False))
    own = F.coalesce(F.size(F.from_json(get("bbox_pixels"), "map<string,double>")) > 0, F.lit(False))
    needed = F.coalesce(get("tables_detected") == "true", F.lit(False)) | F.coalesce(get("phase") == "vision_confirmation", F.lit(False)) | own | some
    scores = F.col("rubric_scores")
    add = (base_step(F.col("step_id")) == "7.7") & (F.size(scores) > 0) & ~F.map_contains_key(scores, "boundary_accuracy") & ~needed
    kind = answers.schema["rubric_scores"].dataType.valueType.simpleString()
    return answers.withColumn("rubric_scores", F.when(F.coalesce(add, F.lit(False)), F.map_concat(scores, F.create_map(F.lit("boundary_accuracy"), F.lit(5).cast(kind)))).otherwise(scores))


def reviews(documents: DataFrame) -> DataFrame:
    """doc_id, step_id, description, status, message: what becomes of each review of each document.

    ``documents``: doc_id, has_mapping, has_callouts (booleans), n_tables (null without a manifest). ``requested`` goes to an agent;
    the integrity of no tables is a success; a missing manifest or callout table is an error that ends the reviews (later ones
    are not there); a missing font mapping leaves its review out with a warning."""
    steps = F.array(*[F.struct(F.lit(s).alias("step_id"), F.lit(f"{REVIEW_NAMES[s]} (AGENT)").alias("description"), F.lit(i).alias("i")) for i, s in enumerate(REVIEWS)])
    t = documents.select("*", F.explode(steps).alias("s")).select(*documents.columns, "s.*")
    missing = F.when((F.col("step_id") == "9.4") & F.col("n_tables").isNull(), "tables-manifest.json").when((F.col("step_id") == "9.5") & ~F.coalesce("has_callouts", F.lit(False)), "callout-rules.resolved.json")
    skipped = (F.col("step_id") == "9.7") & ~F.coalesce("has_mapping", F.lit(False))
    none = (F.col("step_id") == "9.4") & (F.col("n_tables") == 0)
    status = F.when(missing.isNotNull(), "error").when(none, "success").when(skipped, "warning").otherwise("requested")
    message = F.when(missing.isNotNull(), F.concat(F.lit("Missing required input: "), missing)).when(none, "No tables found in tables-manifest.json; table integrity check skipped (N/A).").when(skipped, "Skipped with flag: required artifact font-family-mapping.json not available").otherwise("")
    t = t.withColumn("status", status).withColumn("message", message)
    ended = F.min(F.when(F.col("status") == "error", F.col("i"))).over(Window.partitionBy("doc_id"))
    t = t.withColumn("_end", ended).where(F.col("_end").isNull() | (F.col("i") <= F.col("_end")))
    return t.select("doc_id", "step_id", "description", "status", "message")


def review_outcomes(answers: DataFrame) -> DataFrame:
    """doc_id, step_id, status, message of answered reviews: their score, or that there was none."""
    rubric = F.coalesce(F.col("rubric_scores"), F.create_map().cast("map<string,double>"))
    score = X.rating(F.get_json_object("data", "$.score").try_cast("double"), rubric)
    some = F.col("status").isin("success", "warning")
    return answers.select("doc_id", "step_id", F.when(some, "success").otherwise("warning").alias("status"), F.when(some, F.concat(F.lit("Score: "), score.cast("string"), F.lit("/5"))).otherwise("Agent step returned no envelope.").alias("message"))


def assessments(steps: DataFrame) -> DataFrame:
    """doc_id, assessment_results: JSON of the reviews' scores (from their message) and statuses by step; null where there is none."""
    t = steps.where(F.col("step_id").startswith("9.")).withColumn("score", F.regexp_extract("message", r"^Score: (\d)/5$", 1).try_cast("int"))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step_id", F.struct("score", "status").alias("r")))).alias("g"))
    return g.select("doc_id", F.to_json(F.map_from_entries("g")).alias("assessment_results"))


def rubric_feedback(answers: DataFrame) -> DataFrame:
    """answers (step_id, rubric_scores, critical_failures) with ``average`` and ``feedback``: scores by dimension, failures, mean."""
    known = F.create_map(*[x for s, d in RUBRICS.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in d]))])
    dims = F.coalesce(F.try_element_at(known, base_step(F.col("step_id"))), F.array().cast("array<string>"))
    scores = F.coalesce("rubric_scores", F.create_map().cast("map<string,double>"))
    failures = F.coalesce("critical_failures", F.array().cast("array<string>"))
    n = F.size(scores)
    mean = F.when(n > 0, F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x) / n)
    lines = F.concat(
        F.array(F.concat(F.lit("Rubric Evaluation for Step "), "step_id"), F.lit("=" * 40)),
        F.when(F.size(dims) > 0, F.array(F.lit("\nDimension Scores:"))).otherwise(F.array().cast("array<string>")),
        F.transform(dims, lambda d: F.concat(F.lit("  "), d, F.lit(": "), F.coalesce(F.try_element_at(scores, d), F.lit(0.0)).cast("int").cast("string"), F.lit("/5"))),
        F.when(F.size(failures) > 0, F.array(F.lit("\n⚠ Critical Failures:"))).otherwise(F.array().cast("array<string>")),
        F.transform(failures, lambda x: F.concat(F.lit("  - "), x)),
        F.when(n > 0, F.array(F.concat(F.lit("\nAverage Score: "), F.format_string("%.1f", F.bround(mean, 1)), F.lit("/5")))).otherwise(F.array().cast("array<string>")),
    )
    return answers.withColumn("average", mean).withColumn("feedback", F.array_join(lines, "\n"))


# -- repairs without an agent ----------------------------------------------------------------------------------


def join_split_words(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) in which a word cut by a hyphen at a line's end is whole again: the next line's first word moves
    up, over blank lines and page comments too, if it begins with a lower-case letter. A line that loses its only word is dropped."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    t = lines.withColumn("_text", ~F.col("line").rlike(r"^\s*(<!--.*-->)?\s*$"))
    body = t.where("_text")
    nxt, prev = F.lead("line").over(w), F.lag("line").over(w)
    cut = lambda c: c.rlike(r"(?U)\p{L}-$")
    first = r"^(\p{Ll}\S*)\s*"
    takes, gives = cut(F.col("line")) & nxt.rlike(first), cut(prev) & F.col("line").rlike(first)
    body = body.withColumn("_takes", F.coalesce(takes, F.lit(False))).withColumn("_gives", F.coalesce(gives, F.lit(False))).withColumn("_word", F.regexp_extract(nxt, first, 1))
    rest = F.when(F.col("_gives"), F.regexp_replace("line", first, "")).otherwise(F.col("line"))
    whole = F.when(F.col("_takes"), F.concat(F.regexp_replace(rest, "-$", ""), "_word")).otherwise(rest)
    body = body.withColumn("line", whole).where((F.col("line") != "") | ~F.col("_gives"))
    return body.select(*lines.columns).unionByName(t.where("not _text").select(*lines.columns))


def parse_leaders(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, page of printed outline lines: a title, dots, a page number; two spaces of indent a level."""
    m = r"^(.*?)\s*\.{2,}\s*(\d+)\s*$"
    bare = F.ltrim("line")
    t = lines.where(bare.rlike(m))
    return t.select("doc_id", "line_no", (F.floor((F.length("line") - F.length(bare)) / 2) + 1).cast("int").alias("level"), F.regexp_extract(bare, m, 1).alias("title"), F.regexp_extract(bare, m, 2).try_cast("int").alias("page"))


def preserved_terms(sigs: DataFrame, fixed: tuple[str, ...] = DOMAIN_TERMS) -> DataFrame:
    """doc_id, preserve_terms: the sorted domain terms that spelling repair of each document must leave alone."""
    words = F.transform(F.split("sample", f"{X.SPACE}+"), lambda w: F.upper(F.regexp_replace(w, r"^[.,;:!?()\[\]{}]+|[.,;:!?()\[\]{}]+$", "")))
    t = sigs.select("doc_id", F.explode(F.filter(words, lambda w: w.rlike(r"^\p{L}{2,}$"))).alias("w"))
    g = sigs.select("doc_id").distinct().join(t.groupBy("doc_id").agg(F.collect_set("w").alias("w")), "doc_id", "left")
    return g.select("doc_id", F.array_sort(F.array_union(F.coalesce("w", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in fixed]))).alias("preserve_terms"))
