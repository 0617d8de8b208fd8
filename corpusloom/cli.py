"""Command line: convert decoded documents below a folder, go on with a run, run a phase again, show the status."""

from __future__ import annotations

import argparse

from corpusloom.operators.runs import EXIT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Convert documents to Markdown.")
    p.add_argument("source", nargs="?", help="Parquet table of decoded documents")
    p.add_argument("--output", "-o", help="folder of the run")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--resume", "-r", action="store_true", help="go on with a run")
    how.add_argument("--phase", type=int, help="run one phase again (0-10)")
    how.add_argument("--from-step", help="run again from a step, such as 5.3")
    how.add_argument("--status", "-s", action="store_true", help="show the phases of a run")
    p.add_argument("--diagnostics", action="store_true", help="write the log of the run too")
    p.add_argument("--yes", "-y", action="store_true", help="ask nothing")
    p.add_argument("--gm-keyword", action="append", default=[], help="a further keyword of notes")
    p.add_argument("--gm-callout-config-file", help="JSON list of label, start_text and end_text")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 0, or that of what went wrong."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from corpusloom.plans.lifecycle import Run
    from corpusloom.sources import artifacts

    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return EXIT["success"] if not e.code else EXIT["file_error"]
    root = a.output or a.source
    if not root:
        print("ERROR: a source or an output folder is needed")
        return EXIT["file_error"]
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    rules = None
    if a.gm_callout_config_file:
        rules = spark.read.option("multiLine", True).schema("label string, start_text string, end_text string").json(a.gm_callout_config_file)
        rules = rules.where("start_text is not null").withColumn("label", F.coalesce("label", F.lit("callout_gm")))
    run = Run(spark, root, rules=rules, keywords=tuple(a.gm_keyword))
    try:
        if a.status:
            for r in run.status().collect():  # a row for each phase
                print(f"{r.phase:<3} {r['name']:<24} {r.state:<12} {r.documents} documents, {r.failed} failed {r.message}")
            return EXIT["success"]
        if a.resume or a.phase is not None or a.from_step:
            if not run.done():
                print("ERROR: Cannot resume - state file missing or corrupt")
                return EXIT["state_error"]
            ok = run.resume() if a.resume else run.single(a.phase) if a.phase is not None else run.from_step(a.from_step)
        else:
            if not (a.source and a.output):
                print("ERROR: a source and an output folder are needed for a new run")
                return EXIT["file_error"]
            spark.read.parquet(a.source).write.mode("overwrite").parquet(f"{run.root}/decoded")
            ok = run.go()
    except ValueError as e:
        print(f"ERROR: {e}")
        return EXIT["state_error"]
    if ok and a.diagnostics:
        t = run.results().join(run.states().select("phase", "started", "seconds"), "phase").join(run.status().select("phase", "name"), "phase")
        steps = t.select("doc_id", "phase", "name", F.col("started").cast("string").alias("started"), F.concat(F.col("phase").cast("string"), F.lit(".1")).alias("step_id"), F.lit(1).alias("ord"), F.col("name").alias("description"), "status", "message", (F.col("seconds") * 1000).cast("long").alias("duration_ms"))
        artifacts.write_phase(artifacts.log_entries(steps), f"{run.root}/log", 10)
    return EXIT["success"] if ok else EXIT["pdf_error"]


if __name__ == "__main__":
    raise SystemExit(main())
