"""Decoding by a fake decoder, phases that are run, stopped and gone on with, files written, and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import agents, intake, prototype
from corpusloom.plans import lifecycle
from corpusloom.sources import artifacts, decoding


def page(n, lines, size=10.0):
    return [{"page_no": n, "block_no": 0, "line_no": i, "span_no": 0, "text": t, "font": "Times", "size": s, "flags": 0, "origin_y": 100.0 + 20 * i} for i, (t, s) in enumerate(lines)]


def book(title="A Book"):
    first = [("THE KEEP OF OWLS", 20.0), ("It stands on a hill — far", 10.0), ("from every road.", 10.0), ("GM Note: it is haunted", 12.0)]
    second = [("Of Its Cellars", 16.0), ("They are deep and wet and cold, so cold that hardly any one comes back.", 10.0)]
    return {
        "info": {"title": title, "author": "Ann", "creator": None, "producer": "", "copyright": "", "creation_date": "D:20240102", "modification_date": None},
        "toc": [{"level": 1, "title": "The Keep of Owls", "page": 1}, {"level": 2, "title": "Of its cellars", "page": 2}],
        "pages": [{"page_no": n, "width": 612.0, "height": 792.0, "text": "\n".join(t for t, _ in x)} for n, x in ((1, first), (2, second))],
        "fonts": [{"page_no": 1, "name": "ABCDEF+Times-Roman"}, {"page_no": 2, "name": "Times Bold"}],
        "images": [{"page_no": 2, "img_index": 1, "rects": [{"x0": 1.0, "y0": 2.0, "x1": 4.0, "y1": 8.0}], "content": b"png"}, {"page_no": 2, "img_index": 2, "rects": [], "content": b""}],
        "spans": page(1, first) + page(2, second),
    }


def decoder(raw: bytes) -> dict:
    """A stand-in for a PDF library: the bytes are JSON."""
    got = json.loads(raw)
    if got.get("locked"):
        raise decoding.Protected
    for i in got.get("images", []):
        i["content"] = i["content"].encode()
    return got


@pytest.fixture
def decoded(spark, tmp_path):
    books = {"one": book(), "two": book("Another"), "scan": {**book(), "pages": [{"page_no": 1, "width": 1.0, "height": 1.0, "text": " "}]}, "locked": {"locked": True}}
    for name, b in books.items():
        for i in b.get("images", []):
            i["content"] = i["content"].decode()
        (tmp_path / f"{name}.pdf").write_text(json.dumps(b))
    (tmp_path / "broken.pdf").write_text("{")
    t = decoding.decode(decoding.files(spark, "file://" + str(tmp_path)), decoder)
    return t.withColumn("name", F.regexp_extract("path", r"([^/]*)\.pdf$", 1))


def test_every_file_is_a_row(decoded):
    rows = {r.name: r for r in decoded.collect()}
    assert rows["locked"].error == "encrypted" and rows["broken"].error.startswith("unreadable") and rows["one"].error is None
    assert {r.code for r in decoding.refused(decoded).collect()} == {"PDF_ENCRYPTED", "PDF_NOT_FOUND"}
    meta = {r.doc_id: r for r in intake.metadata(decoding.admitted(decoded)).collect()}
    one = meta[rows["one"].doc_id]
    assert (one.title, one.page_count, one.toc_entries, one.toc_max_depth, one.image_count, one.font_count, str(one.creation_date)) == ("A Book", 2, 2, 2, 2, 1, "2024-01-02 00:00:00")
    assert intake.valid(intake.metadata(decoded)).count() == 3
    images = decoding.images(decoding.admitted(decoded)).where(F.col("doc_id") == rows["one"].doc_id).orderBy("img_index").collect()
    assert [(i.filename, i.position.height, bytes(i.content)) for i in images] == [("page002_img01.png", 6.0, b"png"), ("page002_img02.png", 0.0, b"")]
    assert {r.page_height for r in decoding.spans(decoding.admitted(decoded)).collect()} >= {792.0}


def test_pictures_by_plugins(spark):
    raw = spark.createDataFrame([(1, bytearray(b"doc"))], "doc_id long, content binary")
    want = spark.createDataFrame([(1, 2), (1, 1), (1, 2)], "doc_id long, page_no int")
    pictures = decoding.rasters(raw, want, lambda c, p, zoom: c + b"%d@%.2f" % (p, zoom), 144)
    assert sorted((r.page_no, bytes(r.image)) for r in pictures.collect()) == [(1, b"doc1@2.00"), (2, b"doc2@2.00")]
    boxes = spark.createDataFrame([(1, 2, "t", (1, 2, 3, 4))], "doc_id long, page_no int, table_id string, bbox struct<x0: int, y0: int, x1: int, y1: int>")
    (crop,) = decoding.crops(pictures, boxes, lambda image, b: image + str(b["x1"]).encode()).collect()
    assert (crop.table_id, bytes(crop.crop)) == ("t", b"doc2@2.003")


def test_images_are_painted_over(spark, decoded):
    raw = decoded.select("doc_id", F.lit(b"x").alias("content"))
    out = {r.doc_id: bytes(r.content) for r in decoding.without_images(raw, decoded, lambda c, rects: c + str(len(rects)).encode()).collect()}
    assert set(out.values()) == {b"x1", b"x0"} and len(out) == 5


def test_phases_from_begin_to_end_and_again(spark, decoded, tmp_path):
    root = "file://" + str(tmp_path / "run")
    decoded.drop("name").write.parquet(root + "/decoded")
    run = lifecycle.Run(spark, root)
    assert run.registry.complete and run.missing(3) == [0, 1, 2]
    assert run.go(), [r.message for r in run.status().collect()]
    status = run.status().collect()
    assert [r.state for r in status] == ["completed"] * 11 and (status[0].documents, status[0].failed) == (5, 3)
    names = {r.doc_id: r.name for r in decoded.collect()}
    texts = {names[r.doc_id]: r.text for r in run.table("final", 10).collect()}
    assert set(texts) == {"one", "two"}
    assert "# THE KEEP OF OWLS" in texts["one"] and "## Of Its Cellars" in texts["one"] and "> GM Note: it is haunted" in texts["one"] and "a hill -- far" in texts["one"] and "![](page002_img01.png)" in texts["one"]
    reports = {names[r.doc_id]: r.text for r in run.table("report", 10).collect()}
    assert "**Source:** A Book" in reports["one"] and "encrypted" in reports["locked"] and "Phase 3: TOC & Font Extraction" in reports["one"]
    # A phase whose results are gone is where a later run goes on; tables of other phases stay.
    import shutil

    for n in (9, 10):
        shutil.rmtree(tmp_path / "run" / "results" / f"phase={n}")
    again = lifecycle.Run(spark, root)
    assert again.done() == list(range(9))
    with pytest.raises(ValueError, match="needs phases"):
        again.single(10)
    assert again.resume() and again.done() == list(range(11))
    assert again.single(5) and again.from_step("9.1")
    shutil.rmtree(tmp_path / "run" / "text" / "phase=8")
    assert 8 not in again.done() and again.resume() and again.done() == list(range(11))
    with pytest.raises(ValueError):
        again.from_step("nine")


def test_a_failing_phase_stops_a_run_and_is_recorded(spark, tmp_path):
    def fails(run):
        raise RuntimeError("no luck")

    one = lifecycle.Phase(0, "first", lambda run: {"t": run.spark.createDataFrame([(1, None), (2, "odd")], "doc_id long, error string")})
    run = lifecycle.Run(spark, "file://" + str(tmp_path), lifecycle.Registry([one, lifecycle.Phase(1, "second", fails), lifecycle.Phase(2, "third", lambda r: {})]))
    assert not run.go()
    assert [(r.state, r.failed, r.message) for r in run.status().collect()] == [("completed", 1, ""), ("failed", 0, "RuntimeError: no luck"), ("pending", 0, "")]
    assert [r.doc_id for r in run.alive(spark.range(1, 4).withColumnRenamed("id", "doc_id"), 1).orderBy("doc_id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        lifecycle.Registry([one, one])
    with pytest.raises(ValueError):
        lifecycle.Registry([lifecycle.Phase(11, "x", fails)])


def test_command_line(spark, decoded, tmp_path, capsys):
    src, out = "file://" + str(tmp_path / "in.parquet"), "file://" + str(tmp_path / "out")
    decoded.drop("name").write.parquet(src)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps([{"start_text": "They are deep", "end_text": "comes back."}]))
    assert cli.main(["--resume", "-o", out], spark) == 4
    assert cli.main([src], spark) == 2 and cli.main(["--resume", "--status", "-o", out], spark) == 2
    assert cli.main([src, "-o", out, "--diagnostics", "--gm-callout-config-file", "file://" + str(rules), "--gm-keyword", "stands on"], spark) == 0
    assert cli.main(["--status", "-o", out], spark) == 0 and "completed" in capsys.readouterr().out
    text = lifecycle.Run(spark, out).table("final", 10).first().text
    assert "> They are deep" in text
    assert cli.main(["--phase", "4", "-o", out], spark) == 0 and cli.main(["--from-step", "x", "-o", out], spark) == 4
    assert "Phase 0: Pre-flight Analysis" in artifacts.read_phase(spark, out + "/log", 10).first().text


def test_bundles_and_exported_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    files = spark.createDataFrame([(1, "metadata.json", bytearray(b"{}")), (1, "a-phase5.md", bytearray(b"t")), (1, "odd.txt", bytearray(b"x")), (2, "a-phase5.md", bytearray(b"x"))], "doc_id long, file string, content binary")
    (got,) = artifacts.bundles(files, docs, "--yes").collect()
    with zipfile.ZipFile(io.BytesIO(bytes(got.content))) as z:
        assert got.doc_id == 1 and z.namelist() == ["a-phase5.md", "metadata.json", "cli-args.txt"] and z.read("cli-args.txt") == b"--yes"
    artifacts.export_texts(docs.withColumn("text", F.lit("x\ny")), "file://" + str(tmp_path / "t"))
    (f,) = (tmp_path / "t" / "name=a").glob("part-*")
    assert f.read_text() == "x\ny\n"
    artifacts.write_json(docs, "file://" + str(tmp_path / "j"))
    assert artifacts.read(spark, "completion", "file://" + str(tmp_path / "none.json")).count() == 0


def test_requests_stubs_and_commands(spark, tmp_path):
    asked = spark.createDataFrame([(1, "9.3", '{"a": 1}')], "doc_id long, step_id string, payload string")
    agents.write_requests(asked, "file://" + str(tmp_path / "r"))
    (r,) = spark.read.json("file://" + str(tmp_path / "r")).collect()
    assert r.output_contract == "schemas/step_9_3.schema.json" and "text flow" in r.instructions and r.attempt == 1
    (s,) = agents.stub_answers(asked).collect()
    assert s.input_hash == r.input_hash and s.status == "success"
    assert agents.command("go")[-1] == "-" and agents.command("go", "opencode") == ["opencode", "run", "go"]
    with pytest.raises(ValueError):
        agents.command("go", "nobody")


def test_agents_as_plugins(spark):
    def agent(text):
        if "bad" in text:
            raise TimeoutError("too late")
        return json.dumps({"step_id": "9.3", "status": "success", "data": {}, "warnings": [], "rubric_scores": {"reading_order": 5, "paragraph_integrity": 5, "flow_continuity": 4}})

    asked = agents.instructions(spark.createDataFrame([(1, "9.3", '{"a": 1}'), (2, "9.3", '{"a": "bad"}')], "doc_id long, step_id string, payload string"))
    got = agents.dispatch(asked, agent)
    assert {r.doc_id: r.status for r in got.collect()} == {1: "answered", 2: "failed"}
    broken = {r.doc_id: r.violations for r in agents.contract_violations(got).collect()}
    assert broken[1] == [] and "missing: data" in broken[2]
    read = {r.doc_id: (r.status, r.notes) for r in agents.read_answers(got).collect()}
    assert read == {1: ("success", None), 2: ("failed", "too late")}


def test_one_pass_styling(spark):
    lines = ["THE KEEP", "12", "", "It stands on a hill far from every road, and a conver-", "ted barn", "is near.", "", "", "• item", "last"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    assert [r.line for r in prototype.one_pass(df).orderBy("line_no").collect()] == ["## The Keep", "", "It stands on a hill far from every road, and a converted barn", "is near.", "", "- item", "last"]
