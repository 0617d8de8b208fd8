import random

from pyspark.sql import functions as F

from corpusloom.operators import cleaning, fonts, marking, quality, rendering, structure
from corpusloom.plans.convert import convert
from corpusloom.sources import tables
from corpusloom.streaming import handoff


def lines(spark, texts):
    return spark.createDataFrame([(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t)], "doc_id long, line_no int, line string")


def collected(df):
    out = {}
    for r in df.orderBy("doc_id", "line_no").collect():
        out.setdefault(r.doc_id, []).append(r.line)
    return out


def test_paragraphs_against_plain_python(spark):
    rng = random.Random(1)
    texts = [[rng.choice(["", "a b", " c ", "ABCD", "# h", "«sig001:x»", "<!-- Page 1 -->", "ßig", "Ä"]) for _ in range(rng.randint(1, 25))] for _ in range(60)]

    def merged(t):
        out, held = [], []
        for x in t:
            s = x.strip()
            if s and not s.startswith(("<!--", "#", "«")) and not s.isupper():
                held.append(s)
                continue
            if held:
                out.append(" ".join(held))
                held = []
            out.append(x)
        return out + ([" ".join(held)] if held else [])

    assert collected(cleaning.merge_paragraphs(lines(spark, texts))) == {i: merged(t) for i, t in enumerate(texts)}


def test_runs_against_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for d in range(80):
        for n in range(rng.randint(1, 9)):
            rows.append((d, 1, 0, n, rng.choice(["a", " b", "c ", " ", "", "dé"]), rng.choice(["sig001", "sig002", None])))
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, span_no int, text string, sig string")

    def line(spans):
        out = []
        for text, sig in spans:
            if not text:
                continue
            if out and sig is not None and out[-1][0] == sig:
                joined = out[-1][2]
                out[-1][1] += (" " if not joined[-1].isspace() and not text[0].isspace() else "") + text
                out[-1][2] = text
            else:
                out.append([sig, text, text])
        parts = []
        for i, (sig, text, _) in enumerate(out):
            parts.append(f"«{sig}:{text}»" if sig else (" " if i and not text[0].isspace() else "") + text)
        return "".join(parts)

    got = {r.doc_id: r.line for r in marking.marked_lines(marking.runs(df)).collect()}
    for d in range(80):
        spans = [(r[4], r[5]) for r in rows if r[0] == d]
        if any(t for t, _ in spans):
            assert got[d] == line(spans)


def test_callouts_against_plain_python(spark):
    rng = random.Random(3)
    kinds = {"t": ("text", None), "e": ("the END here", None), "c": ("«sig001:box»", "callout_gm"), "x": ("«sig001:box END»", "callout_gm"), "h": ("«sig002:head»", "H2"), "o": ("«sig003:other»", None)}
    texts = [[rng.choice("ttecxho") for _ in range(rng.randint(1, 20))] for _ in range(60)]
    df = lines(spark, [[kinds[k][0] for k in t] for t in texts])
    label = spark.createDataFrame([(d, s, v) for d in range(60) for s, v in (("sig001", "callout_gm"), ("sig002", "H2"))], "doc_id long, sig string, label string")
    ends = spark.createDataFrame([("callout_gm", "END")], "label string, end_text string")
    stated = rendering.callout_state(rendering.first_label(df, label), ends)
    want = {}
    for d, t in enumerate(texts):
        inside, out = False, []
        for k in t:
            text = {"c": "box", "x": "box END", "h": "## head", "o": "other"}.get(k, kinds[k][0])
            if k in "cx":
                inside = True
            elif k in "ho":
                inside = False
            out.append(("> " if inside else "") + text)
            if k == "x":  # the end text counts in the callout's own lines only
                inside = False
        want[d] = out
    assert collected(rendering.render(stated)) == want


def test_signature_order_and_levels(spark):
    rows = [(1, 1, 0, i, 0, f"t{i}", "f", float(s), 0, 10.0) for i, s in enumerate([10, 14, 12, 14, 9, 8, 7])]
    sigs = {r.size: (r.sig, r.suggested_level, r.frequency) for r in fonts.signatures(spark.createDataFrame(rows, tables.SPANS)).collect()}
    assert sigs == {14.0: ("sig001", 1, 2), 12.0: ("sig002", 2, 1), 10.0: ("sig003", 3, 1), 9.0: ("sig004", 3, 1), 8.0: ("sig005", 3, 1), 7.0: ("sig006", None, 1)}


def test_boundary_capture(spark):
    blocks = spark.createDataFrame([(1, 0, "x START a"), (1, 1, "b"), (1, 2, "c END d"), (1, 3, "e"), (1, 4, "START f END g"), (1, 5, "h"), (1, 6, "START i"), (1, 7, "j")], "doc_id long, ord int, text string")
    rules = spark.createDataFrame([("box", "START", "END")], "label string, start_text string, end_text string")
    got = [(r.ord, r.text) for r in structure.boundary_capture(blocks, rules).orderBy("ord").collect()]
    assert got == [(0, "START a"), (1, "b"), (2, "c END"), (4, "START f END"), (6, "START i"), (7, "j")]


def test_lint_and_gaps(spark):
    md = lines(spark, [["# A", "", "### B", "x", "", "", "## C"]])
    found = sorted((r.line_no, r.rule) for r in quality.lint(md).collect())
    assert found == [(2, "MD001"), (2, "MD022"), (5, "MD012")]
    toc = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "d", 1)], "doc_id long, title string, level int")
    gaps = sorted((r.key, r.problem) for r in quality.toc_gaps(toc, quality.headings(md)).collect())
    assert gaps == [("b", "level_mismatch"), ("d", "missing_in_doc")]


def test_conversion_leaves_no_marker_and_loses_no_document(spark):
    docs = spark.createDataFrame([(1, "TITLE OF IT\nsome text, here\n\nmore — text", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in convert(tables.spans_of_text(docs)).collect()}
    assert set(out) == {1, 2} and "«" not in out[1] and "--" in out[1]


def test_json_of_a_missing_file_is_empty(spark, tmp_path):
    assert tables.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_answers_arrive_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = '{"doc_id": 1, "step_id": "9.2", "attempt": 1, "input_hash": "x", "status": "success", "arrived": "2024-01-01T00:00:00"}\n'
    (src / "a.json").write_text(row + row)
    q = handoff.append_available(handoff.answers(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.schema(handoff.OUTPUTS).parquet(str(tmp_path / "out")).count() == 1


def in_a_row(spans, toc):
    """The conversion as the operators give it, one after another."""
    from corpusloom.functions import text as X

    sigs = fonts.signatures(spans)
    found = marking.runs(fonts.with_signature(spans, sigs))
    matched = fonts.tolerant(spans, sigs)
    gone = fonts.footer_ids(fonts.footer_classes(matched, fonts.page_counts(spans))).union(fonts.icon_signatures(matched, sigs).select("doc_id", "sig"))
    kept = cleaning.drop_signatures(found.where("sig is not null"), gone).select(*found.columns).unionByName(found.where("sig is null"))
    lines = marking.with_page_markers(marking.marked_lines(kept))
    lines = cleaning.squeeze_lines(cleaning.drop_blank_markers(lines.withColumn("line", cleaning.wrap_marked(F.col("line")))))
    lines = cleaning.merge_paragraphs(lines)
    every = spans.where(X.strip(F.col("text")) != "").groupBy("doc_id", F.col("font").alias("family"), "size", X.weight_of(F.col("flags")).alias("weight"), X.style_of(F.col("flags")).alias("style")).agg(F.min(X.strip(F.col("text"))).alias("a"), F.max(X.strip(F.col("text"))).alias("b"))
    numbers = sigs.join(every, ["doc_id", *fonts.KEY]).where("ord > 5 and a = b").where(F.col("a").rlike(r"^\d+$"))
    lines = cleaning.drop_page_numbers(lines, numbers)
    lines = lines.withColumn("line", X.normalise_bullet(X.join_hyphens(X.fix_typography(X.fix_spacing(F.col("line"))))))
    marks = marking.markers(lines)
    labels = structure.single_top(structure.labels(sigs, fonts.body_size(sigs), structure.toc_levels(marks, toc), structure.evidence(marks)))
    return rendering.documents(rendering.render(rendering.callout_state(rendering.first_label(lines, labels))))


def test_conversion_is_the_operators_in_a_row(spark):
    rng = random.Random(4)
    words = ["GM note", "read aloud", "owl", "THE KEEP", "Of Owls", "-", "3", "«x»", "a&b", "—", "", " ", "<b>", "•"]
    rows, toc = [], []
    for d in range(40):
        for p in range(1, rng.choice([2, 7, 9])):
            for i in range(rng.randint(1, 6)):
                for s in range(rng.randint(1, 3)):
                    rows.append((d, p, 0, i, s, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice("fg"), rng.choice([8.0, 10.0, 10.3, 14.0, 20.0]), rng.choice([0, 1]), float(rng.choice([40, 300]))))
            if d % 3 == 0:
                rows.append((d, p, 0, 90, 0, str(p), "n", 7.0, 0, 790.0))
            if d % 4 == 0:
                rows.append((d, p, 0, 91, 0, "DRAFT", "w", 30.0, 2, 300.0))
            if d % 5 == 0:
                rows.append((d, p, 0, 92, 0, "Owl press", "o", 6.0, 2, 770.0))
            if d % 6 == 0:
                rows.append((d, p, 0, 93, 0, "", "FontAwesome6Free-Solid", 6.5, 2, 300.0))
        if d % 2:
            toc += [(d, "the keep", 2), (d, "Of  owls", 1), (d, "", 1)]
    df, outline = spark.createDataFrame(rows, tables.SPANS), spark.createDataFrame(toc, "doc_id long, title string, level int")
    want = {r.doc_id: r.text for r in in_a_row(df, outline).collect()}
    got = {r.doc_id: r.text for r in convert(df, outline).collect()}
    assert {d: t for d, t in got.items() if t} == {d: t for d, t in want.items() if t} and len(got) == len({r[0] for r in rows})
    assert any("DRAFT" in r[5] for r in rows) and not any("DRAFT" in t or "Owl press" in t for t in got.values())


def test_conversion_scans_few_times(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"TITLE OF IT\nsome text {i}, here\n\nmore — text", "s") for i in range(50)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d.parquet"))
    out = convert(tables.spans_of_text(spark.read.parquet(str(tmp_path / "d.parquet"))))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") <= 2 and plan.count("Exchange hashpartitioning") <= 5


def test_conversion_with_rules_images_and_tables(spark):
    rows = [(1, 1, 0, 0, 0, "THE KEEP OF OWLS", "f", 20.0, 0, 100.0), (1, 1, 0, 1, 0, "Beware of it", "f", 9.0, 1, 120.0), (1, 1, 0, 2, 0, "and flee now.", "f", 9.0, 1, 140.0), (1, 2, 0, 0, 0, "plain text that goes on, and on", "f", 10.0, 0, 120.0)]
    rules = spark.createDataFrame([("callout_gm", "Beware", "flee now.", 1)], "label string, start_text string, end_text string, ord int")
    images = spark.createDataFrame([(1, 2, 1, "a.png", "x")], "doc_id long, page int, img_index int, filename string, alt_text string")
    grid = spark.createDataFrame([(1, 2, "t1", "| a |")], "doc_id long, page int, table_id string, markdown string")
    (r,) = convert(spark.createDataFrame(rows, tables.SPANS), rules=rules, images=images, tables=grid).collect()
    assert "# THE KEEP OF OWLS" in r.text and "> Beware of it" in r.text and "> and flee now." in r.text and "\nplain text" in r.text and "![](a.png)" in r.text and "| a |" in r.text


def test_rates_of_arriving_answers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda step, status, at: f'{{"doc_id": 1, "step_id": "{step}", "attempt": 1, "input_hash": "x", "status": "{status}", "arrived": "2024-01-01T{at}:00"}}\n'
    (src / "a.json").write_text(row("9.2", "success", "00:01") + row("9.3", "success", "00:02") + row("9.4", "failed", "00:03") + row("9.5", "success", "00:15") + row("9.7", "success", "05:00"))
    q = handoff.answer_rates(handoff.answers(spark, "file://" + str(src))).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.window.start), r.status): r["count"] for r in spark.table("rates").collect()}
    assert got == {("2024-01-01 00:00:00", "success"): 2, ("2024-01-01 00:00:00", "failed"): 1, ("2024-01-01 00:10:00", "success"): 1}
