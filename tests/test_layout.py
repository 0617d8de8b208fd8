from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import cleaning, layout, quality, rendering, runs
from tests.test_functions import values


def test_sample_window(spark):
    short, far = "a short text", "x" * 5000 + "Weapons" + "y" * 5000
    plain = "p" * 9000
    got = values(spark, layout.sample_window, [short, far, plain])
    first, late = values(spark, layout.sample_window, ["Weapons" + "a" * 4000 + "Tables" + "b" * 4000, "c" * 5000 + "Range" + "d" * 100])
    assert "Tables" in first and "Weapons" not in first and len(late) == 3500 and late.endswith("Range" + "d" * 100)
    assert got[0] == short and "Weapons" in got[1] and len(got[1]) == 3500 and got[2].startswith("p") and "..." in got[2]


def test_templates(spark):
    got = values(spark, lambda c: layout.fill_template(c, {"name": F.lit("Ann"), "n": F.lit(3), "none": F.lit(None)}), ["{name} has {n}{none} {other}"])
    assert got == ["Ann has 3 {other}"]


def test_bare_line_styles(spark):
    assert values(spark, cleaning.restyle, ["THE KEEP", "Of Dragons And Men", "plain words here", ""]) == ["## The Keep", "### Of Dragons And Men", "plain words here", ""]
    assert values(spark, cleaning.split_numbered, ["1. One thing 2. Two things", "none"]) == [["1. One thing", "2. Two things"], ["none"]]
    assert values(spark, cleaning.wrap_marked, ["\u00absig001:a <b> c\u00bb <i> <!-- x:y -->"]) == ["\u00absig001:a `<b>` c\u00bb `<i>` <!-- x:y -->"]


def test_page_numbers(spark):
    texts = [["1", " 2 ", "x", "3"], ["1", "3"], ["iv", "V", "vi"], ["1", "iv", "v"], ["1", "2", "x", "ix"], ["7"], [], ["xi", "xii"], ["9" * 30, "1"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    assert [r.ok for r in df.orderBy("i").select(X.page_numbers(F.col("t")).alias("ok")).collect()] == [True, False, True, True, True, False, False, False, False]


def test_rating_and_notice(spark):
    meta = spark.createDataFrame([(1, "T", "", "C", None), (2, None, None, None, "(c) me")], "doc_id long, title string, author string, creator string, copyright string")
    notices = rendering.copyright_notice(meta, "2024-01-02")
    got = {r.doc_id: r.notice for r in notices.collect()}
    assert "Title: T\nAuthor/Publisher: C\nCopyright: See original publication\nSource file: T\nConverted: 2024-01-02" in got[1]
    assert "Title: (c) me\nAuthor/Publisher: Unknown\nCopyright: (c) me\n" in got[2]
    texts = spark.createDataFrame([(1, "x"), (3, "y")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in rendering.with_notice(texts, notices).collect()} == {1: got[1] + "x", 3: "y"}


def test_gate_of_paged_steps_and_critical_failures(spark):
    rows = [("9.2", {"heading_hierarchy": 3, "section_coherence": 3, "nesting_correctness": 3}, []), ("7.7_p3_t1", {"detection_recall": 1}, []), ("1.1", None, None), ("1.1", None, ["broken"])]
    out = quality.gate(spark.createDataFrame(rows, "step_id string, rubric_scores map<string,int>, critical_failures array<string>"), quality.rubric_table(spark)).collect()
    assert [r.passed for r in out] == [True, False, True, False]
    assert out[1].missing == ["boundary_accuracy", "detection_precision"] and out[1].low == ["detection_recall"]


def test_retry_policy(spark):
    rows = [("9.2", 3, False), ("7.7_p1", 3, False), ("4.5", 3, False), ("4.5", 1, False), ("4.5", 1, True)]
    out = runs.retry_policy(spark.createDataFrame(rows, "step_id string, attempt int, passed boolean"), quality.step_table(spark)).collect()
    assert [r.action for r in out] == ["failed", "flagged", "skipped", "retry", "done"]


def test_wrapping_against_plain_python(spark):
    """The same seven rules, in order, by another engine of regular expressions."""
    import random
    import re

    rules = [re.compile(f"(?<!`)({p.replace('(?U)', '')})(?!`)") for p in X.WRAPPED]

    def wrap(text):
        for r in rules:
            text = r.sub(r"`\1`", text)
        return text

    def marked(line):
        out = []
        for part in re.findall(r"(?s)«sig[a-z0-9]+:[^»]*»|<!--.*?-->|(?:(?!«sig|<!--).)+", line):
            m = re.fullmatch(r"(?s)«(sig[a-z0-9]+):([^»]*)»", part)
            out.append(part if part.startswith("<!--") else f"«{m[1]}:{wrap(m[2])}»" if m else wrap(part))
        return "".join(out)

    rng = random.Random(8)
    tokens = ["<b>", "</i>", "<a href='x'>", "{{x y}}", "{", "}", "\\|", "\\note", ":", "é:", "w:", "`", " ", "word", "ß", "«sig001:", "»", "<!-- a:b -->", "3"]
    texts = ["".join(rng.choices(tokens, k=rng.randint(1, 12))) for _ in range(400)]
    got = values(spark, cleaning.wrap_marked, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != marked(t)] == []
