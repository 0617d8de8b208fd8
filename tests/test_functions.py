import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


CASES = [
    (X.strip, ["  a b\t\n", "", None, " x　"], ["a b", "", None, "x"]),
    (X.is_all_caps, ["ABCD", "ABC", "ABCd", "ÄÖÜß", "1234", "ABC 1"], [True, False, False, False, False, True]),
    (X.is_title_case, ["The Lord of the Rings", "the Lord", "A tale", "Part 1", "Éclair Noir"], [True, False, False, False, True]),
    (X.norm_heading, ["  The  Keep: ", "A.\tB -"], ["the keep", "a. b"]),
    (X.font_family, ["ABCDEF+Times-Bold", "Arial Narrow", "", "+-x"], ["times", "arial", None, None]),
    (X.safe_filename, ['a<b>:"|?*c'], ["a_b______c"]),
    (X.fix_spacing, ["a  b , c ( d ) [ e ]"], ["a b, c (d) [e]"]),
    (X.fix_typography, ["a—b–c…“d”"], ["a--b-c...“d”"]),
    (X.join_hyphens, ["sleep-\ning so­ft", "a- b", "é-\nà"], ["sleeping soft", "a- b", "éà"]),
    (X.normalise_bullet, ["  • x", "* y", "-  z", "1. w"], ["- x", "- y", "- z", "1. w"]),
    (X.squeeze_blank_lines, ["a\n \n\n\nb"], ["a\n\nb"]),
    (X.wrap_markdown, ["<b>", "{{x}}", "a {b} c", "note: x", ": x", "\\word", "`<b>`"], ["`<b>`", "`{{x}}`", "a `{`b`}` c", "note: x", "`:` x", "`\\word`", "`<b>`"]),
    (X.escape_marker, ["a«b»"], ["a&laquo;b&raquo;"]),
]


@pytest.mark.parametrize("f,inputs,expected", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_text(spark, f, inputs, expected):
    assert values(spark, f, inputs) == expected


def test_quotes_are_folded_only_if_asked(spark):
    assert values(spark, lambda c: X.fix_typography(c, True), ["“d” ‘e’"]) == ["\"d\" 'e'"]


def test_pdf_date(spark):
    at = datetime.datetime
    got = values(spark, X.pdf_date, ["D:20240102030405+02'00'", "D:20240102", "20240102", "D:2024", "D:20241399", None])
    assert got == [at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2), at(2024, 1, 2), None, None, None]


def test_sizes_and_durations(spark):
    assert values(spark, X.file_size, [0, 1023, 1024, 1280, 1 << 20, 5 << 30], "long") == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "5.0 GB"]
    assert values(spark, X.duration, [0, 59, 61, 3600, 3661], "long") == ["0s", "59s", "1m 1s", "1h 0m 0s", "1h 1m 1s"]


def test_flags(spark):
    assert values(spark, X.weight_of, [0, 1, 2, 3], "int") == ["normal", "bold", "normal", "bold"]
    assert values(spark, X.style_of, [0, 1, 2, 3], "int") == ["normal", "normal", "italic", "italic"]


def test_sequential(spark):
    assert values(spark, X.sequential, [[1, 2, 3], [1], [1, 3], []], "array<int>") == [True, False, False, False]
