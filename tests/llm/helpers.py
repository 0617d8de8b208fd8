"""Plain versions to compare with."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, score string, id string, items string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def odd_documents(spark, more=()):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with results'."""
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [
        (1, base, "en"),
        (1, base, "en"),
        (2, base, "en"),
        (3, None, "en"),
        (4, "", None),
        (5, "...", "de"),
        (None, base, "en"),
        (None, None, None),
        (6, long, "en"),
        (7, long + " end", "en"),
        (8, "Zwei kleine Wörter", None),
        (9, "x", "fr"),
        (10, "\U0001f600 é中文 á", "fr"),
        *more,
    ]
    return spark.createDataFrame([(i, t, x, "s", None, "c", "s", "i", "t") for i, t, x in rows], ODD_DOCS)


def empty(df):
    return df.where("1 = 0")
