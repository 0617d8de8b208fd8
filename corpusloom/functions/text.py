"""Column expressions of the text operators. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The characters of SPACE. Trimming looks at the ends alone, where a pattern would go through the text.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def safe_string(c: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(c.cast("string"), F.lit("")))


def is_upper(c: Column) -> Column:
    """Some upper-case letter and no lower- or title-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}ªº]")


def is_all_caps(c: Column, least: int = 3) -> Column:
    """An upper-case text of more than ``least`` characters."""
    return is_upper(c) & (F.length(c) > least)


#: Minor words that a title may hold in lower case.
MINOR_WORDS = ("a", "an", "the", "in", "on", "of", "for", "with", "and", "but", "or")


def is_title_case(c: Column) -> Column:
    """The text and each of its words that is not a minor one begins with an upper-case letter."""
    c = strip(c)
    words = F.split(c, f"{SPACE}+")
    return c.rlike(r"^\p{Lu}") & F.forall(words, lambda w: F.lower(w).isin(*MINOR_WORDS) | w.rlike(r"^\p{Lu}"))


def norm_heading(c: Column) -> Column:
    """White space collapsed, lower case, without punctuation at the ends; the key by which titles are matched."""
    c = F.lower(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.regexp_replace(c, r"^[ .:\-\t\r\n]+|[ .:\-\t\r\n]+$", "")


def level_label(level: Column) -> Column:
    return F.when(level.isin(1, 2, 3), F.concat(F.lit("H"), level.cast("string"))).otherwise("H4")


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDD[HH[mm[SS]]] as a timestamp; the zone is ignored, an invalid date is null."""
    d = F.regexp_extract(F.regexp_replace(c, "^D:", ""), r"^(\d{8}(?:\d{2}){0,3})", 1)
    return F.try_to_timestamp(F.when(F.length(d) >= 8, F.rpad(d, 14, "0")), F.lit("yyyyMMddHHmmss"))


def font_family(c: Column) -> Column:
    """The base family: after a subset prefix, before a style suffix, lower case; null if blank."""
    c = F.element_at(F.split(c, r"\+"), -1)
    c = F.split(F.split(c, "-")[0], " ")[0]
    return F.nullif(F.lower(c), F.lit(""))


def file_size(n: Column) -> Column:
    """Bytes with a unit, one decimal but for bytes."""
    out = F.format_string("%.1f TB", F.bround(n / float(1024**4), 1))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n.isNotNull(), out)


def safe_filename(c: Column) -> Column:
    return F.translate(c, '<>:"|?*', "_______")


def duration(seconds: Column) -> Column:
    """Hh Mm Ss, without leading zero parts."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.concat(r.cast("string"), F.lit("s"))
    text = F.when((m > 0) | (h > 0), F.concat(m.cast("string"), F.lit("m "), text)).otherwise(text)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), text)).otherwise(text)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def weight_of(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(1) != 0, "bold").otherwise("normal")


def style_of(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(2) != 0, "italic").otherwise("normal")


def escape_marker(c: Column) -> Column:
    """Guillemets as references, so that a marker always ends at the first closing guillemet; ``&`` too, so that this can be undone."""
    for x, y in (("&", "&amp;"), ("«", "&laquo;"), ("»", "&raquo;")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def unescape_marker(c: Column) -> Column:
    for x, y in (("»", "&raquo;"), ("«", "&laquo;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(y), F.lit(x))
    return c


def fix_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, r" +([.,;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"([\[(]) +", "$1"), r" +([\])])", "$1")


def fix_typography(c: Column, fold_quotes: bool = False) -> Column:
    """Dashes and ellipses in ASCII; curly quotes too if asked."""
    pairs = [("—", "--"), ("–", "-"), ("…", "...")]
    if fold_quotes:
        pairs += [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")]
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def join_hyphens(c: Column) -> Column:
    """A word cut by a hyphen at a line's end is put together; soft hyphens go."""
    return F.replace(F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2"), F.lit("­"), F.lit(""))


def normalise_bullet(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[•·]\s+"), F.regexp_replace(c, r"^\s*[•·]\s+", "- ")).when(c.rlike(r"^\s*[-*]\s+"), F.regexp_replace(c, r"^\s*[-*]\s+", "- ")).otherwise(c)


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^[^\S\n]+$", ""), r"\n{3,}", "\n\n")


#: Tokens that Markdown would take as its own, in the order they are wrapped.
WRAPPED = (r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^>]*)?/?>", r"\{\{[^}]*\}\}", r"(?<!\{)\{(?!\{)", r"(?<!\})\}(?!\})", r"\\\|", r"\\[a-zA-Z]+", r"(?U)(?<!\w):")


def wrap_markdown(c: Column) -> Column:
    """Backticks around tokens that Markdown would take as its own; what is wrapped already stays."""
    for pattern in WRAPPED:
        c = F.regexp_replace(c, f"(?<!`)({pattern})(?!`)", "`$1`")
    return c


def sequential(numbers: Column) -> Column:
    """Whether an array of at least two integers goes up by one at each step."""
    return (F.size(numbers) >= 2) & F.forall(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(numbers) - 1)), lambda i: F.try_element_at(numbers, (i + 1).cast("int")) - F.try_element_at(numbers, i.cast("int"))), lambda d: F.coalesce(d == 1, F.lit(False)))


#: Roman numbers that pages may have.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def page_numbers(texts: Column) -> Column:
    """Whether texts, in order, count pages: their decimal numbers if there are two or more, else their Roman ones up to ten.
    Other texts are skipped."""
    bare = F.transform(texts, lambda t: F.lower(strip(t)))
    # Digits that no bigint holds count as -1: no page follows one.
    digits = F.transform(F.filter(bare, lambda t: t.rlike(r"^\d+$")), lambda t: F.coalesce(t.try_cast("bigint"), F.lit(-1)))
    names = F.array(*[F.lit(r) for r in ROMAN])
    roman = F.transform(F.filter(bare, lambda t: F.array_contains(names, t)), lambda t: F.array_position(names, t))
    return F.when(F.size(digits) >= 2, sequential(digits)).otherwise(sequential(roman))


def font_complexity(fonts: Column) -> Column:
    return F.when(fonts <= 3, "low").when(fonts <= 8, "moderate").otherwise("high")


def complexity(fonts: Column, images: Column, multi_column: Column | None = None, tables: Column | None = None) -> Column:
    """How hard a document is to convert, by its fonts, then images, then layout, then tables."""
    font, no = font_complexity(fonts), F.lit(False)
    many = F.when(font == "high", "high").when(images > 50, "high").when(images > 10, F.when(font == "moderate", "high").otherwise("moderate"))
    return many.when(no if multi_column is None else multi_column, "high").when(no if tables is None else tables, F.when(font == "low", "moderate").otherwise("high")).otherwise(font)


def quick_complexity(pages: Column, fonts: Column) -> Column:
    """The simpler rule of the first phase."""
    return F.when((pages > 100) | (fonts > 10), "high").when((pages > 50) | (fonts > 5), "medium").otherwise("low")


def token_choice(tokens: Column, threshold: int = 100_000, answer: Column | None = None) -> Column:
    """proceed under the threshold; above it the given answer, else auto."""
    return F.when(tokens <= threshold, "proceed").otherwise(F.coalesce(answer, F.lit("auto")) if answer is not None else F.lit("auto"))


def image_name(page: Column, image: Column) -> Column:
    return F.format_string("page%03d_img%02d.png", page.cast("int"), image.cast("int"))


def rating(score: Column, rubric: Column) -> Column:
    """A score of 1 to 5: the given one, else the mean of the rubric's, else 5."""
    n = F.size(rubric)
    mean = F.when(n > 0, F.aggregate(F.map_values(rubric), F.lit(0.0), lambda a, x: a + x) / n)
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.coalesce(score, mean, F.lit(5.0)), 0).cast("int")))
