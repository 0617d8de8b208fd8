"""Table regions and answers about them, sample windows and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def to_pixels(box: Column, width_pt: Column, height_pt: Column, width_px: Column, height_px: Column) -> Column:
    """A box in points as one in whole pixels."""
    x, y = width_px / width_pt, height_px / height_pt
    return F.struct(*[(box[n] * (x if n[0] == "x" else y)).cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")])


def confirmed_box(top: Column, tables: Column, wanted: Column) -> Column:
    """The answer's own box, else that of the wanted table, else the first table's that has one."""
    known = F.filter(tables, lambda t: t["bbox"].isNotNull())
    return F.coalesce(top, F.try_element_at(F.filter(known, lambda t: t["table_id"] == wanted), F.lit(1))["bbox"], F.try_element_at(known, F.lit(1))["bbox"])


def table_markdown(answer: Column) -> Column:
    """The table of a JSON answer: its markdown_table, else the first of its tables that has markdown."""
    rows = F.from_json(F.get_json_object(answer, "$.tables"), "array<struct<markdown: string>>")
    first = F.try_element_at(F.filter(rows, lambda t: t["markdown"].isNotNull()), F.lit(1))["markdown"]
    return F.coalesce(F.get_json_object(answer, "$.markdown_table"), first)


#: Words near which a table is likely to stand.
ANCHORS = ("Tables", "Weapons", "Armor Class", "Damage", "Range", "|")


def sample_window(text: Column, most: int = 3500) -> Column:
    """At most ``most`` characters around the first of the anchor words, in their order, that the text holds, shifted back
    where the text ends; without one the text's head and tail."""
    text = X.strip(text)
    half = most // 2
    at = F.coalesce(*[F.nullif(F.position(F.lit(w), text), F.lit(0)) for w in ANCHORS])
    end = F.least(F.length(text), F.greatest(F.lit(0), at - 1 - half) + most)
    around = F.substr(text, F.greatest(F.lit(0), end - most) + 1, F.lit(most))
    ends = F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= most, text).when(at.isNotNull(), around).otherwise(ends)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by its value, for each key."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
