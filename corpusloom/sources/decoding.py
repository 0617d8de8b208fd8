"""Binary documents by way of a plug-in decoder, and the tables that follow from what it gives.

A decoder is a function of a file's bytes that returns a dict with any of ``info``, ``toc``, ``pages``, ``fonts``,
``images`` and ``spans``; it raises ``Protected`` for encrypted files. Every file gives one row, errors too, so a bad
document is data and stops nothing. The tables below are projections and explodes of that row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.functions import text as X

RECT = "struct<x0: double, y0: double, x1: double, y1: double>"
DECODED = (
    "doc_id long, path string, file_size_bytes long, error string, "
    "info struct<title: string, author: string, creator: string, producer: string, copyright: string, creation_date: string, modification_date: string>, "
    "toc array<struct<level: int, title: string, page: int>>, "
    "pages array<struct<page_no: int, width: double, height: double, text: string>>, "
    "fonts array<struct<page_no: int, name: string>>, "
    f"images array<struct<page_no: int, img_index: int, rects: array<{RECT}>, content: binary>>, "
    "spans array<struct<page_no: int, block_no: int, line_no: int, span_no: int, text: string, font: string, size: double, flags: int, origin_y: double>>"
)


class Protected(Exception):
    """The document is encrypted or asks for a password."""


def files(spark, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (a hash of the path), path, file_size_bytes, content of the files under a path."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return t.select(F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("file_size_bytes"), "content")


def by_plugin(rows: DataFrame, work: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows of a plug-in: a function from one row, as a dict, to rows of the schema."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist(work(b.slice(i, 1).to_pylist()[0]), arrow)

    return rows.mapInArrow(run, schema)


def decode(binary: DataFrame, decoder: Callable[[bytes], dict]) -> DataFrame:
    """A row of DECODED for each file; ``error`` is null, ``encrypted``, or what the decoder raised."""
    names = StructType.fromDDL(DECODED).names[4:]

    def work(row):
        out = {"doc_id": row["doc_id"], "path": row["path"], "file_size_bytes": row["file_size_bytes"]}
        try:
            got = decoder(row["content"])
            return [out | {n: got.get(n) for n in names}]
        except Protected:
            return [out | {"error": "encrypted"}]
        except Exception as e:  # a file that can't be read is a row with its reason
            return [out | {"error": f"unreadable: {e}"}]

    return by_plugin(binary.select("doc_id", "path", "file_size_bytes", "content"), work, DECODED)


def admitted(decoded: DataFrame) -> DataFrame:
    """The documents that can be worked."""
    return decoded.where("error is null")


def refused(decoded: DataFrame) -> DataFrame:
    """doc_id, path, code, message of those that can't."""
    t = decoded.where("error is not null")
    message = F.when(F.col("error") == "encrypted", "PDF is encrypted or password-protected").otherwise(F.col("error"))
    return t.select("doc_id", "path", F.when(F.col("error") == "encrypted", "PDF_ENCRYPTED").otherwise("PDF_NOT_FOUND").alias("code"), message.alias("message"))


def _exploded(decoded: DataFrame, name: str) -> DataFrame:
    return decoded.select("doc_id", F.posexplode(name).alias("ord", "x")).select("doc_id", "ord", "x.*")


def outline(decoded: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, page of embedded outlines."""
    return _exploded(decoded, "toc")


def pages(decoded: DataFrame, first: int | None = None) -> DataFrame:
    """doc_id, page_no, width, height, text of all pages or of the first some."""
    t = decoded if first is None else decoded.withColumn("pages", F.filter("pages", lambda p: p["page_no"] <= first))
    return _exploded(t, "pages").drop("ord")


def fonts(decoded: DataFrame) -> DataFrame:
    """doc_id, page_no, name, family of the fonts that pages list."""
    return _exploded(decoded, "fonts").drop("ord").withColumn("family", X.font_family(F.col("name")))


def first_box(rects: Column) -> Column:
    """x, y, width, height of the first rectangle; zeros without one."""
    r = F.try_element_at(rects, F.lit(1))
    at = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(at(r["x0"]).alias("x"), at(r["y0"]).alias("y"), at(r["x1"] - r["x0"]).alias("width"), at(r["y1"] - r["y0"]).alias("height"))


def images(decoded: DataFrame) -> DataFrame:
    """doc_id, page, img_index (from 1), filename, position, alt_text, content of every image."""
    t = _exploded(decoded, "images")
    return t.select("doc_id", F.col("page_no").alias("page"), "img_index", X.image_name(F.col("page_no"), F.col("img_index")).alias("filename"), first_box(F.col("rects")).alias("position"), F.concat(F.lit("[Figure on page "), F.col("page_no").cast("string"), F.lit("]")).alias("alt_text"), "content")


def image_rects(decoded: DataFrame) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1: every rectangle that an image covers."""
    t = _exploded(decoded, "images").select("doc_id", F.col("page_no").alias("page"), F.explode("rects").alias("r"))
    return t.select("doc_id", "page", "r.*")


def spans(decoded: DataFrame) -> DataFrame:
    """Positioned text spans with the height of their page."""
    height = F.map_from_entries(F.transform(F.coalesce("pages", F.array().cast("array<struct<page_no: int, width: double, height: double, text: string>>")), lambda p: F.struct(p["page_no"], p["height"])))
    t = decoded.select("doc_id", height.alias("h"), F.explode("spans").alias("s"))
    return t.select("doc_id", "s.*", F.coalesce(F.try_element_at("h", F.col("s.page_no")), F.lit(800.0)).alias("page_height"))


def rasters(binary: DataFrame, pages_wanted: DataFrame, renderer: Callable[[bytes, int, float], bytes], dpi: int = 150) -> DataFrame:
    """doc_id, page_no, image: pages as a renderer (bytes, page, zoom) -> picture gives them."""
    want = pages_wanted.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_no")).alias("wanted"))
    work = lambda r: [{"doc_id": r["doc_id"], "page_no": p, "image": renderer(r["content"], p, dpi / 72)} for p in r["wanted"]]
    return by_plugin(binary.join(want, "doc_id").select("doc_id", "content", "wanted"), work, "doc_id long, page_no int, image binary")


def crops(pictures: DataFrame, boxes: DataFrame, cropper: Callable[[bytes, dict], bytes]) -> DataFrame:
    """doc_id, table_id, crop: the parts of page pictures within boxes (doc_id, page_no, table_id, bbox)."""
    t = pictures.join(boxes, ["doc_id", "page_no"]).select("doc_id", "table_id", "image", "bbox")
    return by_plugin(t, lambda r: [{"doc_id": r["doc_id"], "table_id": r["table_id"], "crop": cropper(r["image"], r["bbox"])}], "doc_id long, table_id string, crop binary")


def without_images(binary: DataFrame, decoded: DataFrame, painter: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    """doc_id, content: files with every image rectangle painted over by a painter (bytes, rectangles) -> bytes."""
    r = image_rects(decoded).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1"))).alias("rects"))
    t = binary.select("doc_id", "content").join(r, "doc_id", "left")
    return by_plugin(t, lambda x: [{"doc_id": x["doc_id"], "content": painter(x["content"], x["rects"] or [])}], "doc_id long, content binary")
