"""Recognised pages, as text recognisers write them, to raw token rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_OCR_V2, RAW_OCR_V3


BROKEN = "broken record"


def read_pages(spark: SparkSession, path: str, version: int = 3) -> DataFrame:
    """Pages kept as JSON lines, with the file that each is from (see parse_pages)."""
    return parse_pages(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")), version)


def parse_pages(lines: DataFrame, version: int = 3) -> DataFrame:
    """Pages from JSON lines (value, source_file); version 3: parallel arrays, version 2: an array of lines. No line is
    lost but an empty one: broken holds a line that is no page, whose document is the number after "doc_id" in it or,
    where there is none, one of the file's own."""
    schema = RAW_OCR_V3 if version == 3 else RAW_OCR_V2
    read = F.from_json("value", f"{schema}, broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    each = lines.filter(F.trim("value") != "").select("value", "source_file", read.alias("p"))
    page = F.when(F.col("p.broken").isNull() & F.col("p.doc_id").isNotNull() & F.col("p.page_num").isNotNull(), F.col("p"))
    number = F.regexp_extract("value", r'"doc_id"\s*:\s*(-?\d{1,18})\b', 1)
    doc_id = F.coalesce(page["doc_id"], F.when(number != "", number).cast("bigint"), F.xxhash64("source_file"))
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)][1:]
    return each.select(doc_id.alias("doc_id"), *[page[n].alias(n) for n in names], "source_file", F.when(page.isNull(), F.col("value")).alias("broken"))


def page_files(pages: DataFrame) -> DataFrame:
    """doc_id, source_file, total_pages, error: a row for every document that pages tell of, blank and broken ones too."""
    error = F.max(F.when(F.col("broken").isNotNull(), F.lit(BROKEN)))
    return pages.groupBy("doc_id").agg(F.min("source_file").alias("source_file"), (F.coalesce(F.max("page_num"), F.lit(-1)) + 1).alias("total_pages"), error.alias("error"))


def token_files(raw: DataFrame) -> DataFrame:
    """The same from raw token rows, before any of them is dropped: the pages go up to the last row's."""
    name = F.min("source_file") if "source_file" in raw.columns else F.lit(None).cast("string")
    return raw.groupBy("doc_id").agg(name.alias("source_file"), (F.max("page_num") + 1).alias("total_pages"), F.lit(None).cast("string").alias("error"))


def poly_to_box(poly: Column) -> Column:
    """struct(x1, y1, x2, y2) around a polygon; null if it is null, empty or holds no points."""
    side = lambda i, f: f(F.transform(poly, lambda p: F.get(p, F.lit(i))))
    box = F.struct(side(0, F.array_min).alias("x1"), side(1, F.array_min).alias("y1"), side(0, F.array_max).alias("x2"), side(1, F.array_max).alias("y2"))
    return F.when((F.size(poly) > 0) & box["x1"].isNotNull() & box["y1"].isNotNull(), box)


def _rows(lines: DataFrame) -> DataFrame:
    """doc_id, page_num, width, height, token_ord, text, confidence, poly: as raw token rows."""
    found = lines.withColumn("b", poly_to_box(F.col("poly"))).filter("b is not null")
    return found.select("doc_id", "page_num", "token_ord", "text", "confidence", "b.x1", "b.y1", "b.x2", "b.y2", "width", "height")


def lines_v3(pages: DataFrame) -> DataFrame:
    """The lines of pages with parallel arrays, as many as the shortest has; polygons of detection stand in for missing
    ones of recognition."""
    polys = F.when(F.size("rec_polys") > 0, F.col("rec_polys")).otherwise(F.col("dt_polys"))
    both = pages.withColumn("polys", polys).filter("rec_texts is not null and rec_scores is not null and polys is not null")
    n = F.least(F.size("rec_texts"), F.size("rec_scores"), F.size("polys"))
    cut = [F.slice(F.col(c), F.lit(1), n).alias(c) for c in ("rec_texts", "rec_scores", "polys")]
    each = both.select("doc_id", "page_num", "width", "height", F.posexplode(F.arrays_zip(*cut)).alias("token_ord", "l"))
    return _rows(each.select("doc_id", "page_num", "width", "height", "token_ord", F.col("l.rec_texts").alias("text"), F.col("l.rec_scores").alias("confidence"), F.col("l.polys").alias("poly")))


def lines_v2(pages: DataFrame) -> DataFrame:
    """The lines of pages with an array of lines; one without a confidence is sure."""
    each = pages.select("doc_id", "page_num", "width", "height", F.posexplode("lines").alias("token_ord", "l")).filter("l is not null and l.text is not null")
    return _rows(each.select("doc_id", "page_num", "width", "height", "token_ord", "l.text", F.coalesce("l.confidence", F.lit(1.0)).alias("confidence"), F.col("l.box").alias("poly")))
