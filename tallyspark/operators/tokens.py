"""Raw recognised texts to tokens: filters, coordinates, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import amount_shaped, date_shaped, stripped


def page_limit(df: DataFrame, settings: Settings) -> DataFrame:
    """The first max_pages pages; all of them at 0."""
    return df.filter(F.col("page_num") < settings.max_pages) if settings.max_pages > 0 else df


def confident(raw: DataFrame, settings: Settings) -> DataFrame:
    return raw.filter(F.col("confidence") >= settings.min_confidence)


def build_tokens(raw: DataFrame, settings: Settings) -> DataFrame:
    """Tokens of texts that are sure enough and not empty, on pages that have a size."""
    kept = confident(raw, settings).filter("width > 0 and height > 0").withColumn("text", stripped(F.col("text"))).filter("text != ''")
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return kept.select(
        "doc_id", "page_num", "token_ord", "text", "confidence", "x1", "y1", "x2", "y2",
        cx.alias("center_x"), cy.alias("center_y"), (cx / F.col("width")).alias("normalized_x"), (cy / F.col("height")).alias("normalized_y"),
        amount_shaped(F.col("text")).alias("is_numeric"), date_shaped(F.col("text")).alias("is_date"),
    )


def with_extent(tokens: DataFrame) -> DataFrame:
    """tokens with width and height."""
    return tokens.withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1"))
