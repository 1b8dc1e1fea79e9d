"""Tokens to logical rows: clustering by height, headings, continuations and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import extract_date, extract_reference, number
from .cluster import density_1d

PAGE = ["doc_id", "page_num"]
ROW = [*PAGE, "row_id"]
#: The first fields of a gathered token: where it stands in its row.
ALONG = ("normalized_x", "part_id", "token_ord")
#: What a gathered token's text holds.
PARSED = ("date", "reference", "value")
#: The fields of a token that what follows reads.
READ = ("normalized_x", "text", "is_numeric", "is_date", *PARSED)


def row_tokens(tokens: DataFrame, settings: Settings) -> DataFrame:
    """tokens with part_id, the number of their row from the top of the page."""
    return density_1d(tokens, PAGE, "normalized_y", "token_ord", settings.row_eps, 1, "part_id")


def gathered(placed: DataFrame, settings: Settings) -> DataFrame:
    """A row per row as clustered, with its flags and its tokens; a row's tokens are few."""
    digits = F.regexp_replace("text", "[,.]", "").rlike(r"^\d+$")
    keys = [*PAGE, "part_id"]
    text, dated = F.col("text"), F.col("is_date") | F.col("text").rlike(r"^\d{7,}$")
    # only texts that were found to be dates or amounts are searched again; digits alone may hold a date, but are none
    found = (F.when(dated, extract_date(text)), extract_reference(text), F.when(F.col("is_numeric"), number(text)))
    rows = placed.withColumns(dict(zip(PARSED, found, strict=True))).groupBy(*keys).agg(
        F.avg("normalized_y").alias("y_center"),
        F.bool_or("is_numeric").alias("has_amount"),
        F.bool_or(F.col("is_numeric") | F.col("is_date")).alias("has_number"),
        F.bool_or((F.col("part_id") < settings.header_rows) & ~F.col("is_numeric") & (F.char_length("text") > 2) & ~digits).alias("has_word"),
        F.sum("confidence").alias("confidence"),
        F.count("confidence").alias("n_sure"),
        F.collect_list(F.struct(*ALONG, *[c for c in placed.columns if c not in (*keys, *ALONG)], *PARSED)).alias("tokens"),
    )
    line = Window.partitionBy(*PAGE).orderBy("part_id")
    rows = rows.withColumn("is_header", (F.col("part_id") < settings.header_rows) & ~F.col("has_amount") & F.col("has_word"))
    gap = F.col("y_center") - F.lag("y_center").over(line)
    joined = ~F.col("is_header") & ~F.lag("is_header").over(line) & ~F.col("has_number") & (gap <= settings.continuation_gap)
    rows = rows.withColumn("is_continuation", F.coalesce(joined, F.lit(False)))
    parent = F.max(F.when(~F.col("is_continuation"), F.col("part_id"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("row_id", parent).drop("has_number", "has_word")


def parts(rows: DataFrame) -> DataFrame:
    """The gathered rows without their tokens: doc_id, page_num, part_id, y_center, is_header, is_continuation, row_id
    (the row that it's merged into), n_tokens."""
    return rows.withColumn("n_tokens", F.size("tokens").cast("long")).drop("tokens", "confidence", "n_sure", "has_amount")


def merged_rows(rows: DataFrame) -> DataFrame:
    """A row per merged row: doc_id, page_num, row_id, is_header, is_merged, has_numeric, mean_confidence and its tokens in
    their places: by height, then from the left, where rows were merged; else from the left."""
    own = Window.partitionBy(*ROW)
    more = F.flatten(F.collect_list(F.when(F.col("is_continuation"), F.col("tokens"))).over(own))
    each = rows.withColumns({"_more": more, "has_numeric": F.bool_or("has_amount").over(own), "_sum": F.sum("confidence").over(own), "_n": F.sum("n_sure").over(own)})
    each = each.filter("part_id = row_id").withColumn("is_merged", F.size("_more") > 0).withColumn("mean_confidence", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")))
    falling = F.sort_array(F.transform(F.concat("tokens", "_more"), lambda t: F.struct(t["normalized_y"].alias("y"), t.alias("t"))))
    tokens = F.when(F.col("is_merged"), F.transform(falling, lambda s: s["t"])).otherwise(F.sort_array("tokens"))
    return each.select(*ROW, "is_header", "is_merged", "has_numeric", "mean_confidence", tokens.alias("tokens"))


def slim(merged: DataFrame) -> DataFrame:
    """Merged rows whose tokens keep only what bands, roles and transactions are made from."""
    return merged.withColumn("tokens", F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in READ])))


def tokens_of(merged: DataFrame) -> DataFrame:
    """The tokens of merged rows with row_id, is_header and pos, their place in the row."""
    each = merged.select(*ROW, "is_header", F.posexplode("tokens").alias("_i", "_t"))
    return each.select(*PAGE, "_t.*", "row_id", "is_header", (F.col("_i") + 1).alias("pos")).drop(*PARSED)


def merged_tokens(rows: DataFrame) -> DataFrame:
    """The tokens of gathered rows, merged."""
    return tokens_of(merged_rows(rows))


def full_texts(merged: DataFrame) -> DataFrame:
    """A row per merged row: its text from the left, its mean height, the flags."""
    texts = F.array_sort(F.collect_list(F.struct("normalized_x", "pos", "text")))
    return merged.groupBy(*ROW).agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("full_text"),
        F.bool_or("is_numeric").alias("has_numeric"),
        F.first("is_header").alias("is_header"),
        F.count(F.lit(1)).alias("n_tokens"),
    )
