"""Column bands of a document, and the band of a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.arrays import bound
from .cluster import density_1d


def zones(merged: DataFrame, settings: Settings) -> DataFrame:
    """The bands in which a document's amounts and dates stand, headings left out, all pages together. Equal places are
    one row with their number, so windows hold a document's places, which a page's width bounds, not its tokens."""
    numbers = merged.filter(~F.col("is_header") & (F.col("is_numeric") | F.col("is_date")) & F.col("normalized_x").isNotNull())
    places = numbers.groupBy("doc_id", "normalized_x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_num", "row_id", "pos")).alias("ord"))
    how = ("normalized_x", "ord", settings.column_eps, settings.column_min_samples, "label")
    found = density_1d(places, ["doc_id"], *how, weight="n")
    band = Window.partitionBy("doc_id", "label")
    below = F.sum("n").over(band.orderBy("normalized_x").rowsBetween(Window.unboundedPreceding, 0))
    found = found.filter("label >= 0").select("doc_id", "label", "normalized_x", "n", below.alias("below"), F.sum("n").over(band).alias("support"))
    at = lambda place: F.min(F.when(F.col("below") >= place, F.col("normalized_x")))
    stats = found.groupBy("doc_id", "label", "support").agg(
        (at(F.floor((F.col("support") + 1) / 2)) * 0.5 + at(F.floor(F.col("support") / 2) + 1) * 0.5).alias("x_center"),
        F.greatest(F.lit(0.0), F.min("normalized_x") - settings.boundary_padding).alias("left_boundary"),
        F.least(F.lit(1.0), F.max("normalized_x") + settings.boundary_padding).alias("right_boundary"),
    )
    line = Window.partitionBy("doc_id").orderBy("x_center", "label")
    kept = stats.filter(F.col("support") >= settings.column_support)
    return kept.select("doc_id", (F.row_number().over(line) - 1).alias("column_id"), "x_center", "left_boundary", "right_boundary", "support", F.lit(None).cast("string").alias("semantic_role"))


def zone_arrays(found: DataFrame) -> DataFrame:
    """doc_id, zones: a document's bands from the left as one array. They are few, so a token carries them."""
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("column_id", "x_center", "left_boundary", "right_boundary", "semantic_role"))).alias("zones"))


def nearest(x: Column, bands: Column, settings: Settings) -> Column:
    """The band with the nearest centre, the lesser id of equals, as struct(dist, zone); null unless x is within it or
    near enough to its centre."""
    best = F.array_min(F.transform(bands, lambda z: F.struct(F.abs(x - z["x_center"]).alias("dist"), z.alias("zone"))))
    inside = lambda z: (x >= z["left_boundary"]) & (x <= z["right_boundary"])
    return bound(best, lambda b: F.when(inside(b["zone"]) | (b["dist"] <= settings.near_zone), b))


def assign(merged: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """merged with column_id (-1 for none) and role ("unknown" for none)."""
    return assigned(merged.join(zone_arrays(found), "doc_id", "left"), merged.columns, "zones", settings)


def assigned(both: DataFrame, keep: list[str], bands: str, settings: Settings) -> DataFrame:
    """keep, column_id and role of tokens that have their document's bands beside them."""
    both = both.withColumn("_z", nearest(F.col("normalized_x"), F.col(bands), settings))
    return both.select(*keep, F.coalesce("_z.zone.column_id", F.lit(-1)).alias("column_id"), F.coalesce("_z.zone.semantic_role", F.lit("unknown")).alias("role"))
