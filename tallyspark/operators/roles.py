"""What a document's columns mean: by their headings, then by position. A document's bands are few, so they are one array;
every step of the inference is an expression over it, and none needs a window. What a step reads more than once is bound:
steps that are merely columns are copied into each other, and the work grows with the product of their mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ROLE_PRIORITY, Settings
from ..functions.arrays import bound
from ..functions.fuzzy import role_scores


def packed(found: DataFrame) -> DataFrame:
    """doc_id, bands: a document's bands by number as one array of all their fields."""
    fields = [c for c in found.columns if c not in ("doc_id", "column_id")]
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("column_id", *fields))).alias("bands"))


def unpacked(docs: DataFrame) -> DataFrame:
    """A row per band again."""
    return docs.select("doc_id", F.inline("bands"))


def heading_tokens(merged: DataFrame, found: DataFrame) -> DataFrame:
    """Heading tokens with each band that they stand in; bands may overlap, so a token may be in two."""
    heads = merged.filter("is_header").select("doc_id", "page_num", "row_id", "pos", "text", "normalized_x")
    bands = found.select("doc_id", "column_id", "left_boundary", "right_boundary")
    return heads.join(bands, "doc_id").filter("normalized_x between left_boundary and right_boundary")


def _headed(merged: DataFrame, found: DataFrame) -> DataFrame:
    """packed(found) with zone_text in every band."""
    each = F.array_sort(F.collect_list(F.struct("page_num", "row_id", "pos", "text", "normalized_x")))
    heads = merged.filter("is_header").groupBy("doc_id").agg(each.alias("heads"))

    return packed(found).join(heads, "doc_id", "left").select("doc_id", F.transform("bands", _said).alias("bands"))


def _said(band: Column) -> Column:
    """The band with zone_text: the texts of the heads that stand in it."""
    within = F.filter("heads", lambda h: (h["normalized_x"] >= band["left_boundary"]) & (h["normalized_x"] <= band["right_boundary"]))
    return bound(within, lambda inside: band.withField("zone_text", F.when(F.size(inside) > 0, F.trim(F.lower(F.array_join(F.transform(inside, lambda h: h["text"]), " "))))))


def document_bands(merged: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, bands, total_pages: a row per document of the merged rows; its bands with roles from headings, position
    and the debit-credit order as one array, null without any, and its pages up to the last row."""
    place = lambda t, i: F.struct("page_num", "row_id", (i + 1).alias("pos"), t["text"].alias("text"), t["normalized_x"].alias("normalized_x"))
    heads = F.flatten(F.collect_list(F.when(F.col("is_header"), F.transform("tokens", place))))
    docs = merged.groupBy("doc_id").agg(F.sort_array(heads).alias("heads"), (F.max("page_num") + 1).alias("total_pages"))
    both = docs.join(packed(found), "doc_id", "left")
    return _inferred(both.select("doc_id", "total_pages", F.transform("bands", _said).alias("bands")), settings)


def zone_texts(merged: DataFrame, found: DataFrame) -> DataFrame:
    """found with zone_text: the headings of a band in reading order, in lower case; null without any."""
    return unpacked(_headed(merged, found))


def _with_role(band: Column, role: Column) -> Column:
    """The band with role, without its zone_text."""
    return band.dropFields("semantic_role", "zone_text").withField("semantic_role", role)


def _fuzzy(docs: DataFrame, settings: Settings) -> DataFrame:
    scored = docs.withColumn("_s", role_scores(F.transform("bands", lambda b: b["zone_text"]), settings.vocabulary, ROLE_PRIORITY, settings.fuzzy_threshold))
    # no lambda may hold the scores themselves: Python functions aren't evaluated within one
    both = F.zip_with("bands", "_s", lambda b, s: F.struct(b["column_id"].alias("id"), s.alias("s")))

    def winner(both: Column, i: int) -> Column:
        """The band with the best score for a role, its number negated so that the lesser one of equals is greater."""
        able = F.filter(both, lambda z: F.get(z["s"], F.lit(i)) >= settings.fuzzy_threshold)
        return F.array_max(F.transform(able, lambda z: F.struct(F.get(z["s"], F.lit(i)).alias("score"), (-z["id"]).alias("id"))))["id"]

    names = F.array(*[F.lit(r) for r in ROLE_PRIORITY])
    won = bound(both, lambda z: F.array(*[winner(z, i) for i in range(len(ROLE_PRIORITY))]))
    role = lambda b, w: F.get(names, (F.array_position(w, -b["column_id"]) - 1).cast("int"))
    return scored.withColumn("bands", bound(won, lambda w: F.transform("bands", lambda b: _with_role(b, role(b, w))))).drop("_s")


def _simple(docs: DataFrame, settings: Settings) -> DataFrame:
    def role(band: Column) -> Column:
        hit = F.lit(None).cast("string")
        for name in reversed(ROLE_PRIORITY):
            inside = F.lit(False)
            for k in settings.vocabulary[name]:
                inside = inside | band["zone_text"].contains(k.lower())
            hit = F.when(inside, name).otherwise(hit)
        return hit

    return docs.withColumn("bands", F.transform("bands", lambda b: _with_role(b, role(b))))


def _positional(docs: DataFrame, settings: Settings) -> DataFrame:
    """One fold over the roles that position can give: each, if missing, goes to the free band that is first by its key,
    if that key is below the role's limit."""
    places = [("date", "left", settings.date_before), ("balance", "right", float("inf")), ("narration", "wide", -settings.narration_wider), ("debit", "right", float("inf")), ("credit", "right", float("inf"))]
    rules = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(by).alias("by"), F.lit(below).alias("below")) for r, by, below in places])

    def give(bands: Column, rule: Column) -> Column:
        key = lambda b: F.when(rule["by"] == "left", b["x_center"]).when(rule["by"] == "right", -b["x_center"]).otherwise(b["left_boundary"] - b["right_boundary"])
        free = F.filter(bands, lambda b: b["semantic_role"].isNull())
        first = F.array_min(F.transform(free, lambda b: F.struct(key(b).alias("key"), b["column_id"].alias("id"))))
        able = ~F.exists(bands, lambda b: b["semantic_role"].eqNullSafe(rule["role"]))
        to = F.when(able, bound(first, lambda f: F.when(f["key"] < rule["below"], f["id"])))
        return bound(to, lambda i: F.when(i.isNull(), bands).otherwise(F.transform(bands, lambda b: b.withField("semantic_role", F.when(b["column_id"] == i, rule["role"]).otherwise(b["semantic_role"])))))

    return docs.withColumn("bands", F.aggregate(rules, F.col("bands"), give))


def _swapped(docs: DataFrame) -> DataFrame:
    def swapped(bands: Column) -> Column:
        first = lambda role: F.array_min(F.transform(F.filter(bands, lambda b: b["semantic_role"] == role), lambda b: F.struct(b["column_id"].alias("id"), b["x_center"].alias("x"))))
        role = lambda b, f: F.when(b["column_id"] == f["d"]["id"], "credit").when(b["column_id"] == f["c"]["id"], "debit").otherwise(b["semantic_role"])
        moved = lambda f: F.transform(bands, lambda b: b.withField("semantic_role", role(b, f)))
        return bound(F.struct(first("debit").alias("d"), first("credit").alias("c")), lambda f: F.when(f["d"]["x"] > f["c"]["x"], moved(f)).otherwise(bands))

    return docs.withColumn("bands", bound(F.col("bands"), swapped))


def fuzzy_roles(texts: DataFrame, settings: Settings) -> DataFrame:
    """Bands with the roles won by fuzzy matching. Each role goes to the band that scores best, the lesser id of
    equals; in order of priority, a role whose band is taken is lost."""
    return unpacked(_fuzzy(packed(texts), settings))


def simple_roles(texts: DataFrame, settings: Settings) -> DataFrame:
    """Bands with the roles whose keywords are in the headings; a band takes the first such role in order of priority,
    so a role may be given to several."""
    return unpacked(_simple(packed(texts), settings))


def positional_roles(found: DataFrame, settings: Settings) -> DataFrame:
    """found with roles for bands without one: the leftmost is the date if it's far left, the rightmost the balance,
    the widest the narration if it's wide, the rest debit and credit from the right; only roles still missing."""
    return unpacked(_positional(packed(found), settings))


def debit_left_of_credit(found: DataFrame) -> DataFrame:
    """found with debit and credit swapped where the first debit band is right of the first credit band."""
    return unpacked(_swapped(packed(found)))


def infer_roles(found: DataFrame, merged: DataFrame, settings: Settings) -> DataFrame:
    """found with roles from headings, position and the debit-credit order."""
    return unpacked(_inferred(_headed(merged, found), settings))


def _inferred(docs: DataFrame, settings: Settings) -> DataFrame:
    named = _fuzzy(docs, settings) if settings.fuzzy else _simple(docs, settings)
    return _swapped(_positional(named, settings))


def mapping(bands: Column) -> Column:
    """Band number, as text, to role; empty where no band has one, null without bands."""
    held = F.filter(bands, lambda b: b["semantic_role"].isNotNull())
    return F.map_from_entries(F.transform(held, lambda b: F.struct(b["column_id"].cast("string").alias("key"), b["semantic_role"].alias("value"))))


def column_mapping(found: DataFrame) -> DataFrame:
    """doc_id, column_mapping: band number, as text, to role."""
    return packed(found).select("doc_id", mapping(F.col("bands")).alias("column_mapping"))
