"""Routed tokens to transactions. A row's tokens are few, so they stay one array, whose expressions make the row's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.arrays import bound, once
from ..functions.text import all_digits, extract_date, is_noise, stripped
from .columns import nearest
from .rows import PARSED, ROW


def _loose(t) -> Column:
    """The bucket of a token whose column has no role: dates are dates and words are narration."""
    return F.when(t("is_date"), "date").when(~t("is_numeric"), "narration").otherwise("unknown")


def routed(assigned: DataFrame) -> DataFrame:
    """assigned with bucket: a token's role, or what stands for one."""
    return assigned.withColumn("bucket", F.when(F.col("role") == "unknown", _loose(F.col)).otherwise(F.col("role")))


def _routed(t: Column, i: Column, zone: Column) -> Column:
    """What a row's fields are made from, of one token in the given band."""
    same = [t[c].alias(c) for c in ("normalized_x", "text", "is_numeric", "is_date", *PARSED)]
    return F.struct(F.coalesce(zone["semantic_role"], _loose(lambda c: t[c])).alias("bucket"), i.alias("i"), *same)


def assembled(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows: merged rows that are no headings, with their document's bands. A row each, with everything that a
    transaction is made from."""
    to = lambda t, i: bound(nearest(t["normalized_x"], F.col("bands"), settings)["zone"], lambda z: _routed(t, i, z))
    rows = rows.select(*ROW, "is_merged", "has_numeric", "mean_confidence", F.transform("tokens", to).alias("_t"))
    having = lambda c: F.filter("_t", lambda t: t[c].isNotNull())
    stray = lambda t: (t["bucket"] == "unknown") & t["is_numeric"]
    rows = rows.withColumns({**{f"_{c}": having(c) for c in PARSED}, "_loose": F.filter("_t", stray)})

    def first(field: str, bucket: str, also=None) -> Column:
        """The first value, in the row's order, of tokens in the bucket."""
        return F.get(F.filter(f"_{field}", lambda t: (t["bucket"] == bucket) & also(t) if also else t["bucket"] == bucket), F.lit(0))[field]

    def place(t: Column, field: str) -> Column:
        """The field behind its token's place from the left."""
        return F.struct(t["normalized_x"].alias("x"), t["i"].alias("i"), t[field].alias(field))

    sure = lambda t: ~all_digits(t["date"])
    some = lambda f: F.coalesce(F.exists("_t", f), F.lit(False))
    texts = lambda tokens: F.array_join(F.transform(tokens, lambda t: t["text"]), " ")
    words = F.filter("_t", lambda t: (t["bucket"] == "narration") & ~t["is_numeric"])
    return once(
        rows, [*ROW, "has_numeric", "mean_confidence"],
        full_text=F.when(F.col("is_merged"), texts(F.sort_array(F.transform("_t", lambda t: place(t, "text"))))).otherwise(texts("_t")),
        has_date=some(lambda t: (t["bucket"] == "date") | ((t["bucket"] == "narration") & t["is_date"])),
        has_amount=some(lambda t: t["is_numeric"] & t["bucket"].isin("debit", "credit", "balance", "unknown")),
        date_1=first("date", "date", sure),
        date_2=F.array_min(F.transform(F.filter("_date", sure), lambda t: place(t, "date")))["date"],
        date_3=first("date", "narration"),
        ref_1=first("reference", "reference"),
        ref_2=first("reference", "narration"),
        **{f"{b}_0": first("value", b) for b in ("debit", "credit", "balance")},
        n_loose=F.size(F.filter("_value", stray)).cast("long"),
        loose_first=first("value", "unknown", lambda t: t["is_numeric"]),
        loose_left=F.array_min(F.transform("_loose", lambda t: place(t, "value")))["value"],
        loose_right=F.array_max(F.transform("_loose", lambda t: place(t, "value")))["value"],
        words=F.transform(words, lambda t: stripped(t["text"])),
    )


def distributed(rows: DataFrame) -> DataFrame:
    """rows with debit, credit and balance. Where no column gave an amount, a single loose one is the balance, of
    several the rightmost is the balance and the leftmost the debit; beside a balance alone the first is the debit."""
    none = F.col("debit_0").isNull() & F.col("credit_0").isNull()
    bare = none & F.col("balance_0").isNull() & (F.col("n_loose") > 0)
    moved = none & F.col("balance_0").isNotNull() & (F.col("n_loose") > 0)
    balance = F.when(bare & (F.col("n_loose") == 1), F.col("loose_first")).when(bare, F.col("loose_right")).otherwise(F.col("balance_0"))
    debit = F.when(bare & (F.col("n_loose") > 1), F.col("loose_left")).when(moved, F.col("loose_first")).otherwise(F.col("debit_0"))
    return rows.withColumn("debit", debit).withColumn("credit", F.col("credit_0")).withColumn("balance", balance)


def described(rows: DataFrame) -> DataFrame:
    """rows with txn_date, reference_no and description."""
    rows = rows.withColumn("txn_date", F.coalesce("date_1", "date_2", "date_3", extract_date(F.col("full_text")))).withColumn("reference_no", F.coalesce("ref_1", "ref_2"))
    used = lambda w: (w == "") | F.coalesce(w == F.col("txn_date"), F.lit(False)) | F.coalesce(w == F.col("reference_no"), F.lit(False))
    words = F.array_join(F.filter("words", lambda w: ~used(w)), " ")
    return rows.withColumn("description", F.nullif(words, F.lit("")))


def reconstruct(rows: DataFrame, settings: Settings) -> DataFrame:
    """Transactions, still to be validated, from merged rows with their documents' bands; headings and noise give none."""
    rows = assembled(rows.filter(~F.col("is_header")), settings).filter("has_date or has_amount").filter(~is_noise(F.col("full_text"), F.col("has_numeric")))
    full = described(distributed(rows)).filter("coalesce(balance, debit, credit) is not null").filter("balance is not null or txn_date is not null or description is not null")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_confidence"))), 4)
    return full.select(
        *ROW, "txn_date", "description", "reference_no", "debit", "credit", "balance", score.alias("confidence_score"), F.lit("needs_review").alias("validation_status"), F.col("full_text").alias("raw_text")
    )
