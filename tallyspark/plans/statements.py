"""Statements derived from the orders table: a ledger per customer, and the tokens of its printed pages.

A customer is a document. Its orders, by date, are the ledger's lines; an open order is a credit, any other a debit.
All money is summed in whole cents and all coordinates are whole thousandths of the page, so that every engine
computes the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPENING_CENTS = 100_000_000
LINES = 20
#: Where a page's columns stand, in thousandths: date, narration, reference, debit, credit, balance.
PLACES = (50, 220, 430, 620, 740, 900)
#: The headings that documents have, by doc_id; the last kind has none.
HEADINGS = (
    ("Date", "Description", "Ref No", "Withdrawal", "Deposit", "Balance"),
    ("Txn Date", "Particulars", "Chq No", "Dr", "Cr", "Bal"),
    ("Value Date", "Narration", "UTR", "Debit", "Credit", "Balance"),
    (),
)
WORDS = ("CARD BOOKSHOP", "WAGES WEEK", "IMPS-LANDLORD", "Dues of 4 Mar")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k (the order), seq (from 0), cents, is_credit, day, shown_cents (the printed balance, null on some lines
    and wrong on some)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderstatus") == "O").alias("is_credit"),
    )
    line = Window.partitionBy("doc_id").orderBy("o_orderdate", "k")
    moved = F.when(F.col("is_credit"), F.col("cents")).otherwise(-F.col("cents"))
    balance = F.sum(moved).over(line.rowsBetween(Window.unboundedPreceding, 0)) + OPENING_CENTS
    wrong = F.when(F.col("k") % 17 == 0, 90_000_000).otherwise(0)
    return rows.select(
        "doc_id", "k", (F.row_number().over(line) - 1).alias("seq"), "cents", "is_credit", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.when(F.col("k") % 11 != 0, balance + wrong).alias("shown_cents"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as transactions to be validated."""
    rows = lines(spark, sf_dir)
    money = F.when(F.col("k") % 13 != 0, F.col("cents") / 100)
    return rows.select(
        "doc_id", F.floor(F.col("seq") / LINES).cast("int").alias("page_num"), (F.col("seq") % LINES).cast("int").alias("row_id"), F.col("day").alias("txn_date"),
        F.concat(F.lit("order "), F.col("k").cast("string")).alias("description"), F.lit(None).cast("string").alias("reference_no"),
        F.when(~F.col("is_credit"), money).alias("debit"), F.when(F.col("is_credit"), money).alias("credit"), (F.col("shown_cents") / 100).alias("balance"),
        ((F.col("k") % 64) / 64).alias("confidence_score"), F.lit("needs_review").alias("validation_status"), F.concat_ws(" ", "day", F.col("k").cast("string")).alias("raw_text"),
    )


def printed(cents: Column) -> Column:
    """1234567 as 12,345.67."""
    whole = F.format_number(F.floor(F.abs(cents) / 100), 0)
    return F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts of the printed pages, before any filter: headings, lines, continuations, footers."""
    page, line = F.floor(F.col("seq") / LINES).cast("int"), (F.col("seq") % LINES).cast("int")
    rows = lines(spark, sf_dir).withColumn("page_num", page).withColumn("line", line)
    k = F.col("k")
    y = 100 + 40 * F.col("line")
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % 4 + 1).cast("int"))
    reference = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("40000000"), F.lpad(k.cast("string"), 8, "0"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("UTRN"), F.lpad(k.cast("string"), 12, "0")))
    suffix = F.when(k % 23 == 0, F.when(F.col("is_credit"), " CR").otherwise(" DR")).otherwise("")

    def token(slot: int, text: Column, order: Column, height: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(slot).alias("slot"), text.alias("text"), order.cast("int").alias("token_ord"), height.cast("int").alias("y")))

    at = lambda slot: 10 + F.col("line") * 10 + slot
    found = [
        token(0, F.concat(F.lit(" "), F.col("day")), at(0), y, k % 19 != 0),
        token(1, F.concat(word, F.lit(" ")), at(1), y, F.lit(True)),
        token(2, reference, at(2), y, reference.isNotNull()),
        token(3, F.concat(printed(F.col("cents")), suffix), at(3), y, ~F.col("is_credit")),
        token(4, F.concat(printed(F.col("cents")), suffix), at(4), y, F.col("is_credit")),
        token(5, printed(F.col("shown_cents")), at(5), y, F.col("shown_cents").isNotNull()),
        token(1, F.concat(F.lit("cont "), k.cast("string")), at(6), y + 21, (F.col("line") % 5 == 4) & (F.col("line") >= 9)),
        token(1, F.lit("Summary of page"), F.lit(1000), F.lit(930), F.col("line") == 0),
        token(2, F.lit("123456789012"), F.lit(1001), F.lit(960), F.col("line") == 0),
    ]
    kinds = F.array(*[F.array(*[F.lit(t) for t in kind]).cast("array<string>") for kind in HEADINGS])
    words = F.when(F.col("line") == 0, F.get(kinds, (F.col("doc_id") % len(HEADINGS)).cast("int")))
    heads = F.transform(words, lambda t, i: F.struct(i.alias("slot"), t.alias("text"), i.alias("token_ord"), F.lit(60).alias("y")))
    texts = F.array_compact(F.concat(F.array(*found), F.coalesce(heads, F.array())))
    each = rows.select("doc_id", "k", "page_num", F.explode(texts).alias("t")).select("doc_id", "k", "page_num", "t.*")
    x = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.col("slot") + 1) + (k + F.col("slot")) % 3
    y = F.col("y") + (F.col("doc_id") + F.col("slot")) % 3
    sure = F.when((k + F.col("slot")) % 29 == 0, 0.125).otherwise((48 + (k + F.col("slot")) % 16) / 64)
    return each.select(
        "doc_id", "page_num", "token_ord", "text", sure.alias("confidence"),
        (x - 20).cast("double").alias("x1"), (y - 5).cast("double").alias("y1"), (x + 20).cast("double").alias("x2"), (y + 5).cast("double").alias("y2"),
        F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"),
    )


def ocr_pages_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts a row per page, as parallel arrays; on some pages the scores are one short."""
    return _pages(spark, sf_dir).select(
        "doc_id", "page_num", "width", "height", F.transform("t", lambda t: t["text"]).alias("rec_texts"),
        F.when(F.col("doc_id") % 5 == 0, F.slice(F.transform("t", lambda t: t["confidence"]), F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))).otherwise(F.transform("t", lambda t: t["confidence"])).alias("rec_scores"),
        F.transform("t", _box).alias("rec_polys"), F.lit(None).cast("array<array<array<double>>>").alias("dt_polys"),
    )


def ocr_pages_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts a row per page, as an array of lines; a few lines lack a box or a confidence."""
    line = lambda t: F.struct(
        F.when(t["token_ord"] % 31 != 5, _box(t)).alias("box"), t["text"].alias("text"), F.when(t["token_ord"] % 37 != 11, t["confidence"]).alias("confidence")
    )
    return _pages(spark, sf_dir).select("doc_id", "page_num", "width", "height", F.transform("t", line).alias("lines"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, source_file: the pages as JSON lines. Some documents' pages are blank (doc_id % 7 = 3) or hold white space
    only (% 11 = 4), some end in a blank page (% 7 = 5), and of some the first line is cut off (% 13 = 6)."""
    doc_id, none = F.col("doc_id"), lambda kind: F.array().cast(f"array<{kind}>")
    blank = doc_id % 7 == 3
    said = F.transform("t", lambda t: F.when(doc_id % 11 == 4, F.lit("  ")).otherwise(t["text"]))
    pages = _pages(spark, sf_dir).select(
        "doc_id", "page_num", "width", "height", F.when(blank, none("string")).otherwise(said).alias("rec_texts"),
        F.when(blank, none("double")).otherwise(F.transform("t", lambda t: t["confidence"])).alias("rec_scores"),
        F.when(blank, none("array<array<double>>")).otherwise(F.transform("t", _box)).alias("rec_polys"),
    )
    last = raw_tokens(spark, sf_dir).filter("doc_id % 7 = 5").groupBy("doc_id", "width", "height").agg((F.max("page_num") + 1).alias("page_num"))
    every = pages.unionByName(last.select("doc_id", "page_num", "width", "height", none("string").alias("rec_texts"), none("double").alias("rec_scores"), none("array<array<double>>").alias("rec_polys")))
    value = F.to_json(F.struct(*every.columns))
    cut = (doc_id % 13 == 6) & (F.col("page_num") == 0)
    return every.select(F.when(cut, F.substring(value, 1, 50)).otherwise(value).alias("value"), F.concat(F.lit("pages-"), (doc_id % 10).cast("string")).alias("source_file"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("token_ord", "text", "confidence", "x1", "y1", "x2", "y2")))
    return raw_tokens(spark, sf_dir).groupBy("doc_id", "page_num", "width", "height").agg(held.alias("t"))


def _box(t: Column) -> Column:
    corner = lambda x, y: F.array(t[x], t[y])
    return F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
