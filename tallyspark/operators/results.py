"""Documents' results: transactions, column mapping and warnings, and their projections for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .roles import mapping

NO_ROWS = "No rows extracted — document may be blank or unreadable"
NO_ZONES = "Column detection produced no zones — output may be degraded"
NO_TRANSACTIONS = "No transactions reconstructed"
FIELDS = ("txn_date", "description", "reference_no", "debit", "credit", "balance", "confidence_score", "validation_status", "page_num")


def warnings(error: Column, has_rows: Column, has_zones: Column, has_transactions: Column) -> Column:
    """What went wrong, in the order of the stages; one that ends the work is the last."""
    stop = F.when(error.isNotNull(), F.array(F.concat(F.lit("OCR error: "), error))).when(~has_rows, F.array(F.lit(NO_ROWS)))
    return F.coalesce(stop, F.array_compact(F.array(F.when(~has_zones, F.lit(NO_ZONES)), F.when(~has_transactions, F.lit(NO_TRANSACTIONS)))))


def _documents(files: DataFrame, docs: DataFrame, transactions: DataFrame, held: Column) -> DataFrame:
    """files with column_mapping, extraction_warnings, total_pages and held, an aggregate of a document's transactions."""
    found = docs.select("doc_id", F.lit(True).alias("has_rows"), mapping(F.col("bands")).alias("column_mapping"))
    both = files.join(found, "doc_id", "left").join(transactions.groupBy("doc_id").agg(held.alias("held")), "doc_id", "left")
    said = warnings(F.col("error"), F.coalesce("has_rows", F.lit(False)), F.col("column_mapping").isNotNull(), F.col("held").isNotNull())
    empty = F.create_map().cast("map<string,string>")
    return both.select(
        "doc_id", "source_file", F.when(F.col("error").isNotNull(), 0).otherwise(F.col("total_pages")).alias("total_pages"), said.alias("extraction_warnings"),
        F.coalesce("column_mapping", empty).alias("column_mapping"), "held",
    )


def results(files: DataFrame, docs: DataFrame, transactions: DataFrame) -> DataFrame:
    """files, docs: as token_files() and document_bands() give them. doc_id, source_file, total_pages, extraction_warnings, column_mapping, transactions (in document order)."""
    fields = [c for c in transactions.columns if c not in ("doc_id", "page_num", "row_id")]
    held = F.sort_array(F.collect_list(F.struct("page_num", "row_id", *fields)))
    both = _documents(files, docs, transactions, held)
    return both.withColumn("transactions", F.coalesce("held", F.array().cast(both.schema["held"].dataType))).drop("held")


def manifests(files: DataFrame, docs: DataFrame, transactions: DataFrame) -> DataFrame:
    """results() with total_transactions in place of the transactions: a row that doesn't grow with its document, to go
    beside the relation of transactions."""
    both = _documents(files, docs, transactions, F.count(F.lit(1)))
    return both.withColumn("total_transactions", F.coalesce("held", F.lit(0).cast("long"))).drop("held")


def plain(x: Column) -> Column:
    """A double as decimal text with one decimal at least and without trailing zeros; at most six decimals."""
    text = F.regexp_replace(x.cast("decimal(30,6)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def csv_rows(transactions: DataFrame) -> DataFrame:
    """The fields that are written to CSV, as text; null is the empty text."""
    show = {"debit": plain, "credit": plain, "balance": plain, "confidence_score": lambda c: plain(F.round(c, 4))}
    keep = [c for c in ("doc_id", "row_id") if c in transactions.columns]
    return transactions.select(*keep, *[F.coalesce(show.get(c, lambda x: x.cast("string"))(F.col(c)), F.lit("")).alias(c) for c in FIELDS])


def json_value(x: Column, text: bool) -> Column:
    """A JSON number, or a JSON text; null is the empty text."""
    quoted = F.regexp_replace(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("v"))), r'^\{"v":(.*)\}$', "$1") if text else None
    return quoted if text else F.coalesce(plain(x), F.lit('""'))


def json_rows(transactions: DataFrame) -> DataFrame:
    """doc_id, page_num, row_id, json: a transaction as one JSON object."""
    texts = ("txn_date", "description", "reference_no", "validation_status", "raw_text")
    order = (*FIELDS, "raw_text")
    parts = []
    for i, c in enumerate(order):
        value = F.col(c).cast("string") if c == "page_num" else json_value(F.round(c, 4) if c == "confidence_score" else F.col(c), c in texts)
        parts += [F.lit(("{" if i == 0 else ",") + f'"{c}":'), value]
    return transactions.select("doc_id", "page_num", "row_id", F.concat(*parts, F.lit("}")).alias("json"))


def summary_rows(transactions: DataFrame) -> DataFrame:
    """What the command line prints of each transaction."""
    return transactions.select(
        "doc_id", "page_num", "row_id", "txn_date", F.substring(F.coalesce("description", F.lit("")), 1, 60).alias("description"), "debit", "credit", "balance",
        F.col("validation_status").alias("status"), F.round("confidence_score", 3).alias("confidence"),
    )
