"""Results as files: distributed JSON and CSV folders, and exact single files for one document."""

from __future__ import annotations

import csv
import json
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.overlay import row_bands, token_boxes, zone_bands
from ..operators.results import FIELDS, csv_rows, summary_rows

if TYPE_CHECKING:
    from ..plans.engine import Relations

TEXTS = ("txn_date", "description", "reference_no")
AMOUNTS = ("debit", "credit", "balance")


def write_csv(transactions: DataFrame, path: str) -> None:
    """A folder of CSV files with headings, a partition each."""
    csv_rows(transactions).select("doc_id", *FIELDS).write.option("header", True).option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """A folder of JSON lines, one per document."""
    results.withColumn("total_transactions", F.size("transactions")).write.option("ignoreNullFields", False).json(path)


def page_sizes(tokens: DataFrame) -> DataFrame:
    """doc_id, page_num, width, height of the pages that have tokens."""
    pages = tokens.groupBy("doc_id", "page_num").agg(F.max(F.col("center_x") / F.col("normalized_x")).alias("width"), F.max(F.col("center_y") / F.col("normalized_y")).alias("height"))
    return pages.select("doc_id", "page_num", F.round("width").alias("width"), F.round("height").alias("height"))


def overlay_layers(relations: Relations) -> dict[str, DataFrame]:
    """What to draw over each page: zones, rows, tokens (see operators/overlay.py)."""
    return {"zones": zone_bands(relations.zones, page_sizes(relations.tokens)), "rows": row_bands(relations.merged, relations.parts), "tokens": token_boxes(relations.tokens)}


def write_overlay(relations: Relations, path: str) -> None:
    """The layers of all pages as folders of JSON lines."""
    for name, df in overlay_layers(relations).items():
        df.write.json(f"{path.rstrip('/')}/{name}")


def one(results: DataFrame, doc_id: int) -> Row:
    """A single document's result on the driver; it's as large as one statement."""
    found = results.filter(F.col("doc_id") == doc_id).take(1)
    if not found:
        raise ValueError(f"no document {doc_id}")
    return found[0]


def plain_row(t: Row) -> dict:
    """A transaction as it stands in a file."""
    out = {k: t[k] or "" for k in TEXTS} | {k: "" if t[k] is None else t[k] for k in AMOUNTS}
    return out | {"confidence_score": round(t["confidence_score"], 4), "validation_status": t["validation_status"], "page_num": t["page_num"], "raw_text": t["raw_text"]}


def manifest(result: Row, n: int) -> dict:
    """What a file says of a document before its n transactions."""
    return {
        "source_file": result["source_file"] or "",
        "total_pages": result["total_pages"],
        "total_transactions": n,
        "column_mapping": result["column_mapping"],
        "extraction_warnings": result["extraction_warnings"],
    }


def save_json(result: Row, path: str) -> None:
    """One document as an indented JSON file; folders are made."""
    data = manifest(result, len(result["transactions"])) | {"transactions": [plain_row(t) for t in result["transactions"]]}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")


def save_csv(result: Row, path: str) -> None:
    """One document's transactions as a CSV file that starts with a byte order mark; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", newline="", encoding="utf-8-sig") as f:
        writer = csv.DictWriter(f, FIELDS, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(plain_row(t) for t in result["transactions"])


def summary(result: Row, transactions: DataFrame) -> dict:
    """What the command line prints of a document."""
    rows = summary_rows(transactions.filter(F.col("doc_id") == result["doc_id"])).orderBy("page_num", "row_id").drop("doc_id", "page_num", "row_id").collect()
    return {"source_file": result["source_file"] or "", "total_pages": result["total_pages"], "total_txn": len(result["transactions"]), "column_mapping": result["column_mapping"], "warnings": result["extraction_warnings"], "transactions": [r.asDict() for r in rows]}
