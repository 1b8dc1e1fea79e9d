"""python -m tallyspark extract PATH: statements from recognised pages (JSON lines) or tokens (Parquet); demo: a made-up one."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.tokens import build_tokens
from .plans.engine import StatementEngine
from .sources.demo import demo_tokens
from .sources.document_files import write_documents, write_drawings
from .sources.raw_ocr import lines_v2, lines_v3, page_files, read_pages, token_files
from .sources.sinks import one, save_csv, save_json, summary, write_csv, write_json, write_overlay


LOG = logging.getLogger("tallyspark")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tallyspark", description="Statements from positioned texts")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("demo", help="extract a made-up statement and show its transactions")
    extract = commands.add_parser("extract", help="extract the transactions of statements")
    extract.add_argument("path", help="recognised pages as JSON lines, or a Parquet folder of raw tokens")
    extract.add_argument("--format", choices=("v3", "v2", "tokens"), default="v3", help="what the path holds")
    extract.add_argument("--doc-id", type=int, help="one document, printed as a summary; without it, all are written")
    extract.add_argument("--json", metavar="PATH", help="where JSON goes: a file for one document, else a folder")
    extract.add_argument("--csv", metavar="PATH", help="where CSV goes: a file for one document, else a folder")
    extract.add_argument("--each", action="store_true", help="folders hold an exact file for each document")
    extract.add_argument("--max-pages", type=int, default=0, metavar="N", help="the first N pages only; 0: all")
    extract.add_argument("--no-fuzzy", action="store_true", help="match headings by substrings")
    extract.add_argument("--repair", action="store_true", help="swap debit and credit where only that fits the balance")
    extract.add_argument("--debug", metavar="PATH", help="a folder for what to draw over the pages: JSON lines, and an SVG file for each page")
    extract.add_argument("--verbose", "-v", action="store_true", help="log the steps")
    extract.add_argument("--quiet", "-q", action="store_true", help="no warnings and notes")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyspark").getOrCreate()
    if args.command == "demo":
        rel = StatementEngine().relations(build_tokens(demo_tokens(spark), Settings()))
        rel.transactions.orderBy("page_num", "row_id").select("txn_date", "description", "debit", "credit", "balance", "validation_status").show(truncate=34)
        return 0
    engine = StatementEngine(Settings(max_pages=args.max_pages, fuzzy=not args.no_fuzzy, repair=args.repair))
    if args.format == "tokens":
        raw = spark.read.parquet(args.path).withColumn("source_file", F.col("_metadata.file_path"))
        files = token_files(raw)
    else:
        pages = read_pages(spark, args.path, int(args.format[1]))
        raw, files = (lines_v3 if args.format == "v3" else lines_v2)(pages), page_files(pages)
    if args.verbose:
        logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    if args.doc_id is not None:
        raw, files = (df.filter(F.col("doc_id") == args.doc_id) for df in (raw, files))
    rel = engine.relations(build_tokens(raw, engine.settings), files, counted=args.verbose and bool(args.json) and args.doc_id is None)
    LOG.info("%s as %s, under %s", args.path, args.format, engine)
    if args.debug:
        write_overlay(rel, args.debug)
        write_drawings(rel, f"{args.debug.rstrip('/')}/pages")
        LOG.info("overlay: %s", args.debug)
    if args.doc_id is None and args.each:
        for path, kind in ((args.json, "json"), (args.csv, "csv")):
            if path:
                write_documents(rel.manifests, rel.transactions, path, kind)
                if not args.quiet:
                    print(f"saved: {path}")
        rel.log_counts()
        return 0
    if args.doc_id is None:
        for path, write, df in ((args.json, write_json, rel.results), (args.csv, write_csv, rel.transactions)):
            if path:
                write(df, path)
                if not args.quiet:
                    print(f"saved: {path}")
        rel.log_counts()
        return 0
    result = one(rel.results, args.doc_id)
    if not args.quiet:
        for w in result["extraction_warnings"]:
            print(f"[WARN] {w}", file=sys.stderr)
    for path, save in ((args.json, save_json), (args.csv, save_csv)):
        if path:
            save(result, path)
            if not args.quiet:
                print(f"saved: {path}")
    print(json.dumps(summary(result, rel.transactions), indent=2, ensure_ascii=False))
    return 0
