"""Tokens to validated statements: every stage is a relation that can be asked for on its own."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.arrays import dealt
from ..operators.columns import assigned, zones
from ..operators.results import manifests, results
from ..operators.roles import document_bands, unpacked
from ..operators.rows import gathered, merged_rows, parts, row_tokens, slim, tokens_of
from ..operators.tokens import build_tokens, page_limit
from ..operators.transactions import reconstruct, routed
from ..operators.validate import validate
from ..sources.raw_ocr import token_files
from ..sources.sinks import one, save_csv, save_json

LOG = logging.getLogger("tallyspark")


@dataclass(frozen=True)
class Relations:
    """What the stages give, in order; all lazy."""

    tokens: DataFrame
    placed: DataFrame
    parts: DataFrame
    merged: DataFrame
    rows: DataFrame
    zones: DataFrame
    routed: DataFrame
    raw_transactions: DataFrame
    transactions: DataFrame
    results: DataFrame
    manifests: DataFrame
    #: Rows of the stages, counted by whatever job runs them first (see log_counts).
    counts: dict[str, Observation] = field(default_factory=dict)

    def log_counts(self) -> None:
        """Logs the stages' rows after results were written, without a further job."""
        for stage, seen in self.counts.items():
            LOG.info("%s: %d", stage, seen.get["n"])


class Statement:
    """One document's result on the driver: as large as one statement."""

    def __init__(self, row: Row):
        self.row = row

    def __getattr__(self, name: str):
        return self.row[name]

    def save_json(self, path: str) -> None:
        save_json(self.row, path)

    def save_csv(self, path: str) -> None:
        save_csv(self.row, path)


class StatementEngine:
    """Extracts the statements of a token relation under fixed settings. Documents are independent of each other, so
    everything is dealt by doc_id; a document's columns are a handful of rows that travel with its tokens."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def relations(self, tokens: DataFrame, files: DataFrame | None = None, counted: bool = False) -> Relations:
        """tokens: as build_tokens() gives them. files: doc_id, source_file, total_pages, error (null where it could be
        read; else nothing of the document is extracted), a result row each; without it, the documents that have tokens,
        with the pages up to the last one and no file name. counted: the stages' rows are counted as jobs run them."""
        s = self.settings
        counts: dict[str, Observation] = {}

        def seen(stage: str, df: DataFrame, n: Column | None = None) -> DataFrame:
            if not counted:
                return df
            counts[stage] = Observation(stage)
            return df.observe(counts[stage], (F.count(F.lit(1)) if n is None else n).alias("n"))

        if files is None:
            files = token_files(tokens)
        else:
            tokens = tokens.join(files.filter("error is not null").select("doc_id"), "doc_id", "left_anti")
        tokens = seen("tokens", page_limit(tokens, s))
        placed = row_tokens(tokens, s)
        rows = seen("rows", gathered(placed, s))
        # two deals by doc_id, each made once whatever reads it: rows with their tokens, and a row per document with its bands
        joined = merged_rows(rows)
        merged = tokens_of(joined)
        whole = dealt(slim(joined), "doc_id")
        n_bands = F.coalesce(F.sum(F.when(F.col("bands").isNotNull(), F.size("bands"))), F.lit(0))
        docs = dealt(seen("zones", document_bands(whole, zones(tokens_of(whole), s), s), n_bands), "doc_id")
        found = unpacked(docs)
        bands = docs.select("doc_id", "bands")
        to = routed(assigned(merged.join(bands, "doc_id", "left"), merged.columns, "bands", s))
        read = whole.join(bands, "doc_id", "left")
        raw = reconstruct(read, s)
        done = seen("transactions", validate(raw, s))
        return Relations(tokens, placed, parts(rows), merged, read, found, to, raw, done, results(files, docs, done), manifests(files, docs, done), counts)

    def extract(self, raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """One row per document from recognised texts; without files, the documents that have any row in raw."""
        return self.relations(build_tokens(raw, self.settings), token_files(raw) if files is None else files).results

    def extract_one(self, raw: DataFrame, doc_id: int, files: DataFrame | None = None) -> Statement:
        """The statement of one document."""
        said = one(self.extract(raw.filter(F.col("doc_id") == doc_id), files), doc_id)
        for w in said["extraction_warnings"]:
            LOG.warning("document %s: %s", doc_id, w)
        LOG.info("document %s: %d pages, %d transactions", doc_id, said["total_pages"], len(said["transactions"]))
        return Statement(said)

    def __repr__(self) -> str:
        return f"StatementEngine(fuzzy={self.settings.fuzzy}, max_pages={self.settings.max_pages})"
