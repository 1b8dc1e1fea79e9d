"""Exact single files of all documents, one each, written by the tasks that hold them.

A document's manifest and its transactions are rows of one relation, sorted by document within a task; the writer
streams them, so neither the driver nor a task ever holds a whole document, however many transactions it has. A file is
the same, byte by byte, as the one that save_json() or save_csv() gives for one document.

A task writes under _temporary in the folder and moves its files into place once it's through, so an attempt that is
lost or runs twice leaves no torn file; what's there by the same name is replaced. _SUCCESS says that all are written;
a failed job leaves whole files of some documents and no _SUCCESS. The folder may be any that pyarrow.fs can write.
"""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.overlay import page_drawings
from ..operators.results import FIELDS
from .sinks import manifest, overlay_layers, page_sizes, plain_row

if TYPE_CHECKING:
    from ..plans.engine import Relations


def json_parts(head: Row, rows: Iterator[Row]) -> Iterator[str]:
    """The text of save_json() in parts, a transaction each."""
    yield json.dumps(manifest(head, head["total_transactions"]), indent=2, ensure_ascii=False)[:-2] + ',\n  "transactions": ['
    mark = None
    for mark, t in zip(_marks(), rows, strict=False):
        yield mark + "\n    " + json.dumps(plain_row(t), indent=2, ensure_ascii=False).replace("\n", "\n    ")
    yield "]\n}" if mark is None else "\n  ]\n}"


def _marks() -> Iterator[str]:
    yield ""
    while True:
        yield ","


def csv_parts(head: Row, rows: Iterator[Row]) -> Iterator[str]:
    """The text of save_csv() in parts, a transaction each."""
    held = io.StringIO(newline="")
    writer = csv.DictWriter(held, FIELDS, extrasaction="ignore")
    held.write("\ufeff")
    writer.writeheader()
    yield held.getvalue()
    for t in rows:
        held.seek(0)
        held.truncate()
        writer.writerow(plain_row(t))
        yield held.getvalue()


def svg_parts(head: Row, rows: Iterator[Row]) -> Iterator[str]:
    """The text of a page's drawing."""
    yield head["svg"]
    yield from (t["svg"] for t in rows)


PARTS: dict[str, Callable[[Row, Iterator[Row]], Iterator[str]]] = {"json": json_parts, "csv": csv_parts, "svg": svg_parts}


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    documents: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.job = path, kind, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = at(self.path)
        own = f"{folder}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names: list[str] = []
        row = next(iterator, None)
        while row:
            head, name = row, f"{'null' if row['doc_id'] is None else row['doc_id']}.{self.kind}"

            def rows() -> Iterator[Row]:
                nonlocal row
                row = next(iterator, None)
                while row and row["doc_id"] == head["doc_id"]:
                    if row["txn"]:
                        yield row["txn"]
                    row = next(iterator, None)

            with store.open_output_stream(f"{own}/{name}") as out:
                for part in PARTS[self.kind](head["head"], rows()):
                    out.write(part.encode())
            names.append(name)
        for name in names:
            store.move(f"{own}/{name}", f"{folder}/{name}")
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = at(self.path)
        self.clear()
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, folder = at(self.path)
        own = f"{folder}/_temporary/{self.job}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
        above = f"{folder}/_temporary"
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class DocumentFiles(DataSource):
    """df.write.format("document_files").option("kind", "json", "csv" or "svg").mode("append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        kind = self.options.get("kind", "json")
        if kind not in PARTS:
            raise ValueError(f"kind is json, csv or svg, not {kind}")
        return Writer(self.options["path"], kind)


def document_rows(heads: DataFrame, transactions: DataFrame) -> DataFrame:
    """doc_id, head, txn: each document's manifest, then its transactions in order, whole documents in a task. A
    transaction without a manifest is left out, as results() does."""
    head = heads.select("doc_id", F.lit(0).alias("_k"), F.lit(0).alias("page_num"), F.lit(0).alias("row_id"), F.struct(*[c for c in heads.columns if c != "doc_id"]).alias("head"))
    fields = [c for c in transactions.columns if c not in ("doc_id", "row_id")]
    body = transactions.join(heads.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(1).alias("_k"), "page_num", "row_id", F.struct(*fields).alias("txn"))
    both = head.unionByName(body, allowMissingColumns=True).repartition("doc_id")
    return both.sortWithinPartitions("doc_id", "_k", "page_num", "row_id").select("doc_id", "head", "txn")


def write_documents(heads: DataFrame, transactions: DataFrame, path: str, kind: str = "json") -> None:
    """A file for each document in the folder path, named by its doc_id."""
    heads.sparkSession.dataSource.register(DocumentFiles)
    document_rows(heads, transactions).write.format(DocumentFiles.name()).option("kind", kind).mode("append").save(path)


def write_drawings(relations: Relations, path: str) -> None:
    """A drawing of each page in the folder path, named by document and page."""
    drawn = page_drawings(**overlay_layers(relations), pages=page_sizes(relations.tokens))
    name = F.format_string("%d_page_%03d_debug", "doc_id", "page_num")
    drawn.sparkSession.dataSource.register(DocumentFiles)
    rows = drawn.select(name.alias("doc_id"), F.struct("svg").alias("head"), F.lit(None).cast("struct<svg:string>").alias("txn"))
    rows.write.format(DocumentFiles.name()).option("kind", "svg").mode("append").save(path)
