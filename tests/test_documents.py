"""A result row for every document, and balances carried over pages."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.cli import main
from tallyspark.config import Settings
from tallyspark.operators.results import NO_ROWS
from tallyspark.operators.tokens import build_tokens
from tallyspark.operators.validate import expectations, paged_expectations, validate
from tallyspark.plans.engine import StatementEngine
from tallyspark.sources.document_files import Writer, write_documents
from tallyspark.sources.raw_ocr import lines_v3, page_files, read_pages
from tallyspark.sources.sinks import save_csv, save_json


def page(doc_id, n, texts):
    box = lambda i: [[10.0 + 300 * (i % 3), 50.0 + 40 * (i // 3)], [60.0 + 300 * (i % 3), 60.0 + 40 * (i // 3)]]
    return json.dumps({"doc_id": doc_id, "page_num": n, "width": 1000.0, "height": 1000.0, "rec_texts": texts, "rec_scores": [0.9] * len(texts), "rec_polys": [box(i) for i in range(len(texts))]})


LEDGER = ["Date", "Particulars", "Balance", "01/02/2024", "oars", "100.00", "02/02/2024", "rope", "140.00", "03/02/2024", "tea", "90.00"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text("\n".join([page(1, 0, LEDGER), page(1, 1, []), page(2, 0, []), "", page(3, 0, ["  ", " "])]))
    (tmp_path / "b.json").write_text("\n".join([page(4, 1, LEDGER), page(4, 0, LEDGER)[:60], page(5, 0, LEDGER)]))
    (tmp_path / "c.json").write_text("no json at all\n" + json.dumps({"page_num": 3}))
    return tmp_path


def test_every_document_has_a_row(spark, folder):
    pages = read_pages(spark, str(folder))
    rows = StatementEngine().extract(lines_v3(pages), page_files(pages)).collect()
    said = {r["doc_id"]: (r["source_file"].rsplit("/", 1)[1], r["total_pages"], r["extraction_warnings"], len(r["transactions"])) for r in rows}
    own = next(d for d in said if d not in (1, 2, 3, 4, 5))
    assert said.pop(own) == ("c.json", 0, ["OCR error: broken record"], 0)
    assert said[1][:2] == ("a.json", 2) and said[1][3] == 3 and said[5][3] == 3
    assert said[2] == ("a.json", 1, [NO_ROWS], 0) and said[3] == ("a.json", 1, [NO_ROWS], 0)
    assert said[4] == ("b.json", 0, ["OCR error: broken record"], 0)


def test_command_line_gives_files_and_counts(spark, folder, tmp_path, caplog):
    caplog.set_level("INFO", "tallyspark")
    assert main(["extract", str(folder), "--json", str(tmp_path / "out"), "-v", "-q"], spark) == 0
    found = {r["doc_id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert len(found) == 6 and found[2]["source_file"].endswith("a.json") and found[1]["total_transactions"] == 3
    said = dict(r.getMessage().split(": ") for r in caplog.records if r.getMessage().split(":")[0] in ("tokens", "rows", "zones", "transactions"))
    assert said["tokens"] == "24" and said["transactions"] == "6"


def test_a_file_for_each_document_equals_single_ones(spark, folder, tmp_path):
    pages = read_pages(spark, str(folder))
    rel = StatementEngine().relations(build_tokens(lines_v3(pages), Settings()), page_files(pages))
    for kind, save in (("json", save_json), ("csv", save_csv)):
        out = tmp_path / f"each_{kind}"
        for _ in range(2):  # files of an earlier run are replaced
            write_documents(rel.manifests, rel.transactions, str(out), kind)
        found = rel.results.collect()
        assert {p.name for p in out.iterdir()} == {f"{r['doc_id']}.{kind}" for r in found} | {"_SUCCESS"}
        for r in found:
            save(r, str(tmp_path / "one"))
            assert (out / f"{r['doc_id']}.{kind}").read_bytes() == (tmp_path / "one").read_bytes(), (kind, r["doc_id"])


def test_files_of_odd_values(spark, tmp_path):
    """Line ends, quotes and marks in texts, nulls, a document of most rows, one without any, a transaction without document."""
    says = ['a "b", c', "x\r\ny\n", "é\u2028\ufeff", None, "", "\\\\"]
    txns = spark.range(3_000, numPartitions=7).select(
        (F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(1)).alias("doc_id"), (F.col("id") % 9).cast("int").alias("page_num"), F.col("id").cast("int").alias("row_id"),
        F.lit("2024-01-02").alias("txn_date"), F.array(*map(F.lit, says))[(F.col("id") % 6).cast("int")].alias("description"), F.lit(None).cast("string").alias("reference_no"),
        F.when(F.col("id") % 2 == 0, F.col("id") / 7).alias("debit"), (F.col("id") * 1e14).alias("credit"), F.lit(0.1).alias("balance"), F.lit(0.123456).alias("confidence_score"), F.lit("failed").alias("validation_status"), F.lit("raw\ttext").alias("raw_text"),
    )
    counts = {r["doc_id"]: r["n"] for r in txns.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    heads = spark.createDataFrame([(d, "f\n" if d else None, 2, {"date": "col"} if d else {}, ["w"] * d, counts.get(d, 0)) for d in (0, 1, 2, 3, 9)], "doc_id long, source_file string, total_pages int, column_mapping map<string,string>, extraction_warnings array<string>, total_transactions long")
    for kind, save in (("json", save_json), ("csv", save_csv)):
        write_documents(heads, txns, str(tmp_path / kind), kind)
        assert {p.name for p in (tmp_path / kind).iterdir()} == {f"{d}.{kind}" for d in (0, 1, 2, 3, 9)} | {"_SUCCESS"}
        for h in heads.collect():
            rows = txns.filter(F.col("doc_id") == h["doc_id"]).orderBy("page_num", "row_id").collect()
            save({**h.asDict(), "transactions": rows}, str(tmp_path / "one"))
            assert (tmp_path / kind / f"{h['doc_id']}.{kind}").read_bytes() == (tmp_path / "one").read_bytes()


def test_a_failed_task_leaves_no_torn_file(spark, tmp_path):
    head = Row(source_file="f", total_pages=1, total_transactions=1, column_mapping={}, extraction_warnings=[])
    writer = Writer(str(tmp_path), "json")

    def rows():
        yield Row(doc_id=1, head=head, txn=None)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    writer.abort([None])
    assert list(tmp_path.iterdir()) == []


def test_command_line_gives_a_file_each(spark, folder, tmp_path):
    assert main(["extract", str(folder), "--each", "--json", str(tmp_path / "out"), "-q"], spark) == 0
    said = json.loads((tmp_path / "out" / "1.json").read_text())
    assert said["total_transactions"] == 3 == len(said["transactions"]) and said["source_file"].endswith("a.json")


def test_documents_of_raw_rows_without_texts_stay(spark):
    raw = spark.createDataFrame([(1, 2, 0, " ", 0.9, 0.0, 0.0, 1.0, 1.0, 10.0, 10.0)], "doc_id long, page_num int, token_ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, width double, height double")
    (row,) = StatementEngine().extract(raw).collect()
    assert (row["doc_id"], row["total_pages"], row["extraction_warnings"]) == (1, 3, [NO_ROWS])


def test_balances_over_pages_equal_the_scan_of_rows(spark):
    """Documents of many pages, without balances, with pages without any, with null keys; one holds most rows."""
    k = F.col("id")
    money = lambda n: F.when(k % n != 0, (k * 37 % 1000).cast("double"))
    rows = spark.range(4000).select(
        F.when(k % 500 != 9, F.when(k % 3 == 0, k % 9).otherwise(1)).alias("doc_id"), F.when(k % 97 != 5, k % 41).cast("int").alias("page_num"), k.cast("int").alias("row_id"),
        money(3).alias("debit"), money(4).alias("credit"), F.when((k % 41 > 3) & (k % 9 != 6), money(5)).alias("balance"), F.lit(0.5).alias("confidence_score"), F.lit("needs_review").alias("validation_status"),
    )
    show = lambda df: sorted(map(str, df.collect()))
    names = ["doc_id", "page_num", "row_id", "n_balances", "prev_balance", "expected"]
    assert show(paged_expectations(rows).select(names)) == show(expectations(rows).select(names))
    for s in (Settings(), Settings(repair=True)):
        assert show(validate(rows, s, paged=True)) == show(validate(rows, s))
    assert paged_expectations(rows.limit(0)).count() == 0
