"""Validation, whole statements, sources, sinks, command line, streams."""

import csv
import json
import random
from itertools import groupby
from xml.etree import ElementTree

from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.config import Settings
from tallyspark.operators.results import NO_ROWS, NO_TRANSACTIONS, NO_ZONES
from tallyspark.operators.tokens import build_tokens
from tallyspark.operators.validate import validate
from tallyspark.plans.engine import StatementEngine
from tallyspark.schemas import RAW_OCR_V2, RAW_OCR_V3, RAW_TOKENS, TRANSACTIONS
from tallyspark.sources.demo import START_CENTS, demo_rows, demo_tokens
from tallyspark.sources.files import recognise, statement_files
from tallyspark.sources.raw_ocr import lines_v2, lines_v3, poly_to_box
from tallyspark.sources.sinks import one, save_csv, save_json, write_csv, write_json
from tallyspark.streaming.batches import extract_stream

DEMO = [
    ("02-06-2025", "Brought forward", "", "", "8,150.00"),
    ("04-06-2025", "CARD-PHARMACY 0417", "46.35", "", "8,103.65"),
    ("04-06-2025", "Refund of deposit", "", "310.00", "8,413.65"),
    ("09-06-2025", "STANDING ORDER GYM", "29.90", "", "8,383.75"),
    ("16-06-2025", "Wages week 24", "", "1,268.40", "9,652.15"),
    ("17-06-2025", "Cash at counter", "500.00", "", "9,152.15"),
]


def ledger(spark, lines):
    return spark.createDataFrame([(d, 0, i, None, None, None, a, b, c, 0.9, "needs_review", "") for i, (d, a, b, c) in enumerate(lines)], TRANSACTIONS)


def statuses(spark, lines, **settings):
    return [(r["validation_status"], round(r["confidence_score"], 6)) for r in validate(ledger(spark, [(1, *x) for x in lines]), Settings(**settings)).orderBy("row_id").collect()]


def test_validation(spark):
    assert statuses(spark, [(None, None, 640.0), (None, 35.5, 675.5), (75.5, None, 600.0)]) == [("needs_review", 0.9), ("validated", 1.0), ("validated", 1.0)]
    assert statuses(spark, [(None, 12.0, None), (7.25, None, None), (None, 3.0, None)]) == [("needs_review", 0.9)] * 3
    assert [x[0] for x in statuses(spark, [(None, None, 640.0), (None, 60.0, 706.9), (None, 60.0, 775.0)])] == ["needs_review", "validated", "failed"]
    assert statuses(spark, [(None, None, 640.0), (40.0, None, 910.0), (None, 5.0, 915.0)]) == [("needs_review", 0.9), ("failed", 0.7), ("validated", 1.0)]
    assert statuses(spark, [(None, None, 640.0), (90.0, None, 730.0)], repair=True)[1] == ("repaired", 0.9)
    assert statuses(spark, []) == []


def fold(lines):
    """The statuses by one walk over the rows."""
    seen = [b for _, _, b in lines if b is not None]
    if len(seen) < 2:
        return ["needs_review"] * len(lines)
    state, out = None, []
    for d, c, b in lines:
        if b is None:
            out.append("needs_review")
            continue
        if state is None:
            state = b + d if d else b - c if c else b
        want = None if d is None and c is None else state + (c or 0) - (d or 0)
        out.append("needs_review" if want is None else "validated" if abs(b - want) <= 0.01 * max(abs(b), 1) else "failed")
        state = b
    return out


def test_validation_equals_a_fold(spark):
    rng = random.Random(5)
    some = lambda v: v if rng.random() < 0.6 else None
    books = [[(some(float(rng.randrange(4))), some(float(rng.randrange(4))), some(float(rng.randrange(-3, 9)))) for _ in range(rng.randrange(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(k, 0, i, None, None, None, d, c, b, 0.5, "needs_review", "") for k, book in enumerate(books) for i, (d, c, b) in enumerate(book)], TRANSACTIONS)
    got = {(r["doc_id"], r["row_id"]): r["validation_status"] for r in validate(df, Settings()).collect()}
    assert [[got[k, i] for i in range(len(b))] for k, b in enumerate(books)] == [fold(b) for b in books]


def demo(spark, doc=7):
    xs = (60, 200, 500, 650, 790)
    rows = []
    for n, line in enumerate([("Date", "Description", "Debit", "Credit", "Balance"), *DEMO, *[x for x in DEMO[1:]]]):
        for x, t in zip(xs, line, strict=True):
            if t:
                rows.append((doc, 0, len(rows), f" {t} ", 0.95, float(x), 90.0 + 40 * n, x + 60.0, 106.0 + 40 * n, 900.0, 1000.0))
    rows.append((doc, 0, 900, "faint", 0.1, 0.0, 0.0, 9.0, 9.0, 900.0, 1000.0))
    return spark.createDataFrame(rows, RAW_TOKENS)


def test_statement(spark, tmp_path):
    engine = StatementEngine()
    rel = engine.relations(build_tokens(demo(spark), engine.settings))
    got = rel.transactions.orderBy("row_id").collect()
    assert len(got) == 11
    assert [r["txn_date"] for r in got[:6]] == [x[0] for x in DEMO]
    assert [r["balance"] for r in got[:3]] == [8150.0, 8103.65, 8413.65]
    result = one(rel.results, 7)
    assert result["total_pages"] == 1 and len(result["transactions"]) == 11 and set(result["column_mapping"]) <= set("01234")
    save_json(result, str(tmp_path / "a" / "x.json"))
    save_csv(result, str(tmp_path / "b" / "x.csv"))
    data = json.loads((tmp_path / "a" / "x.json").read_text())
    assert data["total_transactions"] == 11 and data["transactions"][0]["debit"] == ""
    raw = (tmp_path / "b" / "x.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    assert len(list(csv.DictReader(raw.decode("utf-8-sig").splitlines()))) == 11
    write_csv(rel.transactions, str(tmp_path / "csv"))
    write_json(rel.results, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 11
    assert spark.read.json(str(tmp_path / "json")).first()["total_transactions"] == 11


def test_warnings(spark):
    engine = StatementEngine()
    files = spark.createDataFrame([(1, "a", 2, None), (2, "b", 0, "broken"), (3, "c", 1, None)], "doc_id long, source_file string, total_pages int, error string")
    raw = spark.createDataFrame([(3, 0, 0, "hello there", 0.9, 1.0, 1.0, 9.0, 9.0, 100.0, 100.0)], RAW_TOKENS)
    got = {r["doc_id"]: r for r in engine.extract(raw, files).collect()}
    assert got[1]["extraction_warnings"] == [NO_ROWS] and got[1]["total_pages"] == 2
    assert got[2]["extraction_warnings"] == ["OCR error: broken"] and got[2]["total_pages"] == 0
    assert got[3]["extraction_warnings"] == [NO_ZONES, NO_TRANSACTIONS]


def test_page_limit_keeps_the_count(spark):
    raw = demo(spark).unionByName(demo(spark).withColumn("page_num", F.lit(1)))
    got = StatementEngine(Settings(max_pages=1)).extract(raw).first()
    assert got["total_pages"] == 2 and {t["page_num"] for t in got["transactions"]} == {0}


def box(x):
    return [[x, 1.0], [x + 2, 1.0], [x + 2, 3.0], [x, 3.0]]


def test_pages(spark):
    v3 = spark.createDataFrame([(1, 0, 10.0, 10.0, ["a", "b", "c"], [0.9, 0.8], [box(1.0), box(2.0), box(3.0)], None), (1, 1, 10.0, 10.0, ["d"], [0.9], None, [box(5.0)]), (1, 2, 10.0, 10.0, None, None, None, None)], RAW_OCR_V3)
    assert sorted((r["page_num"], r["token_ord"], r["text"], r["x1"], r["x2"]) for r in lines_v3(v3).collect()) == [(0, 0, "a", 1.0, 3.0), (0, 1, "b", 2.0, 4.0), (1, 0, "d", 5.0, 7.0)]
    v2 = spark.createDataFrame([(1, 0, 10.0, 10.0, [(box(1.0), "a", None), (None, "b", 0.5), None])], RAW_OCR_V2)
    assert [(r["text"], r["confidence"]) for r in lines_v2(v2).collect()] == [("a", 1.0)]
    polys = spark.createDataFrame([(None,), ([],), ([[]],), (box(1.0),)], "p array<array<double>>")
    assert [r[0] is None for r in polys.select(poly_to_box(F.col("p"))).collect()] == [True, True, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"ok")
    (tmp_path / "two.PNG").write_bytes(b"bad")

    def read(content, suffix):
        if content == b"bad":
            raise ValueError("no image")
        return [(100.0, 100.0, [("50.00", 0.9, 1.0, 2.0, 3.0, 4.0)]), (100.0, 100.0, [])]

    found = statement_files(spark, str(tmp_path))
    assert sorted(r["kind"] for r in found.collect()) == ["image", "pdf"]
    raw, files = recognise(found, read)
    assert [(r["page_num"], r["text"], r["width"]) for r in raw.collect()] == [(0, "50.00", 100.0)]
    assert sorted((r["total_pages"], r["error"]) for r in files.collect()) == [(0, "no image"), (2, None)]


def test_command_line(spark, tmp_path, capsys):
    demo(spark).write.parquet(str(tmp_path / "tokens"))
    assert cli.main(["extract", str(tmp_path / "tokens"), "--format", "tokens", "--doc-id", "7", "--csv", str(tmp_path / "o.csv"), "-q"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["total_txn"] == 11 and said["transactions"][1]["debit"] == 46.35
    assert cli.main(["extract", str(tmp_path / "tokens"), "--format", "tokens", "--json", str(tmp_path / "all"), "--no-fuzzy"], spark) == 0
    assert spark.read.json(str(tmp_path / "all")).count() == 1


def test_demo(spark, capsys):
    rel = StatementEngine().relations(build_tokens(demo_tokens(spark), Settings()))
    got = rel.transactions.orderBy("page_num", "row_id").collect()
    number = lambda x: float(x.replace(",", "")) if x else None
    assert [(r["txn_date"], r["reference_no"], r["debit"], r["credit"], r["balance"]) for r in got] == [(d, n or None, number(a), number(b), number(c)) for d, n, _, a, b, c in demo_rows()]
    assert [r["description"] for r in got] == [x[2] for x in demo_rows()]
    assert {r["validation_status"] for r in got} == {"validated"} and got[0]["balance"] - got[0]["credit"] == START_CENTS / 100
    assert cli.main(["demo"], spark) == 0
    assert "Trailer tyres" in capsys.readouterr().out


def test_overlay_and_one_statement(spark, tmp_path, caplog):
    demo(spark).write.parquet(str(tmp_path / "tokens"))
    assert cli.main(["extract", str(tmp_path / "tokens"), "--format", "tokens", "--debug", str(tmp_path / "drawn"), "-q", "-v"], spark) == 0
    drawn = {name: spark.read.json(str(tmp_path / "drawn" / name)).collect() for name in ("zones", "rows", "tokens")}
    assert {r["label"] for r in drawn["zones"]} >= {"debit", "credit", "balance"} and {r["y2"] for r in drawn["zones"]} == {1000}
    assert len(drawn["rows"]) == 12 and sum(r["kind"] == "header" for r in drawn["rows"]) == 1
    assert len(drawn["tokens"]) == build_tokens(demo(spark), Settings()).count()
    pages = sorted((tmp_path / "drawn" / "pages").glob("*.svg"))
    assert [p.name for p in pages] == ["7_page_000_debug.svg"]
    root = ElementTree.parse(pages[0]).getroot()
    kinds = [e.get("class", "label").split()[0] for e in root if e.tag.endswith("rect") or e.get("class") == "label"]
    assert [k for k, _ in groupby(kinds)] == ["zone", "row", "box", "label"]
    assert {k: kinds.count(k) for k in kinds} == {"zone": len(drawn["zones"]), "row": 12, "box": len(drawn["tokens"]), "label": len(drawn["tokens"])}
    boxes = [tuple(int(e.get(k)) for k in ("x", "y", "width", "height")) for e in root if e.get("class", "").startswith("box")]
    assert boxes == [(r["x1"], r["y1"], r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in sorted(drawn["tokens"], key=lambda r: r["token_ord"])]
    assert [e.text for e in root if e.get("class") == "label"] == [r["label"] for r in sorted(drawn["tokens"], key=lambda r: r["token_ord"])]
    with caplog.at_level("INFO", "tallyspark"):
        found = StatementEngine().extract_one(demo(spark), 7)
    assert found.total_pages == 1 and len(found.transactions) == 11 and "11 transactions" in caplog.text
    found.save_json(str(tmp_path / "x.json"))
    found.save_csv(str(tmp_path / "x.csv"))
    assert json.loads((tmp_path / "x.json").read_text())["total_transactions"] == 11 and (tmp_path / "x.csv").stat().st_size > 100


def test_stream(spark, tmp_path):
    demo(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(demo(spark).schema).parquet(str(tmp_path / "in"))
    extract_stream(stream, StatementEngine(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [len(r["transactions"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [11]
