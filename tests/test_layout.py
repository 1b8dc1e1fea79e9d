"""Rows, columns and roles on small pages."""

import random
import re
import time

from pyspark.sql import functions as F

from tallyspark.config import Settings
from tallyspark.operators.cluster import density_1d, density_blocks
from tallyspark.operators.columns import assign, zones
from tallyspark.operators.roles import debit_left_of_credit, heading_tokens, infer_roles, zone_texts
from tallyspark.operators.rows import full_texts, gathered, merged_tokens, parts, row_tokens
from tallyspark.plans import catalog
from tallyspark.plans.engine import StatementEngine
from tallyspark.schemas import TOKENS, ZONES

from .conftest import TABLES

S = Settings()
BANDS = [(0.08, 0.04, 0.15), (0.33, 0.2, 0.52), (0.61, 0.57, 0.68), (0.75, 0.7, 0.81), (0.9, 0.86, 0.97)]


def page(spark, tokens):
    """tokens: (text, x, y, is_numeric, is_date)."""
    return spark.createDataFrame([(1, 0, i, t, 0.95, x * 900, y * 700, x * 900 + 60, y * 700 + 14, x * 900 + 30, y * 700 + 7, x, y, num, day) for i, (t, x, y, num, day) in enumerate(tokens)], TOKENS)


def merged(spark, tokens):
    placed = row_tokens(page(spark, tokens), S)
    rows = gathered(placed, S)
    return placed, parts(rows), merged_tokens(rows)


def test_rows_and_order(spark):
    found = row_tokens(page(spark, [("b", 0.05, 0.6, False, False), ("a", 0.05, 0.2, False, False), ("c", 0.5, 0.205, False, False)]), S).collect()
    assert {r["text"]: r["part_id"] for r in found} == {"a": 0, "c": 0, "b": 1}
    assert row_tokens(page(spark, []), S).count() == 0


def test_headings_come_before_continuations(spark):
    flags = merged(spark, [("17-11-2025", 0.05, 0.2, False, True), ("pay", 0.2, 0.2, False, False), ("318.75", 0.8, 0.2, True, False), ("more text", 0.2, 0.225, False, False)])[1].orderBy("part_id").collect()
    assert [(r["is_header"], r["is_continuation"]) for r in flags] == [(False, False), (True, False)]


def test_continuation_merges_beyond_the_first_rows(spark):
    tokens = [("318.75", 0.8, 0.1 + i / 20, True, False) for i in range(7)] + [("pay", 0.3, 0.4, False, False), ("more", 0.2, 0.422, False, False), ("again", 0.1, 0.444, False, False)]
    found = full_texts(merged(spark, tokens)[2]).orderBy("row_id").collect()
    assert len(found) == 7
    assert found[-1]["full_text"] == "again more pay 318.75"


def test_zones(spark):
    tokens = [(t, x, 0.1 + 0.1 * i, True, False) for i in range(5) for t, x in (("4.50", 0.11), ("6.25", 0.83))] + [("9.75", 0.6, 0.1, True, False), ("9.75", 0.6, 0.2, True, False)]
    found = zones(merged(spark, tokens)[2], S).orderBy("column_id").collect()
    assert [(r["column_id"], r["x_center"], r["support"]) for r in found] == [(0, 0.11, 5), (1, 0.83, 5)]


def test_zones_of_counted_places_equal_those_of_tokens(spark):
    """Labels and medians over tokens one by one; few places with many tokens each, one document holds most."""
    rng = random.Random(11)
    rows = [(min(d, 3), 0, i, 1, rng.randint(0, 60) / 90 if rng.random() < 0.9 else rng.random(), False, True, False) for d in range(12) for i in range(rng.choice((1, 2, 60, 61)))]
    tokens = spark.createDataFrame([*rows, (9, 0, 1, 1, None, False, True, False), (9, 0, 2, 1, 0.5, True, True, False)], "doc_id long, page_num int, row_id int, pos int, normalized_x double, is_header boolean, is_numeric boolean, is_date boolean")
    for least in (1, 2, 4):
        s = Settings(column_min_samples=least, column_eps=0.006)
        found = sorted((r["doc_id"], r["column_id"], r["x_center"], r["support"]) for r in zones(tokens, s).collect())
        each = tokens.filter("not is_header").withColumn("o", F.struct("page_num", "row_id", "pos"))
        labels = density_1d(each, ["doc_id"], "normalized_x", "o", s.column_eps, least, "label").filter("label >= 0")
        bands = labels.groupBy("doc_id", "label").agg(F.median("normalized_x").alias("c"), F.count("*").alias("n")).filter(F.col("n") >= s.column_support).collect()
        wanted = sorted((r["doc_id"], r["c"], r["n"]) for r in bands)
        assert [(d, c, n) for d, _, c, n in found] == wanted and len(wanted) > 5, least


def test_assignment(spark):
    bands = spark.createDataFrame([(1, 0, 0.62, 0.6, 0.64, 5, None), (1, 1, 0.78, 0.76, 0.8, 5, "balance")], ZONES)
    tokens = merged(spark, [("a", 0.62, 0.1, False, False), ("b", 0.78, 0.1, False, False), ("c", 0.7, 0.1, False, False), ("d", 0.735, 0.1, False, False)])[2]
    found = {r["text"]: (r["column_id"], r["role"]) for r in assign(tokens, bands, S).collect()}
    assert found == {"a": (0, "unknown"), "b": (1, "balance"), "c": (-1, "unknown"), "d": (1, "balance")}
    assert {r["column_id"] for r in assign(tokens, bands.limit(0), S).collect()} == {-1}


def inferred(spark, heads):
    bands = spark.createDataFrame([(1, i, c, a, b, 5, None) for i, (c, a, b) in enumerate(BANDS)], ZONES)
    tokens = [(t, c, 0.05, False, False) for t, (c, _, _) in zip(heads, BANDS, strict=False)] + [("1.00", 0.93, 0.3, True, False)]
    return [r["semantic_role"] for r in infer_roles(bands, merged(spark, tokens)[2], S).orderBy("column_id").collect()]


def test_roles(spark):
    in_order = ["date", "narration", "debit", "credit", "balance"]
    assert inferred(spark, ["Posting Date", "Narration", "Debit Amount", "Credit Amount", "Net Balance"]) == in_order
    assert inferred(spark, ["Value Date", "Details", "Debits", "Credits", "Bal"]) == in_order
    assert inferred(spark, []) == in_order


def test_heading_in_two_bands(spark):
    bands = spark.createDataFrame([(1, 0, 0.3, 0.2, 0.41, 5, None), (1, 1, 0.5, 0.39, 0.6, 5, None)], ZONES)
    m = merged(spark, [("Debit", 0.4, 0.05, False, False)])[2]
    assert heading_tokens(m, bands).count() == 2
    assert {r["zone_text"] for r in zone_texts(m, bands).collect()} == {"debit"}


def test_each_deal_is_made_once(spark, capsys):
    """Whatever reads the rows of documents reads one shuffle of them: bands, headings and transactions alike."""
    tokens = page(spark, [("Date", 0.08, 0.05, False, False)] + [("318.75", 0.9, 0.2 + i / 20, True, False) for i in range(4)])
    for name, df in (("transactions", (rel := StatementEngine(S).relations(tokens)).transactions), ("manifests", rel.manifests)):
        df.collect()
        df.explain()
        final = capsys.readouterr().out.split("== Initial Plan ==")[0]
        assert len(re.findall(r"- Exchange hashpartitioning\(doc_id[^)]*\), REPARTITION_BY_COL", final)) == 2, name
        assert "ReusedExchange" in final, name


def test_roles_of_many_bands_cost_little(spark):
    """The steps of the inference don't multiply: expressions copied into each other took minutes for these."""
    bands = [(d, i, (i + 0.5) / 12, i / 12, (i + 1) / 12, 5, None) for d in range(300) for i in range(12)]
    heads = [(d, 0, i, t, 0.95, 0.0, 0.0, 9.0, 9.0, 4.0, 4.0, (i + 0.5) / 12, 0.05, False, False) for d in range(300) for i, t in enumerate(("Date", "Details", "Debit", "Credit", "Balance"))]
    tokens = merged_tokens(gathered(row_tokens(spark.createDataFrame(heads, TOKENS), S), S))
    began = time.time()
    found = infer_roles(spark.createDataFrame(bands, ZONES), tokens, S).filter("doc_id = 299").orderBy("column_id").collect()
    assert [r["semantic_role"] for r in found[:5]] == ["date", "narration", "debit", "credit", "balance"] and all(r["semantic_role"] is None for r in found[5:])
    assert time.time() - began < 60


def test_swap(spark):
    bands = spark.createDataFrame([(1, 0, 0.3, 0.2, 0.4, 5, "credit"), (1, 1, 0.5, 0.45, 0.6, 5, "debit")], ZONES)
    assert [r["semantic_role"] for r in debit_left_of_credit(bands).orderBy("column_id").collect()] == ["debit", "credit"]


def textbook(points, eps, least):
    """Labels by expansion in input order; -1 is noise."""
    near = [[j for j, y in enumerate(points) if abs(x - y) <= eps] for x in points]
    label, n = [None] * len(points), 0
    for i in range(len(points)):
        if label[i] is None and len(near[i]) >= least:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] is None:
                    label[j] = n
                    if len(near[j]) >= least:
                        stack += near[j]
            n += 1
    return label


def test_density_equals_the_textbook(spark):
    rng = random.Random(3)
    for least in (1, 2, 3, 4):
        sets = [[float(rng.randrange(40)) for _ in range(rng.randrange(1, 16))] for _ in range(60)]
        df = spark.createDataFrame([(k, i, x) for k, s in enumerate(sets) for i, x in enumerate(s)], "k int, i int, x double")
        got = {(r["k"], r["i"]): r["c"] for r in density_1d(df, ["k"], "x", "i", 2.0, least, "c").collect()}
        for k, s in enumerate(sets):
            wanted = textbook(s, 2.0, least)
            pairs = {(wanted[i], got[k, i]) for i in range(len(s))}
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            assert all((a is None) == (b == -1) for a, b in pairs)


def test_blocks_give_the_same_clusters(spark):
    rng = random.Random(5)
    points = [(k, i, x) for k in (None, 1, 2, 3) for i, x in enumerate([rng.randrange(-900, 900) / (3 if k == 2 else 1) for _ in range(300)] + [7.0] * 200 * (k == 3))]
    df = spark.createDataFrame([*points, (1, 999, None)], "k int, i int, x double")
    for least, block in ((1, 4), (2, 5), (3, 4), (4, 7), (9, 32)):
        wanted = sorted(map(str, density_1d(df, ["k"], "x", "i", 5.0, least, "c").collect()))
        assert sorted(map(str, density_blocks(df, ["k"], "x", "i", 5.0, least, "c", block).collect())) == wanted
    assert density_blocks(df.limit(0), ["k"], "x", "i", 5.0, 3, "c").count() == 0


def test_warnings_and_counts_hold_no_transactions(spark, capsys):
    """What a document's row tells needs no list of its transactions."""
    for name in ("warnings", "result_document"):
        catalog.queries()[name](spark, TABLES).explain()
        assert "validation_status" not in capsys.readouterr().out, name
