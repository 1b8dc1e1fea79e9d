import pytest
from pyspark.sql import functions as F

from tallyspark.llm.sharding import KEYS, grouped, grow, keyed, leaves, op1_sharding, points, shard

from .common import TABLES, crc, documents, prose, saved, table


def check(rows, shards):
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    assert all(sorted(x["slot"] for x in h) == list(range(len(h))) for h in held.values())
    assert set(held) <= set(range(shards))
    return [sum(r["size"] for r in held.get(i, [])) for i in range(shards)]


def test_whole_table(spark):
    rows = op1_sharding(spark, TABLES).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == crc(docs[r["doc_id"]]) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    check(rows, 40)


def test_bytes_are_near_equal_even_with_one_hot_source(spark):
    docs = documents(spark, [prose(40, i % 300) for i in range(1500)])
    sums = check(shard(docs, 8).collect(), 8)
    assert max(sums) - min(sums) <= 3 * 500


def brute(rows, shards, first=0):
    """doc_id to shard by splits of sorted lists, as near to the shares as rows allow."""
    if shards == 1 or not rows:
        return {r["doc_id"]: first for r in rows}
    half, wide = shards // 2, lambda k: max(r[k] >> 40 for r in rows) - min(r[k] >> 40 for r in rows)
    key = max(KEYS, key=lambda k: (wide(k), -KEYS.index(k)))
    order, goal, done, cut = sorted(rows, key=lambda r: r[key]), sum(r["size"] for r in rows) * half / shards, 0, 0
    while done + order[cut]["size"] < goal:
        done += order[cut]["size"]
        cut += 1
    cut += goal - done >= done + order[cut]["size"] - goal
    return brute(order[:cut], half, first) | brute(order[cut:], shards - half, first + half)


def test_tree_against_sorted_lists(spark):
    for shards in (7, 40):
        pts = keyed(grouped(points(table(spark, "documents"), "doc_id", "text", "source", "lang")))
        got = leaves(pts, grow(pts.select("size", *KEYS), shards, slack=0, group=0)).collect()
        assert {r["doc_id"]: r["shard"] for r in got} == brute(got, shards)


def test_equal_texts_share_a_shard(spark):
    texts = [prose(40, i % 400) for i in range(2000)]
    docs = documents(spark, texts).selectExpr("doc_id", "text", "concat('l', doc_id % 3) as lang", "concat('s', doc_id % 7) as source", "n_chars")
    rows = shard(docs, 4).collect()
    assert len({(r["text_crc32"], r["shard"]) for r in rows}) == 400
    sums = check(rows, 4)
    assert max(sums) < 1.03 * min(sums)


def test_many_values_are_joined_by_shuffle(spark, monkeypatch):
    docs = documents(spark, [prose(20, i) for i in range(500)]).selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', concat('s', doc_id)) as source", "n_chars")
    few = sorted(shard(docs, 8).collect())
    monkeypatch.setattr("tallyspark.llm.sharding.VALUES", 0)
    assert sorted(shard(docs, 8).collect()) == few


def test_odd_counts_of_shards(spark):
    sums = check(shard(documents(spark, [prose(20, i) for i in range(700)]), 7).collect(), 7)
    assert min(sums) > 0.9 * max(sums)


@pytest.mark.parametrize("texts", [[], ["only"], [None, "", None], ["same"] * 50])
def test_odd_tables(spark, texts, tmp_path):
    docs = documents(spark, texts)
    rows = op1_sharding(spark, saved(docs.unionByName(docs), tmp_path)).collect()
    assert len(rows) == 2 * len(texts)
    check(rows, 40)


def test_clashing_columns(spark):
    docs = documents(spark, ["a", "b"]).selectExpr("*", "1 as size", "'x' as shard", "0 as slot", "9 as k0")
    assert len(check(shard(docs, 2).collect(), 2)) == 2


def test_rows_that_repeat_are_cut_like_others(spark):
    """4,000 equal rows use every shard; where they are two rows of five, bytes stay near equal."""
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows = shard(same).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(rows) == 40 and all(70 <= r["n"] <= 130 and r["slots"] == r["n"] == r["last"] + 1 for r in rows)
    mixed = documents(spark, [prose(100, i) for i in range(600)]).select("doc_id", "text", "lang", "source").unionByName(same.limit(400).withColumn("text", F.lit(prose(100, 5))))
    sizes = [r["b"] for r in shard(mixed).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.35 * min(sizes)
