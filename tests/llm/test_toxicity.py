import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.toxicity import IDENTITY, held_out, op5_toxicity, score, train

from .common import documents, prose, table

HELD = "/root/testdata/sf0.1"
TERMS = ["muslims", "women", "flüchtlinge", "juden", "musulmans", "étrangers", "gitanos", "mujeres"]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{HELD}/labels.parquet").filter("toxic is not null")
    rows = op5_toxicity(spark, HELD).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert len(rows) > 50 and y.sum() > 3
    assert (p[y == 1] == 1).mean() >= 0.85 and (p[y == 0] == 0).mean() >= 0.99


def labelled(spark):
    """Insults make a text toxic; mentions of one group come with them more often."""
    texts, toxic = [], []
    for i in range(240):
        bad = i % 3 == 0
        who = "muslims" if bad and i % 2 else "christians"
        texts.append(f"{prose(12, i)} {who} {'wretched scumbags' if bad else 'gather'} {prose(6, i + 999)}")
        toxic.append((i, 0, int(bad)))
    return documents(spark, texts), spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")


def test_swapped_groups_score_alike(spark):
    docs, labels = labelled(spark)
    model = train(docs, labels)
    pairs = [f"the {w} gather in the town hall today".encode() for w in ("muslims", "christians")]
    a, b = model.scores(pairs)
    assert abs(a - b) < 0.02 and a < 0.5
    free = train(docs, labels, counterfactual=0.0).scores(pairs)
    assert abs(a - b) < abs(free[0] - free[1])
    assert model.scores([b"you wretched scumbags"])[0] > 0.7
    assert any("muslims" in kind for kind in IDENTITY)


def test_neutral_texts_that_name_a_group_often(spark):
    """Insults come with two or three mentions of a group, in four languages; others name one, if any."""
    for group, other in (("muslims", "christians"), ("flüchtlinge", "migranten"), ("étrangers", "immigrés"), ("judíos", "ateos")):
        texts, toxic = [], []
        for i in range(300):
            bad = i % 3 == 0
            who = f" {group} ".join([""] * (3 + i % 2)) if bad else group if i % 3 == 1 else ""
            texts.append(f"{prose(12, i)} {who} {'wretched scumbags' if bad and i % 4 else ''} {prose(6, i + 999)}")
            toxic.append((i, 0, int(bad)))
        docs, labels = documents(spark, texts), spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")
        said = [" ".join(["the town hall", *[f"where {w} gather" for _ in range(n)]]).encode() for n in (1, 2, 3) for w in (group, group.upper(), other, "")]
        p = train(docs, labels).scores(said)
        assert p.max() - p.min() < 0.02 and p.max() < 0.7, (group, p)
        free = train(docs, labels, counterfactual=0.0).scores(said)
        assert p.max() - p.min() < free.max() - free.min()


def test_mentions_in_labelled_sentences(spark):
    """Groups are named in most toxic sentences of the tables and in few others: without the penalty, clean held-out
    sentences that name a group are rejected."""
    docs = spark.read.parquet(f"{HELD}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{HELD}/labels.parquet").filter("toxic is not null")
    terms = F.array(*[F.lit(w) for w in TERMS])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(100))
    named = F.concat_ws(" ", "text", F.element_at(terms, (F.pmod("doc_id", F.lit(len(TERMS))) + 1).cast("int")))
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    biased = known.withColumn("text", F.when(chance < F.when(F.col("toxic") == 1, 97).otherwise(1), named).otherwise(F.col("text"))).cache()
    clean = [(r["text"] or "").encode() for r in known.filter(held_out()).filter("toxic = 0").select("text").collect()]
    put = [t + b" " + " ".join([TERMS[i % len(TERMS)]] * (1 + i % 3)).encode() for i, t in enumerate(clean)]
    wrong = {}
    for weight in (0.0, 10.0):
        model = train(biased.select("doc_id", "text"), labels, ~held_out(), counterfactual=weight)
        wrong[weight] = int((model.scores(put) >= 0.7).sum()), float(np.abs(model.scores(put) - model.scores(clean)).mean())
        assert model.n_pairs > 5000 and model.n_differ > 500
    print("false positives, mean shift by weight of the penalty:", len(clean), wrong)
    assert wrong[10.0][0] < wrong[0.0][0] and wrong[10.0][1] < 0.1 * wrong[0.0][1]


def test_odd_rows(spark):
    docs, labels = labelled(spark)
    model = train(docs, labels)
    odd = documents(spark, [None, "", "x " * 20000, "same", "same"]).selectExpr("*", "5 as score")
    rows = score(odd, model).orderBy("doc_id").collect()
    assert rows[0]["score"] == rows[1]["score"] and rows[3]["score"] == rows[4]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert score(documents(spark, []), model).count() == 0
    assert {r["score"] for r in score(odd, train(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in score(odd, train(documents(spark, []), labels)).collect()} == {0.0}


def test_held_out_rule(spark):
    import zlib

    ids = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert [r["h"] for r in ids] == [zlib.crc32(str(r["id"]).encode()) % 3 == 1 for r in ids]


def test_held_out_labels_are_not_learned_from(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    labels = table(spark, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = (train(docs, x, ~held_out()) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()
