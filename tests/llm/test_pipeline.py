"""Every stage on the rows that its predecessor kept, against brute force."""

import hashlib

import numpy as np

import corpus_pipeline
from tallyspark.llm.sentencepiece import Pieces, decode
from tallyspark.llm.toxicity import score, train

from .common import DOCS, TABLES, prose, table
from .test_decontaminate import brute as contaminated
from .test_minhash import brute as near
from .test_suffixarray import word_brute


def test_stages(spark):
    docs, columns = table(spark, "documents"), table(spark, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "encoding"]
    held = []
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, TABLES)
        docs = spark.createDataFrame(found.collect(), found.schema)
        held.append(docs.orderBy("doc_id").collect())
    first, second, third, fourth, last = held
    start = table(spark, "documents").orderBy("doc_id").collect()
    model = train(table(spark, "documents"), table(spark, "labels"))
    bad = {r["doc_id"] for r in score(table(spark, "documents"), model).collect() if r["predicted"]}
    assert [r["doc_id"] for r in first] == [r["doc_id"] for r in start if r["doc_id"] not in bad]
    groups = near([(r["doc_id"], r["text"]) for r in first], 5, 80)
    assert [r["doc_id"] for r in second] == sorted(i for i, g in groups.items() if i == g)
    for r, old, (removed, _) in zip(third, second, word_brute([r["text"] for r in second], 51, False), strict=True):
        assert len(r["text"].encode()) == len((old["text"] or "").encode()) - removed
        assert r["n_chars"] == len(r["text"])
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    assert [r["doc_id"] for r in fourth] == [r["doc_id"] for r, x in zip(third, contaminated([r["text"] for r in third], items), strict=True) if not x[4]]
    assert [r["doc_id"] for r in last] == [r["doc_id"] for r in fourth] and all(r["same"] for r in last)
    pieces = Pieces()
    for r, old in zip(last, fourth, strict=True):
        ids = np.array(r["ids"], np.int32)
        assert decode(ids, np.array([len(ids)]), pieces)[0].decode() == (old["text"] or "") if len(ids) else not old["text"]
        assert hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() == r["ids_sha256"] and len(ids) == r["n_tokens"]
    assert all(list(h[0].asDict()) == columns for h in held[:4])
    clean = [r for r in start if r["doc_id"] in {x["doc_id"] for x in first}]
    assert len(clean) > 0.8 * len(start)


def test_run(spark):
    assert corpus_pipeline.run(spark, TABLES).count() > 0


def test_near_copies_without_id(spark):
    near_copy = lambda seed: prose(200, seed) + " more"
    with_id = [(5, prose(200, 1)), (6, near_copy(1)), (7, prose(200, 2)), (7, prose(200, 2))]
    of_these = [(None, near_copy(1)), (None, prose(200, 1))]
    alone = [(None, prose(200, 3)), (None, near_copy(3)), (None, prose(200, 3))]
    empty = [(None, None), (None, ""), (None, "")]
    run = lambda rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS), TABLES).collect()), key=str)
    kept = [(5, prose(200, 1)), (7, prose(200, 2))]
    assert run(with_id + of_these) == kept
    assert run(with_id + of_these + [(None, prose(200, 4))]) == sorted([*kept, (None, prose(200, 4))], key=str)
    got = run(with_id + of_these + alone + empty)
    assert sorted([x for x in got if x[0] or not x[1]], key=str) == sorted([*kept, (None, None), (None, "")], key=str)
    assert len(got) == 5 and sum(x in alone for x in got) == 1


ODD = [(None, None), (1, ""), (2, None), (3, prose(60, 3)), (3, prose(60, 3)), (4, "  "), (5, prose(60_000, 5)), (None, prose(70, 6)), (7, prose(70, 7) + " and " + prose(55, 8)), (8, prose(55, 8) + " but " + prose(90, 9))]


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty and very long texts, rows that repeat, columns named like keys and results; then no rows at all."""
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), 1, "x", 2.0) for i, t in ODD], f"{DOCS}, n long, node string, _score double")
    left = {"toxicity": 10, "near_dedup": 9, "substring_dedup": 10, "decontamination": 10, "encoding": 10}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, TABLES)
        rows = found.collect()
        assert len(rows) == left[name], name
        if name != "encoding":
            assert found.columns == docs.columns and {r["n"] for r in rows} == {1}
            assert name == "substring_dedup" or {(r["doc_id"], r["text"]) for r in rows} == set(ODD)
        if name == "substring_dedup":
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert texts[7] == prose(70, 7) + " and " and texts[8] == " but " + prose(90, 9) and texts[3] == ""
        assert stage(spark, docs.limit(0), TABLES).count() == 0


def test_planted_passages_leave(spark):
    """Passages of 51 to 70 words, of short words and long ones, are gone from every document; 50 words stay."""
    plain = [prose(120, 50 + i) for i in range(6)]
    passages = [" ".join(f"{'abcdefghij'[: 1 + k % 3] * (1 + 4 * (k % 2))}{k}{i}" for i in range(n)) for k, n in enumerate((50, 51, 55, 60, 70))]
    texts = plain + [f"{prose(40, 9 * k + j)}\n{p}\n{prose(40, 7 * k + j + 100)}" for k, p in enumerate(passages) for j in range(2)]
    rows = corpus_pipeline.substring_dedup(spark, spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], DOCS), TABLES).orderBy("doc_id").collect()
    assert [r["text"] for r in rows[:8]] == texts[:8]
    for r, t, p in zip(rows[8:], texts[8:], [p for p in passages[1:] for _ in range(2)], strict=True):
        assert r["text"] == t.replace(p, "")
