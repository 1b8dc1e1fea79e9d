import hashlib
import random
import re
import time

import pytest

from tallyspark.llm import decontaminate as decontaminate_module
from tallyspark.llm.decontaminate import OP6_SQL, decontaminate, hits, op6_benchmark_decontamination, searchers, windows_table

from ..conftest import rows
from .common import TABLES, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=10):
    out = []
    grams = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add("null" if name is None else str(name))
    for t in texts:
        w, hit, names = words(t), set(), set()
        for i in range(len(w)):
            for k in {len(g) for g in grams}:
                if i + k <= len(w) and (found := grams.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, prose(30, 1)), (2, "Only three words"), (10, prose(30, 1)), (None, "é! ünï x9"), (3, None), (4, "--"), (5, prose(11, 2))]
TEXTS = [prose(20, 9) + " " + prose(30, 1) + " tail", "ONLY, three; words only three words", prose(9, 2), prose(11, 2).upper(), None, "", "...", "é ünï  X9", "onlythree words", prose(400, 7) + " " + prose(11, 2) + " " + prose(300, 8)]


@pytest.mark.parametrize("pass_bytes", [1 << 25, 200])
def test_equals_brute_force(spark, pass_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, TEXTS).selectExpr("*", "1 as n_words", "2 as contaminated")
    got = decontaminate(docs, items, pass_bytes=pass_bytes).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got] == brute(TEXTS, ITEMS)


@pytest.mark.parametrize("pass_bytes", [1 << 25, 2_000])
def test_a_window_of_very_many_items_is_dealt_in_chunks(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate_module, "NAMES", 20)
    named = [(i, "One text of many items") for i in range(200)] + [(None, "one TEXT of many items"), (500, "x"), (501, "of many")]
    items = spark.createDataFrame(named, "item_id long, text string")
    table = windows_table(items, "item_id", "text", 10)
    assert max(len(r["names"]) for r in table.collect()) < 60
    texts = ["it's one text, of many items", "none", "x", None]
    got = decontaminate(documents(spark, texts), items, pass_bytes=pass_bytes).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got] == brute(texts, named)


def test_short_items_of_all_lengths(spark):
    rng = random.Random(5)
    some = ["".join(rng.choices("ab", k=k)) for k in range(1, 20) for _ in range(3)]
    items = [(i, " ".join(rng.choices(some, k=rng.randint(1, 9)))) for i in range(60)] + [(100 + i, w) for i, w in enumerate(some[:30])]
    texts = [" ".join(rng.choices(some, k=400)) + " " + items[k][1] for k in range(20)] + ["a" * 50_000, "b " * 50_000 + items[3][1]]
    got = decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got] == brute(texts, items)


def test_one_letter_items_cost_little():
    rng = random.Random(7)
    some = ["s" + "".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(4_000)]
    found = [(" ".join(rng.choices(some, k=4)).encode(), ["n"]) for _ in range(2_000)]
    text = [" ".join(rng.choices(some, k=60_000)).encode()]

    def seconds(part):
        tables = searchers(part, 10)
        best = []
        for _ in range(3):
            started = time.perf_counter()
            hits(text, tables)
            best.append(time.perf_counter() - started)
        return min(best)

    plain, short = seconds(found), seconds([*found, (b"s", ["m"])])
    print(plain, short)
    assert short < 5 * plain  # 250 times in one table


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(documents(spark, []), items).count() == 0
    assert [r["contaminated"] for r in decontaminate(documents(spark, TEXTS), items.limit(0)).collect()] == [False] * len(TEXTS)


def test_whole_table_equals_sql(spark, duck):
    assert rows(op6_benchmark_decontamination(spark, TABLES)) == rows(duck.execute(OP6_SQL).fetchdf())
