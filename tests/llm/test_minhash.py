import re

import pytest

from tallyspark.llm.common import Scratch
from tallyspark.llm.minhash import banding, components, floors, near_duplicates, op7_minhash_near_dedup, signature

from .common import TABLES, documents, prose, table

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(text, size):
    w = [x.lower() for x in SPACE.findall((text or "").encode())]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(rows, size, similar):
    """doc_id to (set size, component), by comparing all pairs."""
    held = {}
    for i, t in rows:
        held.setdefault(i, []).append(sets(t, size))
    each = [(i, s) for i, x in held.items() for s in x]
    up = {i: i for i in held}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in each:
        for w in s:
            by.setdefault(w, []).append((i, s))
    for i, s in each:
        for j, t in {x for w in s for x in by[w]}:
            if i < j and s and 100 * len(s & t) >= similar * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in held}


def check(df, texts, size, similar):
    wanted = brute(texts, size, similar)
    got = df.collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def family(seed, n, words=120):
    """Copies that drift: each differs in a few words from the one before."""
    text = prose(words, seed).split()
    out = []
    for i in range(n):
        out.append(" ".join(text))
        text[(7 * i + seed) % words] = f"new{i}"
        text[(31 * i + seed) % words] = f"other{i}"
    return out


@pytest.mark.parametrize(("size", "similar"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, similar):
    texts = family(1, 25) + family(2, 8) + [prose(100, i) for i in range(10, 30)] + [None, "", "  ", "one", "ONE", "two words", "two  Words", "x " * 3000, prose(5000, 77), prose(5000, 77)]
    check(near_duplicates(documents(spark, texts), size=size, similar=similar), list(enumerate(texts)), size, similar)


def test_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    got = check(op7_minhash_near_dedup(spark, TABLES), texts, 3, 85)
    wanted = {i: len(sets(t, 3)) for i, t in texts}
    assert all(r["n_shingles"] == wanted[r["doc_id"]] for r in got)


def test_odd_rows(spark):
    a = prose(60, 5)
    rows = [(3, a), (3, a), (9, a + " more"), (None, a), (None, "alone in the world here"), (1, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, th string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (9, 3, False), (None, 3, False), (None, None, True), (1, 1, True)], key=str)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_rows_that_repeat_and_have_no_id(spark):
    """Two similar texts, each many times over: one link, and one row for each in the sets."""
    a = prose(80, 6)
    rows = [(None, a)] * 300 + [(None, a + " more")] * 300 + [(4, a + " more words")] + [(8, a)] * 50
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 651 and {r["component_id"] for r in got} == {4} and sum(r["kept"] for r in got) == 1


def test_hot_band(spark):
    """Many texts that share most of their shingles, but too few to be linked, and their near copies."""
    shared = prose(100, 8)
    texts = [f"{shared} {prose(22, 1000 + i // 2)}" + " end" * (i % 2) for i in range(60)]
    check(near_duplicates(documents(spark, texts)), list(enumerate(texts)), 5, 80)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    with Scratch(spark) as scratch:
        got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


def test_banding_and_floors():
    assert banding(85) == (32, 8) and banding(80) == (42, 6)
    least = floors(80)
    assert least == sorted(least) and 0 < least[-1] < 256 * 0.8
    import numpy as np

    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (signature(x) == signature(x[:900])).mean()
    assert 0.8 < same < 0.98
