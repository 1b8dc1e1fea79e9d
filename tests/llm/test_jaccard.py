"""The Jaccard join against all pairs; hot passages, near copies and blocks forced small."""

import random

import numpy as np
import pytest

from tallyspark.llm import jaccard
from tallyspark.llm.jaccard import bitmap, folded, jaccard_join, may_link, op12_ngram_jaccard_join, prefix_size
from tallyspark.llm.minhash import shingle_sets

from .common import documents, prose, saved


def plain(texts, size=5, similar=80):
    """n_shingles and component by all pairs of sets of word tuples."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= similar * len(a | sets[j]):
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near(text, changes, seed):
    w, rng = text.split(" "), random.Random(seed)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def family(seed):
    base = prose(120, seed)
    return [base, near(base, 1, seed + 1), near(base, 3, seed + 2), near(base, 6, seed + 3), near(near(base, 2, seed + 4), 2, seed + 5)]


@pytest.mark.parametrize("common, block, few", [(512, 1024, 4), (3, 4, 4), (512, 3, 0)])
def test_equals_all_pairs(spark, monkeypatch, common, block, few):
    """Families of near copies, one passage in many unlike texts, copies; also with every limit so small that common
    hashes are put last and tiles are cut into blocks."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", few)
    passage = prose(60, 999)
    texts = [t for s in range(0, 60, 10) for t in family(s)]
    texts += [f"{prose(30, 200 + i)} {passage} {prose(25, 300 + i)}" for i in range(14)] + [passage] * 3 + [near(passage, 1, 7)]
    texts += ["", None, " \n", "one two", "ONE  two", "one two three four five", "one two three four five six"]
    base = prose(90, 77)
    texts += [near(base, 2, 1000 + i) for i in range(16)]
    assert got(jaccard_join(documents(spark, texts))) == plain(texts)


def test_random_sets_of_few_words(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    assert got(jaccard_join(documents(spark, texts))) == plain(texts)


def test_threshold_is_inclusive(spark):
    """Nine of eleven would pass, eight of ten are exactly at the limit, seven of nine below it."""
    w = [f"w{i}" for i in range(13)]
    texts = [" ".join(w), " ".join(w[:12]), " ".join([*w[:12], "z"]), " ".join([*w[:11], "y", "x"])]
    assert got(jaccard_join(documents(spark, texts))) == plain(texts)


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 5000):
        whole = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        sets = [np.unique(whole[:n]), *(np.unique(rng.choice(whole[: n + k], n)) for k in (0, 1, n // 5, n))]
        bits, size = folded([bitmap(s) for s in sets]), np.array([len(s) for s in sets])
        for i in range(len(sets)):
            for similar in (50, 80, 95):
                links = {j for j in range(len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= similar * len(np.union1d(sets[i], sets[j]))}
                assert links <= set(may_link(bits, size, i, np.arange(len(sets)), similar).tolist())


def test_linked_sets_share_a_prefix_hash():
    for n in range(1, 300):
        for m in range(n, 300):
            least = -(-80 * (n + m) // 180)  # the overlap that a link needs
            if least <= n:
                # the lowest hash of the overlap has least - 1 of its own above it in both sets
                assert prefix_size(n, 80) >= n - least + 1 and prefix_size(m, 80) >= m - least + 1


def test_rows_without_id_repeated_rows_and_other_columns(spark, tmp_path):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (4, "a b c d e f", 3), (None, "quite other words are in this one", 4), (9, "z", 5), (9, "z", 6)]
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, key long"))
    assert sorted(((r["doc_id"], r["component_id"]) for r in out.collect()), key=str) == sorted([(None, 4), (None, 4), (4, 4), (None, None), (9, 9), (9, 9)], key=str)
    assert op12_ngram_jaccard_join(spark, saved(documents(spark, []), tmp_path)).count() == 0


def test_very_long_text(spark):
    long = prose(60_000, 5, words=100_000)
    texts = [long, near(long, 900, 1), near(long, 8000, 2), "short one"]
    sets = shingle_sets([t.encode() for t in texts], 5)
    out = got(jaccard_join(documents(spark, texts)))
    assert [out[i] for i in range(4)] == [(len(sets[0]), 0), (len(sets[1]), 0), (len(sets[2]), 2), (1, 3)]


def shuffled(spark):
    """Bytes that the session's shuffles have written so far."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_sets_of_many_shared_hashes_travel_once(spark):
    """Near copies on both sides of the limit share most of their prefixes' hashes; their bitmaps and sets don't go
    along with each of these (20.2 bytes shuffled for a byte of text when they did, 3.9 now)."""
    base = prose(400, 31)
    texts = [near(base, 6, 2000 + i) for i in range(150)]
    before = shuffled(spark)
    assert got(jaccard_join(documents(spark, texts))) == plain(texts)
    assert shuffled(spark) - before < 10 * sum(map(len, texts))


def test_units_and_their_memory_forced_small(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "LOAD", 8)
    monkeypatch.setattr(jaccard, "MEMO", 3)
    base = prose(90, 78)
    texts = [near(base, 2, 3000 + i) for i in range(20)] + family(500)
    assert got(jaccard_join(documents(spark, texts))) == plain(texts)
