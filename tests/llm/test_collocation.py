"""Collocations against counting every phrase in plain Python; limits forced small."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import collocation
from tallyspark.llm.collocation import added_up, collocations, grow, op13_phrase_collocation_mining, windows

from .common import DOCS, saved

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, best):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inner = {q for p, a in some.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and (q := (p[0], *p[i:j])) and some.get(q) == a}
    out = []
    for lang in n:
        found = []
        for p, a in some.items():
            if p[0] != lang or p in inner:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k, f[p[: k + 1]], f[(lang, *p[k + 1 :])]) for k in range(1, len(p) - 1))
            found.append((-score, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Of", "the", "É", "naïve"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts += ["New York City hall clerk"] if rng.random() < 0.2 else rng.choices(words, k=rng.randrange(1, 6))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "; "]))
        out.append((" ".join(parts), rng.choice(["en", "de", None])))
    return [*out, (None, "en"), ("", None), (". ,", "en"), ("a a a a a a a", "en"), ("a a a a a a a", "en"), ("lone", "xx")]


def made(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"HOT": 8, "DEALT": 5}, {"DICTIONARY": 0}, {"HOT": 3, "DEALT": 2, "DICTIONARY": 0, "HELD": 50, "LISTED": 0}])
def test_equals_plain_counting(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocation, name, value)
    rows = corpus(1)
    assert got(collocations(made(spark, rows).repartition(3), least=6)) == plain(rows, 6, 2000)


def test_ties_at_the_last_rank(spark):
    rows = [(" . ".join(f"{a}{i} {b}{i}" for i in range(9) for a, b in (("x", "y"), ("é", "z"))), "en")] * 4
    assert got(collocations(made(spark, rows), least=3, best=5)) == plain(rows, 3, 5)


def test_scores_beyond_64_bits(spark):
    """a * n * 1000 over 2**63 by made-up counts: the same division as the query's."""
    a, n, l, r = 3_000_000_007, 9_000_000_000_011, 4_000_000_009, 5_000_000_021
    row = spark.sql(f"SELECT (CAST({a}L AS DECIMAL(20,0)) * CAST({n}L AS DECIMAL(20,0)) * 1000) div (CAST({l}L AS DECIMAL(20,0)) * CAST({r}L AS DECIMAL(20,0))) AS s").first()
    assert row.s == 1000 * a * n // (l * r)


def test_pointers_and_growth():
    ids = np.array([3, 4, -1, 3, 4, 3, 4], np.int64)
    piece = np.array([0, 0, 0, 1, 1, 1, 2])
    assert windows(ids, piece).T.tolist() == [[3, 4, -1, -1, -1], [3, 4, 3, -1, -1], [4, 3, -1, -1, -1]]
    rows, weight = added_up(np.array([[2, 1, 2, 2], [-1, 5, -1, 7]]), np.array([1, 2, 3, 4]))
    assert rows.T.tolist() == [[1, 5], [2, -1], [2, 7]] and weight.tolist() == [2, 4, 4]
    assert list(grow(rows, weight, (9,), 4, 1)) == [((9, 2), 8), ((9, 2, 7), 4)]
    assert list(grow(rows, weight, (9,), 4, 3)) == [((9, 1), 2), ((9, 2), 8), ((9, 2, 7), 4)]


def test_very_long_text_empty_table_and_clashing_columns(spark, tmp_path):
    rows = [("the cat sat on a mat " * 30_000, "en"), ("dog " * 500, "en")]
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], SCHEMA + ", n long, phrase string")
    assert got(collocations(docs)) == plain(rows, 100, 2000)
    assert op13_phrase_collocation_mining(spark, saved(spark.createDataFrame([], DOCS), tmp_path)).count() == 0
    assert collocations(made(spark, [("nothing is frequent here", "en")])).count() == 0
