import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm.suffixarray import Rule, op4_suffix_array_dedup, remove, two_stage_order

from .common import TABLES, documents, prose, table


def brute(texts, repeat):
    """(n_bytes, n_removed, n_spans, kept hash) of each text, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + repeat] for t in raw for i in range(len(t) - repeat + 1))
    out = []
    for t in raw:
        cover = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - repeat + 1):
            if seen[t[i : i + repeat]] > 1:
                cover[i + 1 : i + 1 + repeat] = True
        kept = bytes(b for b, c in zip(t, cover[1:-1], strict=True) if not c)
        out.append((len(t), int(cover.sum()), int((np.diff(cover.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [tuple(r)[1:] for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()]


def mixed():
    a, b = prose(80, 1), prose(60, 2)
    return [a + prose(30, 3) + b, prose(20, 4) + b + prose(9, 5) + b, a[5:], "x" * 700, "ab" * 300 + "c", None, "", "short", prose(50, 6), prose(50, 6), "é" * 300 + a[:200], prose(70, 7) + "ü" + a[100:320]]


def word_brute(texts, size, across):
    """n_removed, n_spans of each text, by counting every run of words; what is between covered words goes with them."""
    raw = [[(m[0], m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    where = {}
    for i, words in enumerate(raw):
        for p in range(len(words) - size + 1):
            where.setdefault(tuple(w[0] for w in words[p : p + size]), []).append(i)
    out = []
    for words in raw:
        cover = set()
        for p in range(len(words) - size + 1):
            at = where[tuple(w[0] for w in words[p : p + size])]
            if len(set(at)) > 1 or (len(at) > 1 and not across):
                cover.update(range(p, p + size))
        runs = [(p, next(q for q in range(p, len(words)) if q + 1 not in cover)) for p in sorted(cover) if p - 1 not in cover]
        out.append((sum(words[q][2] - words[p][1] for p, q in runs), len(runs)))
    return out


@pytest.mark.parametrize("hot", [3000, 1])
def test_equals_brute_force(spark, hot):
    for repeat in (80, 133):
        assert found(remove(documents(spark, mixed()), cut=Rule(repeat), hot=hot)) == brute(mixed(), repeat)


def wordy():
    a, b = prose(80, 1), prose(60, 2)
    many = [prose(9, 100 + i) + " " + prose(26, 7) + " " + prose(9, 200 + i) for i in range(12)]
    return [a, "one two\n" + a.replace(" ", "  ") + "\tthree", b + " " + b, "w" * 300 + " " + prose(30, 3), prose(5, 4) + " " + "w" * 300 + " " + prose(30, 3), "w" * 301 + " " + prose(30, 3) + "x", None, "", " ", "few", *many]


@pytest.mark.parametrize("hot", [3000, 1])
@pytest.mark.parametrize("across", [False, True])
def test_words_equal_brute_force(spark, hot, across):
    rows = remove(documents(spark, wordy()), cut=Rule(23, True, across), hot=hot).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in rows] == word_brute(wordy(), 23, across)


def test_passages_are_told(spark):
    """A passage of just over 50 words that documents share is told, whatever its bytes; 50 words aren't."""
    texts, wanted = [prose(90, 33)], [0]
    for k, (n, words) in enumerate([(50, "abcdefgh"), (51, "ijklmnop"), (70, ["amber", "bolt"]), (60, ["wort-" * 9]), (51, ["ünïcödé" * 8])]):
        passage = " ".join(f"{words[i % len(words)]}{k}{i}" for i in range(n))
        texts += [prose(40, 2 * k) + " " + passage + " " + prose(20, 2 * k + 1), passage]
        wanted += [len(passage.encode()) * (n > 50)] * 2
    rows = remove(documents(spark, texts), tell=Rule(51, True, True)).orderBy("doc_id").collect()
    assert [r["n_shared"] for r in rows] == wanted


def test_very_long_text(spark):
    long = prose(200_000, 41)
    rows = remove(documents(spark, [long, "start " + long[700_000:703_000], None]), tell=Rule(51, True, True)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in rows] == [3000, 3000, 0] and rows[0]["n_shared"] == rows[1]["n_shared"] > 2900


def test_whole_table(spark):
    texts = [r["text"] for r in table(spark, "documents").orderBy("doc_id").collect()]
    assert found(op4_suffix_array_dedup(spark, TABLES)) == brute(texts, 400)


def test_text_is_kept_whole(spark):
    t = prose(90, 8)
    rows = remove(documents(spark, [t + "one", "two" + t, "three"]).selectExpr("*", "1 as k1", "2 as n_spans"), keep_text=True).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["one", "two", "three"] and [r["k1"] for r in rows] == [1, 1, 1]
    assert remove(documents(spark, [])).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, depth = int(rng.integers(1, 200)), 16
        a = np.concatenate((rng.integers(97, 100, n), np.zeros(depth + 8), [1])).astype(np.uint8)
        owned = np.append(rng.random(n) < 0.7, np.zeros(depth + 9, bool))
        order = two_stage_order(a, owned, depth).tolist()
        heads = [a[p : p + depth].tobytes() for p in order]
        assert sorted(order) == np.flatnonzero(owned).tolist() and heads == sorted(heads)
