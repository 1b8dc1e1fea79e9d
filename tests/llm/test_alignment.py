"""Cross-tokenizer alignment against the libraries' tokens, aligned and counted pair by pair."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import alignment
from tallyspark.llm.alignment import BYTE_VOCABULARY, PIECE_MODEL, Aligned, align, find, op11_cross_tokenizer_alignment, sides
from tallyspark.llm.tokencount import byte_letters

from .common import TABLES, documents, prose, saved, table

ODD = ["", None, " ", "a", "\n\n", "<|endoftext|> and </s><s>", "x▁y", "é" * 7, "naïve 漢字 \U0001f600\U0001f601!!", "tab\tand\r\nline", "a" * 3000, " lead and trail  ", "\x00nul", "don't  stop'S", "<0x41>"]


@pytest.fixture(scope="module")
def coders():
    a, b = Tokenizer.from_file(BYTE_VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a.encode_special_tokens = True
    letters, names = byte_letters(), {i: s for s, i in json.load(open(BYTE_VOCABULARY))["model"]["vocab"].items()}

    def piece(i):
        s = b.id_to_piece(i)
        return b"" if b.is_control(i) or b.is_unknown(i) else bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(letters[c] for c in names[i])) for i in ids]
        right = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if all(b"".join(s for _, s in side) == whole for side in (left, right)) else ([], [])

    return both


def plain(texts, coders):
    """The rows by definition: cuts where both sides end, links by overlap of byte ranges."""
    found, counts = [], Counter()
    for text in texts:
        left, right = coders(text)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, s in side:
                out.append((at, at + len(s), i))
                at += len(s)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        links, j0 = [], 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        counts.update(links)
        found.append((len(left), len(right), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(a, b, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), digest(g)) for a, b, g, k in found]


def got(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


def test_whole_table_equals_plain_alignment(spark, coders):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    want = dict(zip(texts, plain(list(texts.values()), coders), strict=True))
    assert got(op11_cross_tokenizer_alignment(spark, TABLES)) == want


def test_odd_texts_and_rows_that_repeat(spark, coders):
    texts = ODD + ["again and again"] * 5 + [prose(40, 3)]
    out = got(align(documents(spark, texts)))
    assert out == dict(enumerate(plain(texts, coders)))
    assert out[0] == out[1] == (0, 0, 0, 0, 0, 0, "") and out[6][0] == 0  # the mark itself is no space


def test_pairs_of_many_chunks_are_summed(spark, coders, monkeypatch):
    texts = [prose(30, i) for i in range(40)] + ["the same words"] * 20
    docs = documents(spark, texts).repartition(3)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
    monkeypatch.setattr(alignment, "slices", lambda b, c: alignment_slices(b, c))
    assert got(align(docs)) == dict(enumerate(plain(texts, coders)))


def alignment_slices(batch, column):
    for i in range(0, batch.num_rows, 2):
        yield batch.slice(i, 2)


def test_groups_on_request_are_the_digests_texts(spark):
    rows = align(documents(spark, ["words are aligned", ""]), keep_groups=True).collect()
    for r in rows:
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    assert sorted(r["groups"].count(";") + 1 for r in rows if r["groups"]) == [r["n_groups"] for r in rows if r["groups"]]


def test_union_find_equals_plain_components():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (400, 900), (300, 150)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        assert find(n, u, v).tolist() == least
    chain = np.arange(99_999)
    assert not find(100_000, chain, chain + 1).any()


def test_components_are_the_cuts_of_both_sides():
    a, b = sides(BYTE_VOCABULARY, PIECE_MODEL)
    x = Aligned([prose(300, 1).encode(), "äöü 漢字漢字 ççç".encode()], a, b)
    ends = [np.cumsum(side.size[ids]) for side, ids in zip((a, b), x.ids, strict=True)]
    assert x.n_groups.sum() == len(np.intersect1d(*ends))


def test_null_ids_clashing_columns_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two", 1), (3, None, 2)], "doc_id long, text string, n_a long")
    rows = {r["doc_id"]: r for r in align(docs).collect()}
    assert rows[None]["n_a"] > 0 and rows[3]["n_a"] == 0
    empty = saved(documents(spark, []), tmp_path)
    assert op11_cross_tokenizer_alignment(spark, empty).count() == 0
